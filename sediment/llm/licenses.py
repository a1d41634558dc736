"""License scans: whole texts looked up by the digest of a canonical form.

The canonical form drops copyright notices (lines) and the "all rights reserved" phrase, lower-cases,
replaces equivalent spellings, turns everything but letters and digits into one space and
trims. Its SHA-256 is joined with the digests of the known texts, to which the same column
expression is applied. Only DataFrame operations are used.

A null text gives null digest and license; an empty canonical form matches nothing. Known
texts with equal canonical forms are reported together, sorted and comma-joined. Repeated
rows give one row each. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.license_texts import EQUIVALENT_SPELLINGS, KNOWN_DIGESTS, KNOWN_LICENSES

#: Known digests are broadcast up to this number of rows (a row has under 200 bytes); beyond it the join shuffles.
BROADCAST_ROWS = 100_000


def spaced(phrase: str) -> str:
    return f" {phrase.replace(' ', '  ')} "


#: Words after "Copyright" that go on with a sentence instead of naming an owner.
_NO_OWNER = r"(?:notices?|holders?|owners?|ownership|licen[sc]\w*|laws?|interests?|statements?|disclaimers?|permissions?|protections?|treat(?:y|ies)|acts?|terms?|infringements?|rights?|and|or|in|of|on|to|as|is|are|for)"
_SIGN_OR_YEAR = r"(?:\(c\)|©|[\[<{(]?(?:\p{N}{4}|y{4}|year)\b)"
#: A copyright notice: a line that starts, maybe after comment marks, with
#: "Copyright" and an owner, a sign or a year; "copyright" (as wrapped prose has it) and a sign
#: or a year; "(c)" and a year, "copyright" with either, or a name; or a copyright sign.
_HEAD = r"^[^\p{L}\p{N}\n©]*"
_MARK = r"(?:(?i:\(c\))[ \t]*)?"
_OWNED = rf"{_MARK}C(?i:opyright)\b"
_DATED = rf"{_MARK}(?i:copyright)\b[ \t:,-]*(?i:{_SIGN_OR_YEAR})"
_SIGNED = rf"(?i:\(c\)[ \t:,-]*{_SIGN_OR_YEAR})"
_NAMED = r"(?:\p{Lu}[\p{L}\p{N}.'&-]*[ \t,]*){2,6}(?:<[^>\n]*>[ \t]*)?"
NOTICE = (
    rf"(?md){_HEAD}(?:"
    rf"{_OWNED}(?=[^\n]*[\p{{L}}\p{{N}}©])(?![^\p{{L}}\p{{N}}\n©(]*(?i:{_NO_OWNER})\b)[^\n]*"
    rf"|{_DATED}[^\n]*"
    rf"|{_SIGNED}[^\n]*"
    rf"|(?i:\(c\))[ \t]+(?=[^\n]*\p{{Ll}}){_NAMED}"
    r"|©[^\n]*"
    r")\r?$"
)


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    out = F.lower(F.regexp_replace(text, NOTICE, " "))  # notices first: names show by their case
    out = F.regexp_replace(out, r"all rights reserved\.?", " ")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    # every word gets a space of its own on both sides, so that plain replacement sees whole words
    out = F.concat(F.lit(" "), F.replace(out, F.lit(" "), F.lit("  ")), F.lit(" "))
    for ours, theirs in EQUIVALENT_SPELLINGS:
        out = F.replace(out, F.lit(spaced(theirs)), F.lit(spaced(ours)))
    out = F.replace(out, F.lit("  "), F.lit(" "))
    return F.trim(out)


def known_digests(texts: DataFrame) -> DataFrame:
    """(license_digest, licenses) of a table (license_id, license_text)."""
    made = texts.select("license_id", F.sha2(canonical(F.col("license_text")), 256).alias("license_digest"))
    return made.groupBy("license_digest").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("licenses"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, canonical_digest, canonical_chars, licenses (null when unknown).

    ``known``: a table (license_id, license_text) of any size; by default the texts and digests that are built in.
    """
    spark = docs.sparkSession
    if known is None:
        listed = F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("license_text")) for k, v in KNOWN_LICENSES.items()))
        known = spark.range(1).select(F.explode(listed).alias("x")).select("x.*")
        told = F.array(*(F.struct(F.lit(v).alias("license_digest"), F.lit(k).alias("licenses")) for k, v in KNOWN_DIGESTS.items()))
        digests = known_digests(known).unionByName(spark.range(1).select(F.explode(told).alias("x")).select("x.*"))
    else:
        digests = known_digests(known)
    rows = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col).cast("string")).alias("c"))
    rows = rows.select("doc_id", F.sha2("c", 256).alias("canonical_digest"), F.length("c").cast("long").alias("canonical_chars"))
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        digests = F.broadcast(digests)
    out = rows.join(digests, F.col("canonical_digest") == F.col("license_digest"), "left")
    return out.select("doc_id", "canonical_digest", "canonical_chars", F.when(F.col("canonical_chars") > 0, F.col("licenses")).alias("licenses"))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the known licenses."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql_canonical(column: str) -> str:
    """DuckDB SQL of :func:`canonical`; its patterns can't look ahead, so lines are taken one by one."""

    def has(pattern: str) -> str:
        return "regexp_matches(x, '{}')".format(pattern.replace("'", "''"))

    owned = has(rf"{_HEAD}{_OWNED}[^\n]*[\p{{L}}\p{{N}}©]") + " AND NOT " + has(rf"{_HEAD}{_OWNED}[^\p{{L}}\p{{N}}\n©(]*(?i:{_NO_OWNER})\b")
    named = has(rf"{_HEAD}(?i:\(c\))[ \t]+{_NAMED}\r?$") + " AND " + has(rf"{_HEAD}(?i:\(c\))[^\n]*\p{{Ll}}")
    notice = f"({owned}) OR {has(_HEAD + _DATED)} OR {has(_HEAD + _SIGNED)} OR ({named}) OR {has(_HEAD + '©')}"
    out = f"array_to_string(list_transform(string_split({column}, chr(10)), lambda x: CASE WHEN {notice} THEN ' ' ELSE x END), chr(10))"
    out = f"lower({out})"
    out = rf"regexp_replace({out}, 'all rights reserved\.?', ' ', 'g')"
    out = rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
    out = f"' ' || replace({out}, ' ', '  ') || ' '"
    for ours, theirs in EQUIVALENT_SPELLINGS:
        out = f"replace({out}, '{spaced(theirs)}', '{spaced(ours)}')"
    out = f"replace({out}, '  ', ' ')"
    return f"trim({out}, ' ')"


def op8_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in KNOWN_LICENSES.items())
    told = ", ".join(f"('{v}', '{k}')" for k, v in KNOWN_DIGESTS.items())
    return f"""
WITH known(license_id, license_text) AS (VALUES {rows}),
digests AS (SELECT sha256({sql_canonical("license_text")}) AS d, string_agg(license_id, ',' ORDER BY license_id) AS licenses FROM known GROUP BY 1 UNION ALL SELECT * FROM (VALUES {told}) t(d, licenses)),
docs AS (SELECT doc_id, {sql_canonical("text")} AS c FROM documents)
SELECT doc_id, sha256(c) AS canonical_digest, length(c)::BIGINT AS canonical_chars, CASE WHEN length(c) > 0 THEN licenses END AS licenses
FROM docs LEFT JOIN digests ON sha256(c) = d
"""
