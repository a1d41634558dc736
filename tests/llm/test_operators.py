"""Every operator against brute force, on tables with nulls, ties, copies, empties and clashing columns."""

import base64
import hashlib
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sediment.llm import components, decontaminate, language_id, language_model, licenses, media, near_duplicates, quality, sentencepiece_scan, substrings, warc
from sediment.llm.common import maybe_among, scratch_path
from sediment.llm.license_texts import KNOWN_LICENSES

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())]
                  + [StructField(c, StringType()) for c in ("_k1", "data", "words", "digest", "row", "rep")])
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(ascii_lower(text or ""))


def prose(rng, n, lang="en"):
    parts = {"en": ["the", "and", "ing", "er", "on", "th", "ea"], "fr": ["eau", "é", "tion", "que", "ou", "ç"], "de": ["ung", "sch", "ü", "ei", "pf", "heit"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(n))


def messy_rows():
    rng = random.Random(5)
    out = []
    for i in range(40):
        lang = ("en", "fr", "de")[i % 3]
        out.append((i, prose(rng, rng.randint(30, 120), lang), lang))
    base = out[3][1].split(" ")
    for i in range(40, 46):  # near copies
        edited = list(base)
        edited[rng.randrange(len(edited))] = "changed"
        out.append((i, " ".join(edited), "en"))
    passage = prose(rng, 60)
    out += [(46, out[5][1], "de"), (46, out[5][1], "de"), (47, out[5][1], None)]  # copies, a repeated row
    out += [(48, prose(rng, 40) + " " + passage, "en"), (49, passage + "\n" + prose(rng, 30), "en"), (50, passage, "en")]
    out += [(51, None, "en"), (None, None, None), (52, "", "fr"), (53, "one two", "en"), (54, " \n\t", "en"), (55, "!!! ???", "en"), (None, prose(rng, 20), "en")]
    out += [(56, prose(rng, 9000), "en"), (57, "a" * 3000, "en"), (58, "x" * 700 + "\n" + "x" * 650, "en"), (59, "ONE Two three, FOUR five; six", "en")]
    return [Row(doc_id=i, text=t, lang=lang, source="s", n_chars=len(t or ""), **{c: "clash" for c in DOCS.names[5:]}) for i, t, lang in out]


@pytest.fixture(scope="module")
def rows():
    return messy_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def table(df, *key):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_decontaminate(spark, docs, rows, empty):
    rng = random.Random(1)
    texts = [r.text for r in rows if r.text]
    items = [(i, " ".join(t.split()[5:40])) for i, t in enumerate(texts[:6])] + [(10, "one two"), (11, "Three, four FIVE"), (12, None), (13, ""), (14, texts[0]), (14, texts[0]), (15, prose(rng, 9)), (16, "TWO")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(i)
    want = []
    for r in rows:
        w, hit, found = words(r.text), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if got := windows.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    found |= got
        want.append((r.doc_id, len(w), len(hit), len(found), ",".join(sorted(map(str, found)))))
    got = decontaminate.contamination(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", F.array_join("item_ids", ","))
    assert table(got) == sorted(want, key=repr)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def brute_repeats(data, length=200):
    seen = {}
    for x in data:
        for i in range(len(x) - length + 1):
            seen[x[i : i + length]] = seen.get(x[i : i + length], 0) + 1
    out = []
    for x in data:
        mask = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                mask[i : i + length] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~mask])
        out.append((len(x), int(mask.sum()), int((np.diff(mask.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings(docs, rows, empty):
    data = [(r.text or "").encode() for r in rows]
    want = [(r.doc_id, *x) for r, x in zip(rows, brute_repeats(data), strict=True)]
    got = substrings.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert table(got) == sorted(want, key=repr)
    assert substrings.remove_repeats(empty).count() == 0


def local_repeats(data, length, parts=3, chunks=4):
    """The rounds of the operator without Spark: (removed bytes, spans, digest) of each text."""
    cut = [list(range(i, len(data), chunks)) for i in range(chunks)]
    blobs = []
    for own in cut:
        n = len(own)
        batch = pa.RecordBatch.from_arrays([pa.array([data[i] for i in own], pa.binary()), pa.array(own, pa.int64()), pa.array([0] * n, pa.int64()), pa.array([0] * n, pa.int64())], names=["data", "doc_id", "_k1", "_k2"])
        blobs += list(substrings.gather([batch]))
    chunk_rows = pa.Table.from_batches(blobs)
    known = chunk_rows

    def answers(asked, answer):
        asked = pa.concat_tables(asked)
        out = []
        for kind, part in sorted(set(zip(asked["kind"].to_pylist(), asked["part"].to_pylist(), strict=True))):
            mine = asked.filter((pa.compute.field("kind") == kind) & (pa.compute.field("part") == part))
            out.append(answer((pa.scalar(kind), pa.scalar(part)), mine))
        return out

    def each(function):
        return [function(None, known.filter(pa.compute.field("chunk") == c)) for c in chunk_rows["chunk"].to_pylist()]

    first = [pa.Table.from_batches([b]) for b in substrings.round_0(length, parts)(blobs)]
    known = pa.concat_tables([known, *answers(first, substrings.repeats.__globals__["answer_repeats"])])
    known = pa.concat_tables([known, *answers(each(substrings.round_1(length, parts)), substrings.splits.__globals__["answer_splits"])])
    known = pa.concat_tables([known, *answers(each(substrings.round_2(length, parts)), substrings.repeats.__globals__["answer_repeats"])])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for t in each(substrings.cut_out(length, parts, False)) for r in t.to_pylist()}
    return [got[i] for i in range(len(data))]


@pytest.mark.parametrize("length, bits", [(200, 64), (200, 9), (200, 4), (64, 64), (64, 6), (130, 64), (260, 64), (300, 8), (520, 64)])
def test_substrings_are_told_by_their_bytes(monkeypatch, length, bits):
    rng = random.Random(length + bits)
    own = substrings.joined
    # identifiers of few bits make different strings meet in buckets of every round
    monkeypatch.setattr(substrings, "joined", lambda *a: own(*a) & np.uint64(((1 << bits) - 1) << (64 - bits)) if bits < 64 else own(*a))
    parts = [bytes(rng.randrange(256) for _ in range(rng.randint(0, 2 * length))) for _ in range(8)]
    data = [b"".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) + bytes(rng.randrange(256) for _ in range(rng.randint(0, 40))) for _ in range(25)] + [b"x" * (2 * length + 7), b"", b"ab" * length]
    assert local_repeats(data, length) == brute_repeats(data, length)


def test_substrings_in_small_stretches():
    rng = random.Random(2)
    alphabet = b"ab"
    parts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(6)]
    data = [b"".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for _ in range(30)]
    chunk = substrings.Chunk(substrings.pack(b"\0".join(data) + b"\0", np.array([len(x) for x in data], np.int64)), 200)
    anchors = {}
    for size in (300, 1000, 1 << 17):
        for *_, p, first, last, _, _ in chunk.stretches(size):
            for a, b, c in zip(p, first, last, strict=True):
                for s in range(b, c + 1):
                    assert anchors.setdefault(s, a) == a  # where a stretch begins does not matter


def test_substrings_makes_identifiers_once_a_round(monkeypatch):
    rng = random.Random(3)
    data = [bytes(rng.randrange(256) for _ in range(500)) for _ in range(6)] * 2
    made, own = [], substrings.Text

    class Counted(own):
        def __init__(self, *a):
            made.append(len(a[0]))
            super().__init__(*a)

    monkeypatch.setattr(substrings, "Text", Counted)
    assert local_repeats(data, 200, chunks=3) == brute_repeats(data, 200)
    assert len(made) == 4 * 3  # one stretch a chunk and round


def brute_groups(rows, threshold=0.8):
    sets = []
    for r in rows:
        w = words(r.text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n, links, parent = len(rows), [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if union and len(sets[i] & sets[j]) / union >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    groups = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(i)
    return links, groups


def test_near_duplicates(docs, rows, empty):
    links, groups = brute_groups(rows)
    got = near_duplicates.near_duplicates(docs).collect()
    assert sorted((repr(r.doc_id), r.n_links) for r in got) == sorted((repr(r.doc_id), k) for r, k in zip(rows, links, strict=True))
    by_group = {}
    for r in got:
        by_group.setdefault((r.group_id, None if r.n_links else r._k2), []).append(r)
    want = sorted(sorted(repr(rows[i].doc_id) for i in g) for g in groups.values() if len(g) > 1)
    assert sorted(sorted(repr(r.doc_id) for r in g) for g in by_group.values() if g[0].n_links) == want
    assert all(len({(r._k1, r._k2) for r in g if r.keep}) == 1 for g in by_group.values() if g[0].n_links)
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_near_duplicates_of_components_in_many_blocks(spark, monkeypatch):
    rng = random.Random(12)
    bases = [prose(rng, 40).split(" ") for _ in range(3)]
    texts = []
    for k in range(120):
        edited = list(bases[k % 3])
        for _ in range(rng.randint(0, 4)):
            edited[rng.randrange(len(edited))] = rng.choice("abcdef")
        texts.append(" ".join(edited))
    made = [(k if k % 7 else None, t) for k, t in enumerate(texts)] + [(None, "alone without an id"), (None, "words that nobody else has"), (-1, texts[0])]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    rows = [Row(doc_id=i, text=t) for i, t in made]
    links, groups = brute_groups(rows)
    least = {}
    for group in groups.values():
        ids = [rows[k].doc_id for k in group if rows[k].doc_id is not None]
        least |= {k: min(ids) if ids else None for k in group}
    want = sorted((repr(r.doc_id), r.text, repr(least[k]), links[k]) for k, r in enumerate(rows))
    for block, size in ((5, 16 << 20), (1000, 4000), (1000, 16 << 20)):
        monkeypatch.setattr(near_duplicates, "BLOCK", block)
        monkeypatch.setattr(near_duplicates, "BLOCK_BYTES", size)
        got = near_duplicates.near_duplicates(docs)
        assert sorted((repr(r.doc_id), repr(r.group_id), r.n_links) for r in got.collect()) == sorted((i, g, n) for i, _, g, n in want)
        assert got.filter("keep").count() == len(groups)


def test_filter_of_keys_loses_none(spark):
    rows = spark.range(5000).selectExpr("id as a", "if(id % 5 = 0, null, id) as b")
    members = rows.filter("a % 100 < 3")
    few = maybe_among(rows, members, ["a", "b"], 20)
    assert few.join(members, ["a"], "left_semi").count() == members.count() and few.count() < 400 and few.columns == ["a", "b"]
    assert maybe_among(rows, members, ["a", "b"], 6).join(members, ["a"], "left_semi").count() == members.count()


def test_pruning_keeps_true_pairs():
    # a pair at the threshold fails a step with a probability of the order of the tolerance
    for n, need in zip(range(32, 161, 32), near_duplicates.fewest_matches(), strict=True):
        assert sum(math.comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(need)) < 1e-8


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (102, 101), (7, 7), (100, 101)] + [(200 + i, 200) for i in range(1, 40)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(31)) and {got[100], got[101], got[102]} == {100} and all(got[200 + i] == 200 for i in range(40))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_warc(spark):
    pages = [(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (None, "u", "zé"), (6, "u", "zé"), (7, "v", "only\r\n\r\nWARC/1.1"), (7, "v", "only\r\n\r\nWARC/1.1"), (8, "w", "y" * 100_000)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    folder = scratch_path(spark, "warc-test")
    index = warc.write_bundles(warc.link_revisits(df), folder, frame_bytes=200, bundle_bytes=1000)
    assert {f.dataType.simpleString() for f in index.schema if f.name != "frame"} == {"bigint", "string"}
    reps = {}
    for p, _, h in pages:
        reps[h or ""] = max(reps.get(h or "", -1), -1 if p is None else p)
    want = []
    for p, _, h in pages:
        data, rep = (h or "").encode(), reps[h or ""]
        revisit = rep != p
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", rep if revisit else None))
    got = warc.read_bundles(spark, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert table(got) == sorted(want, key=repr)
    for (bundle, own), n in index.groupBy("bundle", "record_id").count().select(F.struct("bundle", "record_id"), "count").collect():  # by identifier, through the footer
        found = warc.read_records(bundle, own)
        assert len(found) == n and {h["WARC-Record-ID"] for h, _ in found} == {own}
    broken = index.filter("page_id = 8").first()
    path = broken.bundle.removeprefix("file://")
    with open(path, "rb") as file:
        data = bytearray(file.read())
    zstd = __import__("zstandard")
    plain = zstd.ZstdDecompressor().decompress(bytes(data[broken.frame_offset : broken.frame_offset + broken.frame_bytes])).replace(b"yyyy", b"zyyy", 1)
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(*warc.decode_record(plain, broken.record_offset))
    assert warc.read_bundles(spark, warc.write_bundles(warc.link_revisits(df.limit(0)), folder)).count() == 0
    large = warc.link_revisits(df, min_bytes=5)
    assert large.filter("is_revisit").count() == 1


def test_language_model(docs, rows, empty):
    fold = F.when(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False)), 1).when(F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False)), 2).otherwise(0)
    got = language_model.score_documents(docs, fold).collect()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or "")) + [""]
    train = [t for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1 for t in split(r.text)]
    counts = {}
    for t in train:
        counts[t] = counts.get(t, 0) + 1
    n, v = len(train), len(counts)
    want = sorted((repr(r.doc_id), len(split(r.text)), sum(t in counts for t in split(r.text)), round(sum(math.log10((counts.get(t, 0) + 0.5) / (n + 0.5 * (v + 1))) for t in split(r.text)), 6)) for r in rows)
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    assert language_model.score_documents(empty, fold).count() == 0


def test_language_model_is_a_distribution_and_learns():
    hist = [(3, 0, 80.0, 80.0 * 50), (3, -9999, 20.0, 0.0)]
    w = language_model.em_weights(hist)
    assert 0.7 < w[3] < 0.85 and w[5] == w[3] and w[0] == 0


def test_media(docs, rows, empty, spark):
    got = {}
    folder = scratch_path(spark, "media-test")
    for r in media.media_columns(docs, folder).collect():
        got.setdefault(r.n_bytes, []).append(r)
    for r in rows:
        data = (r.text or "").encode()
        padded = data + bytes(-len(data) % 64 or (64 if not data else 0))
        mine = [g for g in got[len(data)] if g.payload_sha256 == hashlib.sha256(padded).hexdigest()]
        assert mine and all((g.payload_bytes, g.tail_crc32, g.width, g.height) == (len(padded), zlib.crc32(padded[-64:]), 64, len(padded) // 64) for g in mine)
        assert len({(g.media_sha256, g.feature, g.media_bytes) for g in mine}) == 1
    assert sum(map(len, got.values())) == len(rows)
    some = media.canonical(media.store(docs, folder))
    for r in media.read_headers(some).collect():  # header bytes alone
        with open(r.shard.removeprefix("file://"), "rb") as file:
            file.seek(r.offset)
            stored = file.read(r.length)
        samples = media.decode_png(stored)
        assert (r.width, r.height, r.bit_depth) == media.read_header(stored[:33]) == (64, len(samples) // 64, 8)
        assert hashlib.sha256(samples).digest() == r.digest
    assert media.media_columns(empty, folder).count() == 0


def test_licenses(spark, docs, rows, empty):
    mit = KNOWN_LICENSES["MIT"]
    texts = [("a", mit.upper()), ("b", "// Copyright (c) 2020 Someone\n" + mit.replace("\n", "\n * ").replace("Software", "software")), ("c", mit + " more"), ("d", KNOWN_LICENSES["ISC"].replace("license", "licence")), ("e", None), ("f", ""), ("g", "©2001 x\nAll rights reserved.\n" + KNOWN_LICENSES["Zlib"].replace("acknowledgment", "acknowledgement"))]
    df = spark.createDataFrame([(k, t, "x") for k, t in texts], "doc_id string, text string, c string")
    got = {r.doc_id: r.licenses for r in licenses.scan(df).collect()}
    assert got == {"a": "MIT", "b": "MIT", "c": None, "d": "ISC", "e": None, "f": None, "g": "Zlib"}
    assert licenses.scan(docs).count() == len(rows) and licenses.scan(empty).count() == 0


def test_wrapped_licenses_are_found(spark):
    texts = []
    for name, text in KNOWN_LICENSES.items():
        for case in (str, str.upper):
            for width in range(30, 101, 5):
                body = "\n".join(textwrap.fill(line, width, break_long_words=False, break_on_hyphens=False) for line in case(text).split("\n"))
                texts += [(name, body), (name, f"Copyright (c) 2020-2024 Some One\n\n{body}")]
    df = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(texts))] == [name for name, _ in texts]


def test_long_licenses_by_digest(spark):
    import pathlib

    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "Artistic": "Artistic-1.0-Perl"}
    folder = pathlib.Path("/usr/share/common-licenses")
    if not all((folder / n).is_file() for n in names):
        pytest.skip("texts are not there")
    texts = {n: (folder / n).read_text() for n in names}
    rows = [(i, v, n) for n, t in texts.items() for i, v in ((names[n], t), (names[n], "# " + "\n# ".join(t.split("\n"))), (names[n], " ".join(t.upper().split()) if "opyright" not in t else t.replace("\n", "\r\n")), (None, t + "\nAnd one more clause."))]
    got = licenses.scan(spark.createDataFrame([(k, v) for k, (_, v, _) in enumerate(rows)], "doc_id long, text string")).select("doc_id", "licenses").collect()
    assert {r.doc_id: r.licenses for r in got} == {k: i for k, (i, _, _) in enumerate(rows)}


def test_license_sql_agrees_on_planted_texts(spark):
    import duckdb

    lines = ["Copyright (c) 2020 Some One", "copyright notice and this permission notice", "Copyright Holder Inc", "Copyright notice and this list", "(c) You must give any other recipients", "(c) 2019 Somebody", "(c) Jane Doe <j@x.org>", "© Jane", "  # Copyright 2001, 2002 A. B.", "COPYRIGHT HOLDERS BE LIABLE", "Copyright", "(C) Copyright Foo Bar", "copyright: 1999 x", "Copyright\u2028next", "Copyright in the work", "Copyright [yyyy] [name of copyright owner]", "plain", ""]
    texts = [*lines, *(f"{a}\n{t}\r\n{a}" for a in lines for t in KNOWN_LICENSES.values()), None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.canonical_digest, r.licenses) for r in licenses.scan(docs).collect()}
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(licenses.op8_sql()).fetchall()
    assert got == {r[0]: (r[1], r[3]) for r in want}
    assert sum(v[1] is not None for v in got.values()) > 20


def test_copyright_notices_and_other_lines(spark):
    notices = ["Copyright 2020 x", "copyright (c) some one", "# Copyright The Foo Authors", "Copyright Jane Doe <j@d.e>", "COPYRIGHT JANE DOE", "(c) 2020 y", "(C) Copyright 1999 z", " * (c) Jane Doe", "© me", "Copyright [yyyy] [name]", "Copyright © 2001 a", "copyright: 1999, b", "Copyright (c) <year> <owner>"]
    others = ["copyright notice and this permission notice appear in all copies.", "COPYRIGHT HOLDERS BE LIABLE", "copyright laws, the author", "copyright the software, and", "(c) You must retain, in the source form,", "(c) copyright notices must stay", "Copyright and related rights", "copyrighted works"]
    df = spark.createDataFrame([(x,) for x in notices + others], "text string")
    got = {r.text: r.c for r in df.select("text", licenses.canonical(F.col("text")).alias("c")).collect()}
    assert [x for x in notices if got[x]] == [] and [x for x in others if not got[x]] == []


def test_language_id(spark, docs, rows, empty):
    held = F.coalesce(F.col("doc_id") % 4 == 2, F.lit(False))
    got = language_id.identify(docs, held).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by_id[i].lang_pred == ("en", "fr", "de")[i % 3] for i in range(40))
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (51, 52, 54, 55))
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(empty, held).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")), held).collect()} == {"und"}


def test_language_is_learned_from_whole_texts():
    rng = random.Random(5)
    header = prose(rng, 300, "en")
    model = language_id.fit([(f"{header} {prose(rng, 60, lang)}", lang) for lang in ("fr", "de") for _ in range(20)])
    texts = [(prose(rng, 40, lang), lang) for lang in ("fr", "de") for _ in range(20)]
    names, _ = language_id.predict(model, pa.array([text for text, _ in texts]))
    assert names == [lang for _, lang in texts]


def test_language_training_sequences_use_every_word():
    rows = [([f"w{i}x{j}" for j in range(37 + 11 * i)], i % 2) for i in range(9)]
    got = language_id.spliced(rows, np.random.default_rng(1))
    assert {w for s, _ in got for w in s} == {w for r, _ in rows for w in r}
    assert all(len(s) == len(y) == language_id.SEQUENCE for s, y in got)


def test_every_language_of_the_training_rows_is_a_label(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 12, "en"), "en") for i in range(12000)] + [(21000 + i, prose(rng, 12, "fr"), "fr") for i in range(5)]
    rows += [(None, "die gleiche Zeile", "de")] * 7000 + [(30000 + i, prose(rng, 12, "de"), "de") for i in range(300)]
    rng.shuffle(rows)
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    sample = language_id.training_rows(known)
    counts = {lang: sum(lang == got for _, got in sample) for lang in ("en", "fr", "de")}
    assert counts["fr"] == 5 and counts["de"] == 301 and abs(counts["en"] - 2694) <= 60
    assert len(sample) <= language_id.TRAIN_DOCS and sample == language_id.training_rows(known.coalesce(1))
    texts = [prose(rng, 30, "fr") for _ in range(20)]
    asked = spark.createDataFrame([(40000 + i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").unionByName(known)
    got = language_id.identify(asked, F.coalesce(F.col("doc_id") >= 40000, F.lit(False)))
    assert {r.lang_pred for r in got.filter("doc_id >= 40000").collect()} == {"fr"}


def test_fair_share():
    assert language_id.fair_share([5, 2000, 9000], 3000) == 1497
    assert language_id.fair_share([10, 20], 3000) == 20
    assert language_id.fair_share([9] * 50, 20) == 1


def test_code_switching_and_forward_backward():
    rng = random.Random(3)
    model = language_id.fit([(prose(rng, 100, lang), lang) for lang in ("en", "fr", "de") for _ in range(15)])
    text = prose(rng, 15, "en") + " " + prose(rng, 15, "de")
    _, _, m = language_id.label_words(model, pa.array([text]))
    picked = [model.labels[i] for i in m.argmax(axis=1)]
    assert sum(a == b for a, b in zip(picked, ["en"] * 15 + ["de"] * 15, strict=True)) >= 27
    gen = np.random.default_rng(0)
    emit, first = gen.random((400, 3)) + 0.01, np.zeros(400, bool)
    first[[0, 5, 130, 256, 399]] = True
    start, move = gen.random(3) + 0.1, gen.random((3, 3)) + 0.1
    got = language_id.forward_backward(emit, first, start, move)
    for a, b in zip(np.flatnonzero(first), [*np.flatnonzero(first)[1:], 400], strict=True):
        alpha = [start * emit[a]]
        for t in range(a + 1, b):
            alpha.append((alpha[-1] / alpha[-1].sum()) @ move * emit[t])
        beta = [np.ones(3)]
        for t in range(b - 1, a, -1):
            beta.append(move @ (emit[t] * beta[-1]) / beta[-1].sum())
        want = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True))


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(r.doc_id, 0 if r.doc_id in (57, 58) else 1, 0) for r in rows if r.doc_id is not None] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.resample(docs, labels).collect()
    assert len(got) == len(rows)
    table_, want = quality.TokenTable(), {}
    at, ids = quality.features(pa.array(["a b A, b", None, ""]), table_, 100)
    assert set(at.tolist()) == {0} and len(ids) == 4 + 3 + 4 + 3 + 2
    keys = sorted(((r.gumbel_key, -r._k1, -r._k2) for r in got), reverse=True)
    kept = {(r.gumbel_key, -r._k1, -r._k2) for r in got if r.selected}
    assert kept == set(keys[: len([r for r in got if r.selected])])
    assert all(r.log_weight == 0 for r in got if r.doc_id in (51, 52, 54))
    assert quality.resample(empty, labels).count() == 0
    assert quality.resample(docs, labels.limit(0)).filter("NOT selected").count() == 0


def brute_ngrams(text, buckets):
    """Buckets of all n-grams of a text, in plain integers."""
    whole = 1 << 64

    def mix(h):
        h = ((h ^ h >> 31) * 0x9E3779B97F4A7C15) % whole
        return (((h ^ h >> 29) * 0xBF58476D1CE4E5B9) % whole >> 33) % buckets

    tokens = (text or "").split()
    w = [zlib.crc32(t.lower().encode()) for t in tokens]
    z = [zlib.crc32(quality.shape(t).encode(), 7) for t in tokens]
    p, q = 0x1000003, 0x100000001B3
    out = [mix(x + (1 << 40)) for x in w] + [mix((x * p + y + (1 << 41)) % whole) for x, y in zip(w, w[1:], strict=False)]
    out += [mix(x + (1 << 42)) for x in z] + [mix((x * p + y + (1 << 43)) % whole) for x, y in zip(z, z[1:], strict=False)]
    return out + [mix((x * q + y * p + v + (1 << 44)) % whole) for x, y, v in zip(z, z[1:], z[2:], strict=False)]


def test_quality_by_brute_force(spark, docs, rows):
    import xxhash

    buckets = 500
    labels = {r.doc_id: 0 if r.doc_id % 3 == 1 else 1 for r in rows if r.doc_id is not None and r.doc_id % 2}
    got = quality.resample(docs, spark.createDataFrame([(i, v, 0) for i, v in labels.items()], "doc_id long, quality int, toxic int"), buckets=buckets).collect()
    grams = [brute_ngrams(r.text, buckets) for r in rows]
    target, raw = np.zeros(buckets), np.zeros(buckets)
    for r, g in zip(rows, grams, strict=True):
        raw += np.bincount(g, minlength=buckets)
        target += np.bincount(g, minlength=buckets) * (labels.get(r.doc_id, 0) > 0)
    ratio = np.log((target + 0.5) / (target.sum() + 0.5 * buckets)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * buckets))
    want = []
    for r, g in zip(rows, grams, strict=True):
        h = 42 if r.doc_id is None else xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little", signed=True), 42)
        u = ((xxhash.xxh64_intdigest((1).to_bytes(4, "little"), h) >> 12) + 0.5) / (1 << 52)
        weight = sum(ratio[x] for x in g)
        want.append((r.doc_id, weight, weight - math.log(-math.log(u))))
    order = lambda x: (repr(x[0]), round(x[1], 3))
    for (i, w, k), r in zip(sorted(want, key=order), sorted(got, key=lambda r: (repr(r.doc_id), round(r.log_weight, 3))), strict=True):
        assert r.doc_id == i and r.log_weight == pytest.approx(w, abs=1e-6) and r.gumbel_key == pytest.approx(k, abs=1e-6)
    first = {r.doc_id: r.log_weight for r in sorted(got, key=lambda r: -r.log_weight)}
    good, bad = ([first[i] for i, v in labels.items() if v == kind] for kind in (1, 0))
    values = sorted(set(good + bad))
    cost = [quality.GOOD_WORTH * sum(w < v for w in good) / len(good) + sum(w >= v for w in bad) / len(bad) for v in values]
    best = cost.index(min(cost))
    limit = values[best] if not best else (values[best] + values[best - 1]) / 2
    assert quality.threshold(np.array(good), np.array(bad)) == limit
    k = sum(r.log_weight >= limit for r in got)
    assert 0 < k < len(got)
    keys = sorted(got, key=lambda r: (-r.gumbel_key, r._k1, r._k2))
    kth = keys[k - 1]
    assert {(r._k1, r._k2) for r in got if r.selected} == {(r._k1, r._k2) for r in keys[:k]} | {(kth._k1, kth._k2)}


def many_labelled(spark):
    """(docs, labels, rows that stay): 20,600 good documents, of which the 600 last by a hash of the id have words of their own, and 900 bad ones."""
    n, buckets = 21_500, quality.BUCKETS
    hashed = [r.id for r in spark.range(n).filter("id >= 900").orderBy(F.xxhash64("id"), "id").collect()]
    late = set(hashed[20_000:])
    text = lambda i: f"junk word{i % 7}" if i < 900 else "Rare Words, here" if i in late else "common text"
    docs = [(i, text(i)) for i in range(n)]
    labels = [(i, int(i >= 900), 0) for i in range(n)]
    grams = {t: np.bincount(brute_ngrams(t, buckets), minlength=buckets) for t in {t for _, t in docs}}
    raw = sum(grams[t] for _, t in docs)
    target = sum(grams[t] for i, t in docs if i >= 900)
    ratio = np.log((target + 0.5) / (target.sum() + 0.5 * buckets)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * buckets))
    weight = {t: round(float(g @ ratio), 9) for t, g in grams.items()}
    limit = quality.threshold(np.array([weight[t] for i, t in docs if i >= 900]), np.array([weight[t] for i, t in docs if i < 900]))
    k = sum(weight[t] >= limit for _, t in docs)
    assert 20_600 <= k < n
    made = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return *made, {i: weight[t] for i, t in docs}, k


def test_quality_learns_from_every_label(spark):
    docs, labels, weight, k = many_labelled(spark)
    got = quality.resample(docs, labels).select("doc_id", "log_weight", "selected").collect()
    assert max(abs(weight[r.doc_id] - r.log_weight) for r in got) < 1e-6
    assert sum(r.selected for r in got) == k


def test_threshold_of_a_table(spark):
    gen = random.Random(6)
    for size, spread in ((1, 3), (40, 5), (500, 200)):
        good, bad = ([gen.randint(-spread, spread) / 7 + shift for _ in range(size)] for shift in (0.5, 0))
        told = spark.createDataFrame([(w, True) for w in good] + [(w, False) for w in bad], "w double, good boolean")
        for worth in (1, quality.GOOD_WORTH):
            assert quality.table_threshold(told, worth) == quality.threshold(np.array(good), np.array(bad), worth)
        assert quality.table_threshold(told.filter("good")) is None and quality.table_threshold(told.filter("NOT good")) is None


def test_largest_rows_with_ties(spark):
    gen = random.Random(4)
    values = [gen.choice([gen.randint(-(1 << 62), 1 << 62), gen.randint(-5, 5), 3]) for _ in range(300)]
    rows = [(v, i % 7, i * 7 % 31) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "o long, a long, b long")
    order = sorted(rows, reverse=True)
    for k in (1, 2, 57, 150, 299, 300, 400):
        got = sorted((tuple(r) for r in df.filter(quality.largest(df, ["o", "a", "b"], k)).collect()), reverse=True)
        least = order[min(k, 300) - 1]
        assert got == [r for r in order if r >= least]


def unigram_twin(model):
    """The same pieces with other scores and the model type set to unigram (for tests; nothing is trained)."""
    import struct

    def number(n):
        out = bytearray()
        while True:
            out.append(n & 127 | (128 if n > 127 else 0))
            n >>= 7
            if not n:
                return bytes(out)

    out, k = bytearray(), 0
    for field, value in sentencepiece_scan.fields(model):
        if field == 1:
            got, k = dict(sentencepiece_scan.fields(value)), k + 1
            value = number(10) + number(len(got[1])) + got[1] + number(21) + struct.pack("<f", -math.sqrt(k) / 20 - k * 7919 % 1009 / 1013) + (number(24) + number(got[3]) if 3 in got else b"")
        elif field == 2:
            body = bytearray()
            for f, v in sentencepiece_scan.fields(value):
                v = 1 if f == 3 else v
                body += number(f << 3) + number(v) if isinstance(v, int) else (number(f << 3 | 5) + v if len(v) == 4 and f in (10, 15) else number(f << 3 | 2) + number(len(v)) + v)
            value = bytes(body)
        out += number(field << 3 | 2) + number(len(value)) + value
    return bytes(out)


def encoded(vocab, text, size):
    marked = vocab.marked(text)
    if not marked:
        return []
    cuts = range(0, len(marked), size)
    chunks = [sentencepiece_scan.Chunk(vocab, marked[a : a + size], marked[max(0, a - vocab.longest) : a], marked[a + size : a + size + vocab.longest]) for a in cuts]
    ways = sentencepiece_scan.cut_states([c.matrix() for c in chunks])
    out = []
    for c, (a, b), middle in zip(chunks, ways, vocab.encode([c.middle_text() for c in chunks]), strict=True):
        first, last = c.trace(a, b)
        out += [*first, *np.frombuffer(middle, np.int32).tolist(), *last]
    return out


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_sentencepiece_scan(kind, rows):
    with open(sentencepiece_scan.MODEL_PATH, "rb") as file:
        model = file.read()
    vocab = sentencepiece_scan.Vocabulary(model if kind == "bpe" else unigram_twin(model))
    rng = random.Random(3)
    texts = [r.text[:800] for r in rows if r.text] + ["".join(rng.choice("abceht  \n▁é日\U0001f600") for _ in range(rng.randint(0, 150))) for _ in range(60)] + ["internationalization" * 15, " " * 60 + "x" + " " * 40, " "]
    kernel = sentencepiece.SentencePieceProcessor(model_proto=model if kind == "bpe" else unigram_twin(model))
    score = lambda ids: sum(kernel.get_score(i) for i in ids)
    whole = vocab.encode([vocab.marked(t) for t in texts])
    for text, tokens in zip(texts, whole, strict=True):
        want = kernel.encode(text)
        for got in (np.frombuffer(tokens, np.int32).tolist(), *(encoded(vocab, text, size) for size in (7, 64, 500))):
            assert got == want or kind == "unigram" and score(got) == pytest.approx(score(want), abs=1e-3)


def test_neighbours_are_what_merging_says():
    with open(sentencepiece_scan.MODEL_PATH, "rb") as file:
        vocab = sentencepiece_scan.Vocabulary(file.read())
    names, rng = sorted(vocab.piece_at, key=vocab.piece_at.get), random.Random(4)
    pairs = [(rng.randrange(len(names)), rng.randrange(len(names))) for _ in range(3000)]
    for name in rng.sample(names, 1000):  # pairs that merges meet
        pairs += [(vocab.piece_at[name[:i]], vocab.piece_at[name[i:]]) for i in range(1, len(name)) if name[:i] in vocab.piece_at and name[i:] in vocab.piece_at]
    told = vocab.neighbours_all(*(np.array(c) for c in zip(*pairs, strict=True)))
    for (a, b), fits in zip(pairs, told.tolist(), strict=True):
        assert fits == vocab.neighbours(names[a], names[b]) == (vocab.merged(names[a] + names[b]) == [names[a], names[b]])


def test_products_of_any_shape_give_the_same_states():
    rng = random.Random(6)
    states = [("", 0), ("a", 0), ("b", 1)]
    matrices = [{a: {b: float(rng.randint(-9, 0)) for b in states} for a in states} for _ in range(11)]
    matrices[0], matrices[-1] = {states[0]: matrices[0][states[0]]}, {a: {states[0]: row[states[0]]} for a, row in matrices[-1].items()}
    best = lambda ways: sum(m[a][b] for m, (a, b) in zip(matrices, ways, strict=True))
    ways = sentencepiece_scan.cut_states(matrices)
    assert all(x[1] == y[0] for x, y in zip(ways, ways[1:], strict=False))
    top = sentencepiece_scan.products(matrices)[-1][0]
    assert best(ways) == max(w for row in top.values() for w in row.values())


def test_sentencepiece_rows(docs, rows, empty, spark):
    kernel = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.MODEL_PATH)
    got = sentencepiece_scan.encode(docs, chunk=1000, fan=3).collect()
    want = [(repr(r.doc_id), kernel.encode(r.text or ""), r.text or "") for r in rows]
    assert sorted((repr(r.doc_id), r.tokens, r.decoded) for r in got) == sorted(want)
    digests = sentencepiece_scan.encode(docs, chunk=400, with_text=False).collect()
    sha = lambda data: hashlib.sha256(data).hexdigest()
    assert sorted((repr(r.doc_id), r.n_tokens, r.token_sha256, r.decoded_sha256, r.tokens) for r in digests) == sorted((i, len(t), sha(np.array(t, np.int32).tobytes()), sha(x.encode()), None) for i, t, x in want)
    assert sentencepiece_scan.encode(empty).count() == 0


def test_sentencepiece_of_giant_texts(spark):
    rng = random.Random(8)
    kernel = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.MODEL_PATH)
    texts = [prose(rng, 400_000), "".join(rng.choice("abcdeinrt中文字的一是é") for _ in range(30_000)), "\U0001f600" * 20_000, " " * 30_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in sentencepiece_scan.encode(docs).collect()}
    assert len(texts[0]) > 3_000_000
    for i, t in enumerate(texts):
        assert got[i].tokens == kernel.encode(t) and got[i].decoded == t
