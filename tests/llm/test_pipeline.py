"""The pipeline's stages against brute force, and its handling of odd rows."""

import corpus_pipeline
from tests.llm.test_operators import DOCS, brute_groups, brute_repeats, many_labelled, messy_rows, words


def test_stages(spark, tmp_path):
    rows = messy_rows()
    passage = " ".join(rows[7].text.split()[3:20])
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(r.doc_id, 1, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([tuple(r) for r in rows], DOCS)
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == len(rows)  # all labels are good

    once = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert once.columns == docs.columns and once.count() == len(brute_groups(rows)[1])

    now = once.collect()
    cut = stages["substrings"](spark, once, str(tmp_path))
    want = brute_repeats([(r.text or "").encode() for r in now])
    left = [(repr(r.doc_id), n - removed) for r, (n, removed, _, _) in zip(now, want, strict=True) if removed == 0 or removed < n]
    assert sorted((repr(r.doc_id), len((r.text or "").encode())) for r in cut.collect()) == sorted(left)
    assert cut.columns == docs.columns and all(r.n_chars == len(r.text) for r in cut.collect())

    clean = stages["decontaminate"](spark, docs, str(tmp_path))
    item = words(passage)
    windows = {tuple(item[a : a + 10]) for a in range(len(item) - 9)}
    texts = [words(r.text) for r in rows]
    gone = [t for t in texts if any(tuple(t[b : b + 10]) in windows for b in range(len(t) - 9))]
    assert len(gone) >= 1 and clean.count() == len(rows) - len(gone) and clean.columns == docs.columns

    tokens = stages["sentencepiece"](spark, docs, str(tmp_path))
    assert tokens.count() == len(rows)
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0


def test_run_chains_the_stages(spark, tmp_path):
    """The chained run on its own output: each stage's brute force on what the one before it kept."""
    import sentencepiece

    from sediment.llm import sentencepiece_scan

    rows = [r for r in messy_rows() if r.doc_id is not None and r.doc_id < 56]
    passage = " ".join(rows[7].text.split()[3:20])
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(r.doc_id, 1, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([tuple(r) for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    _, groups = brute_groups(rows)  # all labels are good, so all rows come here
    kept = []
    for group in groups.values():
        kept.append(rows[min(group, key=lambda i: rows[i].doc_id)])
    data = [(r.text or "").encode() for r in kept]
    left = {}
    for r, x, (n, removed, _, _) in zip(kept, data, brute_repeats(data), strict=True):
        if removed == 0 or removed < n:
            left[r.doc_id] = (r, n - removed)
    item = words(passage)
    windows = {tuple(item[a : a + 10]) for a in range(len(item) - 9)}
    kernel = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.MODEL_PATH)
    want = {}
    for i, (r, size) in left.items():
        if size != len((r.text or "").encode()):
            continue  # cut texts: only that they are there is checked below
        t = words(r.text)
        if not any(tuple(t[b : b + 10]) in windows for b in range(len(t) - 9)):
            want[i] = kernel.encode(r.text or "")
    assert want and all(got[i].tokens == t for i, t in want.items())
    assert set(got) <= set(left) and set(got) >= set(want)


def test_first_stage_uses_every_label(spark, tmp_path):
    docs, labels, _, k = many_labelled(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert dict(corpus_pipeline.STAGES)["quality"](spark, docs, str(tmp_path)).count() == k
