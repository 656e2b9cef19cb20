"""The pipeline on odd rows."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sequence_id long, fp long, kept boolean"


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return corpus_pipeline.run(spark, str(tmp_path)).collect()


def prose(k, n=60):
    words = "the house and garden of this man by a river are old but good for all who live there in summer".split()
    return " ".join(words[(k * 7 + j * (k % 5 + 1) + j * j) % len(words)] + ("" if j % 9 else f"n{k}") for j in range(n))


def test_odd_rows(spark, tmp_path):
    texts = [prose(k) for k in range(12)]
    near = texts[0] + " and this is the end of it"
    rows = [(k, t, "en", "a.org", 1, 5, 6, True) for k, t in enumerate(texts)]
    rows += [(20, near, "en", "a.org", 1, 5, 6, True), (21, texts[3].upper(), "en", None, None, None, None, None), (22, None, "en", "a.org", 0, 1, 1, False), (23, " \n", None, "a.org", 2, 1, 1, False), (24, "", "", "", 0, 1, 1, False)]
    rows += [(4, texts[4], "en", "a.org", 1, 5, 6, True)] * 3 + [(None, prose(40), "en", "a.org", 1, 5, 6, True), (30, prose(50, 9000), None, "a.org", 1, 5, 6, True)]
    got = run(spark, tmp_path, rows)
    kept = [0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 21, 30]  # of copies the largest id stays, of near ones the smallest
    assert sorted({r.doc_id for r in got if r.doc_id is not None}) == kept and any(r.doc_id is None for r in got)
    assert {r.doc_id: sum(x.piece == 0 for x in got if x.doc_id == r.doc_id) for r in got} == dict.fromkeys([*kept, None], 1)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_clashing_names_and_a_very_long_text(spark, tmp_path):
    names = ["__id", "__key", "__rid", "__other", "node", "key", "band", "bands", "part", "delta", "bucket", "rid", "block", "piece", "length", "rows", "kept"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    texts = [prose(k) for k in range(6)] + [prose(70, 150_000)]
    rows = [(k, t, "en", "a.org", len(t), *names) for k, t in enumerate(texts)] + [(9, texts[0] + " and that is all of it", "en", "a.org", 1, *names), (10, texts[1], "en", "a.org", 1, *names)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in got}) == [0, 2, 3, 4, 5, 6, 10]
    long = sorted((r for r in got if r.doc_id == 6), key=lambda r: r.piece)
    assert len(long) > 50 and [r.start for r in long] == [2048 * k for k in range(len(long))]
