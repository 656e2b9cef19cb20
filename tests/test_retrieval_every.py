"""Searches from every twentieth row against brute force, over several blocks."""

import numpy as np

from dockmill.operators import retrieval


def test_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((1500, 8))
    v[7] = v[40] = 0
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(9000, None)], "vec_id long, embedding array<double>")
    got = {}
    for r in retrieval.exact_neighbours(df, df.where("vec_id < 1500"), 5).collect():
        got.setdefault(r.query, {})[r["rank"]] = r.doc
    norms = np.linalg.norm(v, axis=1, keepdims=True)
    unit = np.vstack([np.divide(v, norms, out=np.zeros_like(v), where=norms > 0), np.zeros((1, 8))])
    ids = np.array([*range(1500), 9000])
    scores = np.round(unit[:1500] @ unit.T, 6) + 0.0
    assert len(got) == 1500
    for q in range(1500):
        want = [i for i in ids[np.lexsort((ids, -scores[q]))] if i != q][:5]
        assert [got[q][k] for k in range(1, 6)] == want


def test_queries_grow_with_the_table(spark):
    from dockmill.plans import retrieval as plans

    rows = plans.QUERIES["knn_cosine"](spark, "/root/testdata/sf0.01").select("query").distinct().collect()
    ids = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert len(rows) == ids > 20


def test_pairs_of_blocks_come_in_small_batches(spark):
    session = spark.newSession()
    rows = session.createDataFrame([(k, [float(k), 1.0]) for k in range(9)], "vec_id long, embedding array<double>")
    assert retrieval.exact_neighbours(rows, rows.where("vec_id = 3"), 2).count() == 2
    assert int(session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= 32 << 20
