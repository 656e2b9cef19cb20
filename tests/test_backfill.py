"""Vectors brought up to date: what is pending, and restarts that lose and repeat nothing."""

import hashlib

import pandas as pd

from dockmill.streaming import backfill as b


def counted(log):
    """An embedder that writes down every text it is asked for."""

    def embed(texts: pd.Series) -> list:
        with open(log, "a", encoding="utf-8") as f:
            f.writelines(f"{t}\n" for t in texts)
        return [[len(t), 1.0] for t in texts]

    return embed


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pending(spark):
    rows = spark.createDataFrame([("a", "same"), ("b", "changed"), ("c", "new"), ("d", " "), ("e", None), ("f", "no vector"), ("g", "other model"), ("h", "no dims")], "id string, text string")
    ledger = spark.createDataFrame(
        [("a", sha("same"), "p", "m", 1, [1.0]), ("b", sha("old"), "p", "m", 1, [1.0]), ("f", sha("no vector"), "p", "m", 1, None), ("g", sha("other model"), "p", "x", 1, [1.0]), ("h", sha("no dims"), "p", "m", 0, [1.0])], b.VECTORS
    )
    assert {r.id for r in b.pending(rows, ledger, "p", "m").collect()} == {"b", "c", "f", "g", "h"}
    assert {r.id for r in b.pending(rows, ledger, "p", "m", force=True).collect()} == {"a", "b", "c", "f", "g", "h"}
    assert {r.id for r in b.pending(rows, ledger.where("false"), "p", "m").collect()} == {"a", "b", "c", "f", "g", "h"}


def test_a_stopped_job_goes_on(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "work")
    rows = spark.createDataFrame([(str(k), f"text {k}") for k in range(100)], "id string, text string")
    ledger = spark.createDataFrame([(str(k), sha(f"text {k}" if k < 5 else "old"), "p", "m", 2, [0.0, 0.0]) for k in range(10)] + [("gone", "x", "p", "m", 2, [9.0, 9.0])], b.VECTORS)
    options = {"provider": "p", "model": "m", "batch_rows": 20}
    merged, left = b.backfill(rows, ledger, folder, counted(log), most=2, **options)
    assert left == 3
    first = {r.id for r in merged.where("vector[1] = 1").collect()}
    changed = spark.createDataFrame([(str(k), f"text {k}" if k != 50 else "changed meanwhile") for k in range(100)], "id string, text string")
    merged, left = b.backfill(changed, ledger, folder, counted(log), **options)
    assert left == 0
    got = {r.id: r for r in merged.collect()}
    assert len(got) == merged.count() == 101 and first and all(got[i].vector[1] == 1 for i in first)
    assert all(got[str(k)].vector == [len(f"text {k}"), 1.0] for k in range(5, 100)) and got["3"].vector == [0.0, 0.0] and got["gone"].vector == [9.0, 9.0]
    asked = open(log, encoding="utf-8").read().split("\n")[:-1]
    assert sorted(asked) == sorted(f"text {k}" for k in range(5, 100))  # each once
    again, left = b.backfill(changed, merged, str(tmp_path / "next"), counted(log), **options)
    assert left == 0 and {r.id: r.content_hash for r in again.collect()}["50"] == sha("changed meanwhile")
    assert open(log, encoding="utf-8").read().split("\n")[-2:] == ["changed meanwhile", ""]


def test_a_batch_that_failed_is_repeated_whole(spark, tmp_path):
    folder = str(tmp_path / "work")
    rows = spark.createDataFrame([(str(k), "x") for k in range(10)], "id string, text string")
    none = spark.createDataFrame([], b.VECTORS)

    def broken(texts):
        raise RuntimeError("stopped")

    try:
        b.backfill(rows, none, folder, broken, provider="p", model="m")
        raise AssertionError
    except Exception as e:
        assert "stopped" in str(e)
    assert not b.committed(spark, f"{folder}/done/0") and b.committed(spark, f"{folder}/plan")
    merged, left = b.backfill(rows, none, folder, lambda t: [[1.0]] * len(t), provider="p", model="m")
    assert (merged.count(), left) == (10, 0)


def test_nothing_to_do(spark, tmp_path):
    none = spark.createDataFrame([], b.VECTORS)
    merged, left = b.backfill(spark.createDataFrame([], "id string, text string"), none, str(tmp_path / "work"), lambda t: [], provider="p", model="m")
    assert merged.count() == left == 0
