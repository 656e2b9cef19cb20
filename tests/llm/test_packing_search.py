"""The local search on hard lengths and small exact cases, shards, and the query's rows against the library."""

import random
import time
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from dockmill.llm import packing, queries


def check(lengths, capacity=2048):
    bin_of, offset, room = packing.pack(lengths, capacity)
    held = {}
    for k, b in enumerate(bin_of):
        held.setdefault(b, []).append((offset[k], lengths[k], room[k]))
    for items in held.values():
        at = 0
        for o, n, _ in sorted(items):
            assert o == at
            at += n
        assert at <= capacity and {capacity - at} == {r for *_, r in items}
    return len(held)


def fewest(lengths, capacity):
    best = [len(lengths)]

    def rec(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[k] <= capacity:
                rec(k + 1, [*bins[:j], bins[j] + lengths[k], *bins[j + 1 :]])
        rec(k + 1, [*bins, lengths[k]])

    rec(0, [])
    return best[0]


def test_bound_and_packing_around_the_optimum():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.randint(5, 40)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        best = fewest(lengths, capacity)
        assert packing.least_bins(lengths, capacity) <= best <= check(lengths, capacity) <= best + 1


@pytest.mark.parametrize(("low", "high", "over"), [(1025, 2047, 1.0), (683, 720, 1.0), (600, 760, 1.035), (1, 2048, 1.01), (400, 1200, 1.02), (1, 20, 1.0)])
def test_hard_lengths_take_near_linear_time(low, high, over):
    rng = np.random.default_rng(1)
    began = time.process_time()
    lengths = rng.integers(low, high + 1, 20_000).tolist()
    assert check(lengths) <= over * packing.least_bins(lengths)
    assert time.process_time() - began < 30


def test_search_never_loses_and_steps_raise_squared_fill():
    rng = np.random.default_rng(3)
    lengths = rng.integers(300, 1500, 3000).tolist()
    seeds = [k // 1 for k in range(3000)]  # every piece alone
    bin_of, _, room = packing.pack(lengths, 2048, seeds)
    assert len({*bin_of}) < 0.75 * 3000
    again, _, _ = packing.pack(lengths, 2048, bin_of)
    assert len({*again}) <= len({*bin_of})


def test_shards_with_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 500)
    rows = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(1500).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    other = spark.range(20_000).select((F.col("id") + 8).alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("id") * 7919 % 2048 + 1).alias("length"), F.col("id").alias("ids_crc32"))
    packed = packing.pack_pieces(rows.unionByName(other)).withColumn("end", F.col("offset") + F.col("length"))
    by = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.countDistinct("offset").alias("places"))
    assert by.where("fill > 2048 or fill <> end or n <> places").count() == 0
    assert packed.count() == 120_000 and by.count() < 1.06 * packing.least_bins([r.length for r in packed.select("length").collect()])


def test_query_rows_equal_the_library(spark):
    from tokenizers import Tokenizer

    sf_dir = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(packing.default_vocabulary())
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[r.doc_id, k] = (at, len(part), zlib.crc32(array("I", part).tobytes()))
    got = queries.QUERIES["op1_packing"](spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    assert len({r.sequence_id for r in got}) <= packing.least_bins([r.length for r in got]) + 1
