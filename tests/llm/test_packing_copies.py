"""Packing of many equal rows."""

from pyspark.sql import functions as F

from dockmill.llm import packing


def test_copies_spread_over_shards(spark):
    n = 140_000
    same = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(2048).cast("long").alias("length"), F.lit(9).cast("long").alias("ids_crc32"))
    other = spark.range(40_000).select((F.col("id") + 2).alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(2048).cast("long").alias("length"), F.col("id").alias("ids_crc32"))
    packed = packing.pack_pieces(same.unionByName(other))
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    by = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.min("offset").alias("at"), F.count(F.lit(1)).alias("n"))
    assert by.agg(F.max("fill"), F.max("at"), F.max("n"), F.sum("n")).first()[:] == (2048, 0, 1, n + 40_000)
    packed = packed.withColumn("shard", F.shiftright(F.col("sequence_id") - F.when(F.col("sequence_id") >= 1 << 60, 1 << 60).otherwise(0), 32))
    sizes = [r["count"] for r in packed.groupBy("shard").count().collect()]
    assert len(sizes) == -(-(n + 40_000) // packing.SHARD) and max(sizes) < 1.2 * packing.SHARD
