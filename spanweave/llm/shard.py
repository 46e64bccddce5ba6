"""Operator 4, sharding: proportional stratified interleaving, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import table

#: Hash ranges per source and ranges of the fractional rank: each is sorted by itself, so a hot source is many tasks.
RANGES = 4096


def shard(docs: DataFrame, n_shards: int = 16, seed: int = 20240607, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Place every row of ``docs`` in one of ``n_shards`` shards so that each has the mixture of sources.

    Rows of a source are shuffled by a seeded hash of their id and ranked; the fractional rank
    ``(rank + u(source)) / rows of the source``, with a seeded ``u`` in (0, 1), puts all sources on one scale. Rows sorted
    by it are cut into ``n_shards`` runs whose row counts differ by one at most (law ``rows``).

    Null source: counts as the source ``''``. Null or empty text: size 1. Null ids and repeated rows are rows like any
    other (full ties are interchangeable). An empty table gives no rows. Other columns are ignored.

    Columns: the id, size, text_crc32, law, shard, slot, grown_shard.
    """
    lead = [F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("src"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("h")]
    thin = docs.select(*lead).withColumn("range", F.shiftrightunsigned("h", 52))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*lead, (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32")).withColumn("range", F.shiftrightunsigned("h", 52))

    by_source = W.partitionBy("src")
    starts = thin.groupBy("src", "range").agg(F.count("*").alias("n")).select(
        "src", "range",
        (F.sum("n").over(by_source.orderBy("range")) - F.col("n")).alias("before"),
        F.sum("n").over(by_source).alias("n_src"),
    )
    offset = (F.pmod(F.xxhash64(F.lit(seed), F.col("src")), F.lit(1_000_003)) + 0.5) / 1_000_003
    ranked = rows.join(starts, ["src", "range"]).withColumn(
        "rank", F.col("before") + F.row_number().over(W.partitionBy("src", "range").orderBy("h", "doc_id", "text_crc32", "size")) - 1
    ).select("doc_id", "src", "h", "size", "text_crc32", ((F.col("rank") + offset) / F.col("n_src")).alias("part"))
    ranked = ranked.withColumn("slice", F.floor(F.col("part") * RANGES))

    whole = W.partitionBy(F.lit(0))
    slices = ranked.groupBy("slice").agg(F.count("*").alias("n")).select(  # RANGES rows at most
        "slice", (F.sum("n").over(whole.orderBy("slice")) - F.col("n")).alias("ahead"), F.sum("n").over(whole).alias("total")
    )
    placed = ranked.join(F.broadcast(slices), "slice").withColumn(
        "place", F.col("ahead") + F.row_number().over(W.partitionBy("slice").orderBy("part", "src", "h", "doc_id", "text_crc32", "size")) - 1
    ).withColumn("shard", F.expr(f"place * {n_shards} div total"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.expr(f"place - (shard * total + {n_shards - 1}) div {n_shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` as one folder per shard, rows in slot order over the files of a shard; ids must be unique (one may be null).

    Rows are dealt by ranges of shard and slot, so a shard is written by as many tasks as its size asks for. A column
    named shard or slot is replaced.
    """
    place = placed.select(F.col("doc_id").alias("_placed"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = docs.join(place, F.col(id_col).eqNullSafe(F.col("_placed"))).drop("shard", "slot", "_placed").withColumnsRenamed({"_shard": "shard", "_slot": "slot"})
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
