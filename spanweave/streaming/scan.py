"""Mappings as a stream: the stateless part of the filter plan, and totals, over text files that keep arriving.

Sweeps and chains need whole groups, so they run on what the stream has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.exprs import prefix_last
from ..plans.filtering import passing
from ..schema import FilterConfig
from ..sources.readers import parse_lenient


def stream_mappings(spark: SparkSession, folder: str, cfg: FilterConfig = FilterConfig(), files: int = 16) -> DataFrame:
    """Parsed mappings of new files that pass the row predicates. ``rank`` is null: lines of a stream have no number."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(folder).select(F.lit(None).cast("long").alias("rank"), F.col("value").alias("line"))
    return passing(parse_lenient(lines).drop("line"), cfg)


def stream_identities(mappings: DataFrame) -> DataFrame:
    """Running sums per pair of genomes; state is one row per pair."""
    rows = mappings.select(prefix_last(F.col("query")).alias("g"), prefix_last(F.col("target")).alias("h"), "matches", "block_length").filter("g <> h")
    return rows.groupBy(F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b")).agg(F.sum("matches").alias("matches"), F.sum("block_length").alias("block_length"))


def append_to(mappings: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append passing mappings to Parquet; with ``once``, what is there now and then stop."""
    writer = mappings.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)
