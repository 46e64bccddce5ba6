"""Set operations on mappings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

#: What makes two mappings one.
SIGNATURE = ["query", "query_start", "query_end", "target", "target_start", "target_end"]


def union_distinct(parts: list[DataFrame]) -> DataFrame:
    """All mappings of several tables, the first of each signature: by place of its table, then rank."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)])
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*SIGNATURE).orderBy("_part", "rank"))).filter("_nth = 1").drop("_nth", "_part")


def concatenate(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("rank"), "rank", "left_semi")


def only(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("rank"), "rank", "left_anti")
