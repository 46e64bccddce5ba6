"""Ranked selections: best, top-N and reciprocal best mappings of groups, all by window ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.exprs import score as score_of
from ..schema import Scoring
from .sweep import best


def _by_score(scoring: Scoring | str) -> list[Column]:
    return [score_of(scoring).desc(), F.col("rank")]


def best_query_then_target(df: DataFrame, scoring: Scoring | str = Scoring.LOG_LENGTH_IDENTITY) -> DataFrame:
    """The best mapping of each query, and of these the best of each target."""
    return best(best(df, ["query"], _by_score(scoring)), ["target"], _by_score(scoring))


def reciprocal_best(df: DataFrame, scoring: Scoring | str = Scoring.LOG_LENGTH_IDENTITY) -> DataFrame:
    """Mappings that are the best of their query and of their target."""
    ranked = df.withColumn("_s", score_of(scoring))
    for side in ("query", "target"):
        ranked = ranked.withColumn(f"_{side}", F.row_number().over(W.partitionBy(side).orderBy(F.col("_s").desc(), "rank")))
    return ranked.filter("_query = 1 and _target = 1").drop("_s", "_query", "_target")


def longest_then_limit(df: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` mappings with the largest block length of each query: one to many."""
    return best(df, ["query"], [F.col("block_length").desc(), F.col("rank")], limit)


def best_query_limit_target(df: DataFrame, target_limit: int, scoring: Scoring | str = Scoring.LOG_LENGTH_IDENTITY) -> DataFrame:
    """The best mapping of each query; of these ``target_limit`` of each target."""
    return best(best(df, ["query"], _by_score(scoring)), ["target"], _by_score(scoring), target_limit)


def limit_both(df: DataFrame, query_limit: int | None, target_limit: int | None, scoring: Scoring | str = Scoring.LOG_LENGTH_IDENTITY) -> DataFrame:
    """``query_limit`` mappings of each query, then ``target_limit`` of each target: many to many."""
    for side, n in (("query", query_limit), ("target", target_limit)):
        if n is not None:
            df = best(df, [side], _by_score(scoring), n)
    return df


def top_of_pair(df: DataFrame, n: int, scoring: Scoring | str = Scoring.LOG_LENGTH_IDENTITY) -> DataFrame:
    return best(df, ["query", "target"], _by_score(scoring), n)


def longest_of_group(df: DataFrame, keys: list[str]) -> DataFrame:
    """The mapping with the largest block length of each group; of equal ones the last."""
    return best(df, keys, [F.col("block_length").desc(), F.col("rank").desc()])


def longest_fraction(df: DataFrame, fraction: float) -> DataFrame:
    """The floor(n * fraction) rows with the largest block length.

    The cut is read off counts per length, so only rows of the length at which it falls are ranked.
    """
    whole = W.partitionBy(F.lit(0))
    sizes = df.groupBy("block_length").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_upto", F.sum("_n").over(whole.orderBy(F.col("block_length").desc()))).withColumn("_want", F.floor(F.sum("_n").over(whole) * F.lit(fraction)))
    sizes = sizes.filter(F.col("_upto") - F.col("_n") < F.col("_want")).select("block_length", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_left"), (F.col("_upto") <= F.col("_want")).alias("_all"))
    rows = df.join(sizes, "block_length").select(*df.columns, "_left", "_all")
    cut = rows.filter("not _all").withColumn("_nth", F.row_number().over(W.partitionBy("block_length").orderBy("rank"))).filter("_nth <= _left")
    return rows.filter("_all").select(*df.columns).unionByName(cut.select(*df.columns))
