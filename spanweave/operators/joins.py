"""Joins on intervals, diagonals and distances, and on pairs of names."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

PAIR = ["query", "target"]


def _cells(low: Column, high: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def _centre(axis: str) -> Column:
    return F.expr(f"({axis}_start + {axis}_end) div 2")


def on_diagonal(mappings: DataFrame, chains: DataFrame, gap: int) -> DataFrame:
    """(rank, order): reverse mappings that lie along a forward chain of the same pair, with the first such chain in ``order``.

    A mapping whose query range comes within ``gap`` of the chain's, and whose centre is at most ``gap`` (whole units) from
    the chain's diagonal. Both sides are cut into cells of the query axis, so the join has a cell in its key.
    """
    width = max(1, 4 * gap)
    c = chains.filter("strand = '+'").select(*PAIR, "order", (F.col("query_start") - gap).alias("c0"), (F.col("query_end") + gap).alias("c1"), (F.col("target_start") - F.col("query_start")).alias("diagonal"))
    c = c.withColumn("cell", _cells(F.col("c0"), F.col("c1"), width))
    m = mappings.filter("strand = '-'").select(*PAIR, "rank", "query_start", "query_end", _centre("query").alias("q"), _centre("target").alias("t"))
    m = m.withColumn("cell", _cells(F.col("query_start"), F.greatest("query_start", "query_end"), width))
    near = m.join(c, [*PAIR, "cell"]).filter((F.col("query_end") >= F.col("c0")) & (F.col("query_start") <= F.col("c1")) & (F.floor(F.abs(F.col("t") - F.col("q") - F.col("diagonal")) / math.sqrt(2)) <= gap))
    return near.groupBy("rank").agg(F.min("order").alias("order"))


def within_distance(mappings: DataFrame, anchors: DataFrame, distance: int) -> DataFrame:
    """(rank, anchor_rank): mappings whose centre is at most ``distance`` (whole units) from that of an anchor of the same pair, with the nearest anchor, the least rank of equal ones.

    Mappings are put in square cells of the two axes; an anchor, of which there are fewer, is put in the nine cells around it.
    """
    side = distance + 1
    at = lambda d: d.select(*PAIR, "rank", _centre("query").alias("q"), _centre("target").alias("t"))
    m = at(mappings).withColumns({"cq": F.floor(F.col("q") / side), "ct": F.floor(F.col("t") / side)})
    a = at(anchors).select(*PAIR, F.col("rank").alias("anchor_rank"), F.col("q").alias("aq"), F.col("t").alias("at"))
    for c, v in (("cq", "aq"), ("ct", "at")):
        a = a.withColumn(c, F.explode(F.array(*(F.floor(F.col(v) / side) + k for k in (-1, 0, 1)))))
    square = (F.col("q") - F.col("aq")) * (F.col("q") - F.col("aq")) + (F.col("t") - F.col("at")) * (F.col("t") - F.col("at"))
    near = m.join(a, [*PAIR, "cq", "ct"]).withColumn("_d", square).filter(F.col("_d") < side * side)
    near = near.withColumn("_d", F.floor(F.sqrt("_d")))
    return near.groupBy("rank").agg(F.min(F.struct("_d", "anchor_rank")).alias("x")).select("rank", "x.anchor_rank")


def contained(mappings: DataFrame, boxes: DataFrame) -> DataFrame:
    """Mappings that lie on both axes inside a box (query, target and four coordinates) of their pair, any strand."""
    b = boxes.select(*PAIR, *(F.col(c).alias(f"_{c}") for c in ("query_start", "query_end", "target_start", "target_end")))
    width = 100_000
    b = b.withColumn("_cell", _cells(F.col("_query_start"), F.col("_query_end"), width))
    m = mappings.withColumn("_cell", F.floor(F.col("query_start") / width))
    inside = (F.col("query_start") >= F.col("_query_start")) & (F.col("query_end") <= F.col("_query_end")) & (F.col("target_start") >= F.col("_target_start")) & (F.col("target_end") <= F.col("_target_end"))
    m, b = m.alias("m"), b.alias("b")
    return m.join(b, (F.col("m.query") == F.col("b.query")) & (F.col("m.target") == F.col("b.target")) & (F.col("m._cell") == F.col("b._cell")) & inside, "left_semi").drop("_cell")


def near_target(mappings: DataFrame, anchors: DataFrame, distance: int) -> DataFrame:
    """Mappings whose target midpoint is at most ``distance`` from that of an anchor on the same target, whatever the query.

    An anchor's midpoint is put in three cells of the target, so mappings are neither copied nor made distinct.
    """
    middle, side = (F.col("target_start") + F.col("target_end")) / 2, distance + 1
    a = anchors.select("target", middle.alias("_a")).distinct().withColumn("_cell", F.explode(F.array(*(F.floor(F.col("_a") / side) + k for k in (-1, 0, 1)))))
    m = mappings.withColumn("_t", middle).withColumn("_cell", F.floor(F.col("_t") / side))
    m, a = m.alias("m"), a.alias("a")
    near = m.join(a, (F.col("m.target") == F.col("a.target")) & (F.col("m._cell") == F.col("a._cell")) & (F.abs(F.col("_t") - F.col("_a")) <= distance), "left_semi")
    return near.drop("_t", "_cell")


def of_pairs(mappings: DataFrame, pairs: DataFrame, key) -> DataFrame:
    """Mappings whose names, through ``key`` and in either order, are a pair (a, b) with a <= b."""
    rows = mappings.withColumn("_a", F.least(key(F.col("query")), key(F.col("target")))).withColumn("_b", F.greatest(key(F.col("query")), key(F.col("target"))))
    p = pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    return rows.join(p, ["_a", "_b"], "left_semi").select(*mappings.columns)


def all_pairs(names: DataFrame, col: str) -> DataFrame:
    """(a, b), a < b, of every two names: the result itself is quadratic. The names are read once per block of the other side."""
    n = names.select(F.col(col)).distinct()
    return n.select(F.col(col).alias("a")).join(n.select(F.col(col).alias("b")), F.col("a") < F.col("b"))


def cartesian_pairs(queries: DataFrame, targets: DataFrame, col: str) -> DataFrame:
    """(query, target) of every two different names."""
    return queries.select(F.col(col).alias("query")).join(targets.select(F.col(col).alias("target")), F.col("query") != F.col("target"))


def remaining(pairs: DataFrame, done: DataFrame) -> DataFrame:
    return pairs.join(done.select(*PAIR).distinct(), PAIR, "left_anti")


def expand_haplotypes(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (i, j) of contigs, i < j, for pairs (a, b) of groups, and all pairs inside each group; ``groups``: (g, i)."""
    g = lambda s: groups.select(F.col("g").alias(f"_{s}"), F.col("i").alias(s))
    across = pairs.join(g("x"), F.col("a") == F.col("_x")).join(g("y"), F.col("b") == F.col("_y")).select("x", "y")
    within = g("x").join(g("y"), (F.col("_x") == F.col("_y")) & (F.col("x") < F.col("y"))).select("x", "y")
    both = across.unionByName(within).filter("x <> y")
    return both.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).distinct()


def missing_pairs(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected (query, target) pairs that no mapping has."""
    return expected.join(found.select(*PAIR).distinct(), PAIR, "left_anti")
