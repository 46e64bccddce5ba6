"""Chaining: neighbouring mappings of a pair of sequences become scaffolds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.exprs import end_from_block
from ..session import ship
from .sweep import stream

PAIR = ["query", "target", "strand"]


class Sets:
    """Disjoint sets with union by rank; the root of the first set wins a tie."""

    def __init__(self, n: int):
        self.up, self.depth = list(range(n)), [0] * n

    def root(self, x: int) -> int:
        top = x
        while self.up[top] != top:
            top = self.up[top]
        while self.up[x] != top:
            self.up[x], x = top, self.up[x]
        return top

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a == b:
            return
        if self.depth[a] < self.depth[b]:
            a, b = b, a
        elif self.depth[a] == self.depth[b]:
            self.depth[a] += 1
        self.up[b] = a

    def groups(self) -> list[list[int]]:
        found: dict[int, list[int]] = {}
        for x in range(len(self.up)):
            found.setdefault(self.root(x), []).append(x)
        return [found[r] for r in sorted(found)]


def _gap(ahead: np.ndarray, gap: int) -> np.ndarray:
    """The distance for a signed gap: an overlap counts by its size up to a fifth of ``gap``, and is too far beyond."""
    return np.where(ahead >= 0, ahead, np.where(-ahead <= gap // 5, -ahead, gap + 1))


def best_links(qs: np.ndarray, qe: np.ndarray, ts: np.ndarray, te: np.ndarray, forward: bool, gap: int) -> list[tuple[int, int]]:
    """(predecessor, successor) of mappings in order of query start.

    In that order each mapping picks the nearest later one within ``gap`` on both axes for which it would be nearer than
    the predecessor that one has so far, and takes its place; who loses a successor doesn't look again.
    """
    n = len(qs)
    held = np.full(n, np.iinfo(np.int64).max)
    before = np.full(n, -1)
    stop = np.searchsorted(qs, qe + gap, side="right")
    for i in range(n - 1):
        j = slice(i + 1, int(stop[i]))
        if j.start >= j.stop:
            continue
        q = _gap(qs[j] - qe[i], gap)
        t = _gap(ts[j] - te[i] if forward else ts[i] - te[j], gap)
        far = q * q + t * t
        fits = (q <= gap) & (t <= gap) & (far < held[j])
        if fits.any():
            k = int(np.argmin(np.where(fits, far, np.iinfo(np.int64).max)))
            held[j.start + k], before[j.start + k] = far[k], i
    return [(int(i), j) for j, i in enumerate(before) if i >= 0]


def _chained(gap: int):
    def work(t: pa.Table, group: np.ndarray, island: np.ndarray, continued: bool) -> pa.Table:
        qs, qe, ts, te, rank = (t.column(c).to_numpy().astype(np.int64) for c in ("query_start", "query_end", "target_start", "target_end", "rank"))
        strand = t.column("strand").to_pylist()
        root = np.arange(t.num_rows)
        edges = np.append(np.flatnonzero(island), t.num_rows)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                sets = Sets(b - a)
                for i, j in best_links(qs[a:b], qe[a:b], ts[a:b], te[a:b], strand[a] == "+", gap):
                    sets.join(i, j)
                root[a:b] = [a + sets.root(x) for x in range(b - a)]
        for name, values in (("chain_start", qs[root]), ("chain_root", rank[root])):
            t = t.set_column(t.column_names.index(name), name, pa.array(values))
        return t

    return stream(PAIR, "query_start", "query_end", work, reach=gap + 1)


def chain_members(df: DataFrame, gap: int) -> DataFrame:
    """``df`` with chain_start and chain_root, which with query, target and strand name the chain of a mapping.

    A pair's mappings are read in order of query start; where no mapping reaches within ``gap`` of the next, memory is
    given up, so a pair of any size streams through a task.
    """
    ship(df.sparkSession)
    rows = df.select("*", F.lit(0).cast("long").alias("chain_start"), F.lit(0).cast("long").alias("chain_root"))
    dealt = rows.repartition(*PAIR).sortWithinPartitions(*PAIR, "query_start", "rank")
    return dealt.mapInArrow(_chained(gap), dealt.schema)


CHAIN = [*PAIR, "chain_start", "chain_root"]


def weighted_identity(matches: Column, blocks: Column, span: Column) -> Column:
    """Matches over block lengths and the logarithm of what the span has beyond them."""
    gap = F.greatest(F.lit(0), span - blocks)
    width = blocks + F.when(gap > 0, F.greatest(F.lit(0.0), F.log(gap))).otherwise(F.lit(0.0))
    return F.when(width > 0, matches / width).otherwise(F.lit(0.0))


def chain_table(members: DataFrame, keys: list[str] = CHAIN) -> DataFrame:
    """One row per chain: bounding box, sums, span, weighted identity, number of members and least rank."""
    sums = members.groupBy(*keys).agg(
        F.min("query_start").alias("query_start"), F.max("query_end").alias("query_end"), F.min("target_start").alias("target_start"), F.max("target_end").alias("target_end"),
        F.sum("matches").alias("sum_matches"), F.sum("block_length").alias("sum_block"), F.count("*").alias("members"), F.min("rank").alias("first_rank"))
    span = F.col("query_end") - F.col("query_start")
    return sums.withColumn("span", span).withColumn("identity", weighted_identity(F.col("sum_matches"), F.col("sum_block"), F.col("span")))


def _runs(df: DataFrame, keys: list[str], breaks: Column, order: list[str]) -> DataFrame:
    """``df`` with ``run``: how many rows up to and with this one, in order, begin a new run."""
    return df.withColumn("_new", F.when(breaks, 1).otherwise(0)).withColumn("run", F.sum("_new").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_new")


def _previous(of: Column, keys: list[str], order: list[str]) -> Column:
    return F.lag(of).over(W.partitionBy(*keys).orderBy(*order))


def chain_query_gaps(df: DataFrame, gap: int) -> DataFrame:
    """``df`` with ``run``: mappings of a pair in order of query start, a new run where the gap to the one before is over ``gap``."""
    order = ["query_start", "rank"]
    return _runs(df, ["query", "target"], F.col("query_start") - _previous(F.col("query_end"), ["query", "target"], order) > gap, order)


def _folded(keys: list[str], merge):
    """A function for ``mapInArrow`` over sorted rows: ``run`` is the rank of the row that began a row's run; memory holds a batch.

    ``merge(run, row)`` gives the run with the row, or None if the row begins a new one; both are tuples (query_start, query_end,
    target_start, target_end, strand, block_length).
    """

    def run(batches):
        last, open_run, first = None, None, None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("query_start", "query_end", "target_start", "target_end", "strand", "block_length")]
            out = []
            for key, rank, row in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), b.column("rank").to_pylist(), zip(*cols, strict=True), strict=True):
                joined = merge(open_run, row) if key == last else None
                if joined is None:
                    joined, first = row, rank
                last, open_run = key, joined
                out.append(first)
            yield b.set_column(b.schema.get_field_index("run"), "run", pa.array(out, pa.int64()))

    return run


def _merged(df: DataFrame, keys: list[str], order: list[str], merge) -> DataFrame:
    ship(df.sparkSession)
    rows = df.select("*", F.lit(0).cast("long").alias("run"))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(_folded(keys, merge), dealt.schema)


def merge_close(df: DataFrame, gap: int = 100) -> DataFrame:
    """Mappings of a pair and strand, by query start, merged while they lie less than ``gap`` from the run so far on both axes.

    The query end of a run is the greatest so far; so are its target end (forward) or its target start (reverse), from which
    gaps are measured. A merged row keeps the first one's target start (forward) or target end (reverse).
    """

    def merge(run, row):
        qs, qe, ts, te, strand, n = run
        t = row[2] - te if strand == "+" else ts - row[3]
        if max(0, row[0] - qe) >= gap or max(0, t) >= gap:
            return None
        return (qs, max(qe, row[1]), ts, max(te, row[3]), strand, n) if strand == "+" else (qs, max(qe, row[1]), max(ts, row[2]), te, strand, n)

    runs = _merged(df, PAIR, ["query_start", "rank"], merge)
    forward, first = F.col("strand") == "+", F.struct("query_start", "rank")
    box = runs.groupBy(*PAIR, "run").agg(
        F.min("query_start").alias("query_start"), F.max("query_end").alias("query_end"),
        F.min_by("target_start", first).alias("_s"), F.max("target_start").alias("_m"), F.min_by("target_end", first).alias("_e"), F.max("target_end").alias("_t"),
        F.sum("matches").alias("matches"), F.count("*").alias("members"))
    return box.select(
        *PAIR, "query_start", "query_end", F.when(forward, F.col("_s")).otherwise(F.col("_m")).alias("target_start"), F.when(forward, F.col("_t")).otherwise(F.col("_e")).alias("target_end"),
        "matches", (F.col("query_end") - F.col("query_start")).alias("block_length"), "members", F.col("run").alias("rank"))


def merge_near(df: DataFrame, gap: int) -> DataFrame:
    """Mappings of a pair, by target start and then query start, merged while strand is the same and both gaps are at most ``gap``; with their mean identity.

    Ends are starts and block lengths. A run's target end is that of its last row, its block length leads from its first
    target start there, and its query end is its first query start and that length.
    """

    def merge(run, row):
        qs, _, ts, _, strand, n = run
        if strand != row[4] or row[2] - (ts + n) > gap or row[0] - (qs + n) > gap:
            return None
        return qs, None, ts, None, strand, row[2] + row[5] - ts

    runs = _merged(df, ["query", "target"], ["target_start", "query_start", "rank"], merge)
    order = F.struct("target_start", "query_start", "rank")
    out = runs.groupBy("query", "target", "run").agg(
        F.min_by("strand", order).alias("strand"), F.min_by("query_start", order).alias("query_start"), F.min_by("target_start", order).alias("target_start"),
        F.max_by(end_from_block(F.col("target_start"), F.col("block_length")), order).alias("_end"), F.sum("matches").alias("matches"), F.avg("identity").alias("identity"), F.count("*").alias("members"))
    length = F.col("_end") - F.col("target_start")
    return out.select(
        *PAIR, "query_start", end_from_block(F.col("query_start"), length).alias("query_end"), "target_start", F.col("_end").alias("target_end"), "matches", length.alias("block_length"), "identity", "members", F.col("run").alias("rank"))


def chain_adjacent(df: DataFrame, gap: int) -> DataFrame:
    """``df`` with ``run``: neighbours in order of query start chain while both signed gaps lie between -gap / 5 and ``gap``."""
    order = ["query_start", "rank"]
    q = F.col("query_start") - _previous(F.col("query_end"), PAIR, order)
    t = F.col("target_start") - _previous(F.col("target_end"), PAIR, order)
    least = -(gap // 5)
    return _runs(df, PAIR, (q < least) | (q > gap) | (t < least) | (t > gap), order)


def _gap_unions(gap: int):
    def work(t: pa.Table, group: np.ndarray, island: np.ndarray, continued: bool) -> pa.Table:
        qs, qe, ts, te, rank = (t.column(c).to_numpy().astype(np.int64) for c in ("query_start", "query_end", "target_start", "target_end", "rank"))
        strand = t.column("strand").to_pylist()
        root = np.arange(t.num_rows)
        edges = np.append(np.flatnonzero(island), t.num_rows)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            sets = Sets(b - a)
            for i in range(b - a):
                stop = int(np.searchsorted(qs[a:b], qe[a + i] + gap, side="right"))
                j = np.arange(i + 1, stop)
                if len(j):
                    t_gap = np.maximum(0, ts[a + j] - te[a + i] if strand[a] == "+" else ts[a + i] - te[a + j])
                    for x in j[t_gap <= gap].tolist():
                        sets.join(i, x)
            for g in sets.groups():
                root[[a + x for x in g]] = a + g[0]
        for name, values in (("chain_start", qs[root]), ("chain_root", rank[root])):
            t = t.set_column(t.column_names.index(name), name, pa.array(values))
        return t

    return stream(PAIR, "query_start", "query_end", work, reach=gap + 1)


def chain_transitive(df: DataFrame, gap: int) -> DataFrame:
    """Like :func:`chain_members`, but every two mappings within ``gap`` on both axes (overlaps count 0) are in one chain."""
    ship(df.sparkSession)
    rows = df.select("*", F.lit(0).cast("long").alias("chain_start"), F.lit(0).cast("long").alias("chain_root"))
    dealt = rows.repartition(*PAIR).sortWithinPartitions(*PAIR, "query_start", "rank")
    return dealt.mapInArrow(_gap_unions(gap), dealt.schema)


def _first_fit(gap: int):
    """A function for ``mapInArrow`` over rows sorted by pair, target start and query start: ``chain_root`` is the rank of the first row of the first open chain that a row fits."""

    def run(batches):
        last, chains = None, []  # (target end, query end, strand, root) of each chain's last row, in order of their first rows
        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("query", "target", "strand", "query_start", "target_start", "block_length", "rank"))
            out = []
            for q, t, strand, qs, ts, n, rank in zip(*cols, strict=True):
                if (q, t) != last:
                    last, chains = (q, t), []
                chains = [c for c in chains if ts - c[0] <= gap]  # what is too far behind stays so
                k = next((k for k, c in enumerate(chains) if c[2] == strand and qs - c[1] <= gap), None)
                root = rank if k is None else chains[k][3]
                now = (ts + n, qs + n, strand, root)
                if k is None:
                    chains.append(now)
                else:
                    chains[k] = now
                out.append(root)
            yield b.set_column(b.schema.get_field_index("chain_root"), "chain_root", pa.array(out, pa.int64()))

    return run


def first_fit_scaffolds(df: DataFrame, gap: int, min_length: int) -> DataFrame:
    """(rank, query, target, chain_root, chain_status): every mapping of a pair, by target start and query start, joins the first chain of
    its strand whose last row lies within ``gap`` before it on both axes; chains of ``min_length`` on the target are scaffolds, rows of others rescued.

    Ends are starts and block lengths; the length of a chain leads from its first row's start to its last row's end.
    """
    ship(df.sparkSession)
    rows = df.select("rank", "query", "target", "strand", "query_start", "target_start", "block_length", F.lit(0).cast("long").alias("chain_root"))
    dealt = rows.repartition("query", "target").sortWithinPartitions("query", "target", "target_start", "query_start", "rank")
    found = dealt.mapInArrow(_first_fit(gap), dealt.schema)
    keys, order = ["query", "target", "chain_root"], F.struct("target_start", "query_start", "rank")
    length = (F.max_by(end_from_block(F.col("target_start"), F.col("block_length")), order) - F.min_by("target_start", order)).alias("length")
    long = found.groupBy(*keys).agg(length)
    return found.join(long, keys).select("rank", *keys, F.when(F.col("length") >= min_length, "scaffold").otherwise("rescued").alias("chain_status"))


def buddies_sql(relation: str, gap: int) -> str:
    """Tables that end in ``member`` (rows with chain_start and chain_root): best-buddy chains, one mapping of every pair and strand a round. For checks.

    Each round a mapping takes the nearest successor for which it is nearer than the predecessor held so far; of the links
    left, each chain is a path, named by its first mapping.
    """
    far = lambda x: f"CASE WHEN {x} >= 0 THEN {x} WHEN -({x}) <= {gap // 5} THEN -({x}) ELSE {gap + 1} END"
    key, on = "query, target, strand", "o.query = f.query AND o.target = f.target AND o.strand = f.strand"
    big = 1 << 60
    return f"""bo AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY query_start, "rank") AS n, count(*) OVER (PARTITION BY {key}) AS size FROM {relation}),
  bd AS (SELECT a."rank" AS x, b.n AS j, {far('b.query_start - a.query_end')} AS q, {far("CASE WHEN a.strand = '+' THEN b.target_start - a.target_end ELSE a.target_start - b.target_end END")} AS t
    FROM bo a JOIN bo b ON a.query = b.query AND a.target = b.target AND a.strand = b.strand AND a.n < b.n AND b.query_start <= a.query_end + {gap}),
  bc AS MATERIALIZED (SELECT x, list(struct_pack(far := q * q + t * t, j := j) ORDER BY q * q + t * t, j) AS near FROM bd WHERE q <= {gap} AND t <= {gap} GROUP BY x),
  br AS MATERIALIZED (SELECT o.*, bc.near FROM bo o LEFT JOIN bc ON bc.x = o."rank"),
  bf AS (SELECT {key}, 0::BIGINT AS n, size, list_transform(range(size), lambda z: {big}::BIGINT) AS held, list_transform(range(size), lambda z: 0::BIGINT) AS up FROM br WHERE n = 1
    UNION ALL SELECT query, target, strand, n, size, list_transform(held, lambda z, k: CASE WHEN k = pick.j THEN pick.far ELSE z END) AS held, list_transform(up, lambda z, k: CASE WHEN k = pick.j THEN n ELSE z END) AS up
    FROM (SELECT o.query, o.target, o.strand, o.n, o.size, f.held, f.up, list_filter(o.near, lambda c: c.far < f.held[c.j])[1] AS pick FROM bf f JOIN br o ON {on} AND o.n = f.n + 1)),
  bl AS MATERIALIZED (SELECT {key}, unnest(up) AS a, unnest(range(1, size + 1)) AS b FROM bf WHERE n = size),
  bp AS (SELECT {key}, b AS n, b AS head FROM bl WHERE a = 0 UNION ALL SELECT l.query, l.target, l.strand, l.b, p.head FROM bp p JOIN bl l ON l.query = p.query AND l.target = p.target AND l.strand = p.strand AND l.a = p.n),
  member AS MATERIALIZED (SELECT o.* EXCLUDE (n, size), h.query_start AS chain_start, h."rank" AS chain_root FROM bo o JOIN bp p ON p.query = o.query AND p.target = o.target AND p.strand = o.strand AND p.n = o.n
    JOIN bo h ON h.query = o.query AND h.target = o.target AND h.strand = o.strand AND h.n = p.head)"""
