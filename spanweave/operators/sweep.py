"""Interval sweeps: keep, at every position of an axis, the K best mappings, without those they overlap too much."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.exprs import score as score_of
from ..schema import Scoring
from ..session import ship

Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def mark(start: np.ndarray, end: np.ndarray, score: np.ndarray, rank: np.ndarray, k: int, limit: float) -> np.ndarray:
    """Which of one group's intervals are among the k best somewhere and nowhere overlap one of the k best by more than ``limit`` while not among them.

    Order is by score, then start, then rank. Empty and reversed intervals are nowhere active.
    """
    n = len(start)
    order = np.lexsort((rank, start, -score))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    s, e = start[order].tolist(), end[order].tolist()  # by place
    events = sorted([(p, 1, i) for i, p in enumerate(s) if p < e[i]] + [(p, 0, i) for i, p in enumerate(e) if s[i] < p])
    good, bad, active, top = [False] * n, [False] * n, [], []
    at, m = 0, len(events)
    while at < m:
        p, came = events[at][0], []
        while at < m and events[at][0] == p:
            _, begins, i = events[at]
            if begins:
                insort(active, i)
                came.append(i)
            else:
                active.remove(i)
            at += 1
        now = active[:k]
        new = [i for i in now if i not in top]
        for i in new:
            good[i] = True
        if limit < 1 and len(active) > k:
            # what wasn't compared before: all below with new tops, and what came with the old tops
            for j in active[k:]:
                if bad[j]:
                    continue
                for i in now if j in came or j in top else new:
                    short = min(e[i] - s[i], e[j] - s[j])
                    if (min(e[i], e[j]) - max(s[i], s[j])) / short > limit:
                        bad[j] = True
                        break
        top = now
    kept = np.zeros(n, bool)
    kept[order] = np.array(good, bool) & ~np.array(bad, bool)
    return kept


def _changes(t: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before; the first row counts as a change."""
    out = np.zeros(t.num_rows, bool)
    out[:1] = True
    for k in keys:
        c = t.column(k).combine_chunks() if isinstance(t, pa.Table) else t.column(k)
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
        out[1:] |= differ | nulls
    return out


def islands(t: pa.Table, keys: list[str], start: str, end: str, reach: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(first rows of groups, first rows of islands): within a group an island ends where a row starts ``reach`` or more after all ends before it."""
    group = _changes(t, keys)
    s, e = t.column(start).to_numpy().astype(np.int64), t.column(end).to_numpy().astype(np.int64)
    gid = np.cumsum(group) - 1
    # running maximum of ends within groups: offset each group above the one before
    low = int(min(e.min(), s.min())) if len(e) else 0
    wide = int(max(e.max(), s.max())) - low + 1 if len(e) else 1
    if len(e) and wide * (int(gid[-1]) + 1) < 2**62:
        most = np.maximum.accumulate((np.maximum(e, s) - low) + gid * wide) - gid * wide + low
    else:
        most = np.empty(len(e), np.int64)
        edges = np.append(np.flatnonzero(group), len(e))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            most[a:b] = np.maximum.accumulate(np.maximum(e[a:b], s[a:b]))
    island = group.copy()
    island[1:] |= s[1:] >= most[:-1] + max(0, reach)
    return group, island


def stream(keys: list[str], start: str, end: str, work: Callable[[pa.Table, np.ndarray, np.ndarray, bool], pa.Table], reach: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` over rows sorted by keys and start, that hands whole islands to ``work``.

    ``work(rows, group, island, continued)`` gets rows that begin an island; ``continued`` tells whether their first
    group has rows before them. The last island waits for the next batch, so memory holds a batch and one island.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, continued = None, False
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            group, island = islands(held, keys, start, end, reach)
            cut = int(np.flatnonzero(island)[-1])
            if cut:
                yield from work(held.slice(0, cut), group[:cut], island[:cut], continued).to_batches()
                continued = (continued or cut > 0) and not group[cut]
                held = held.slice(cut)
        if held is not None and held.num_rows:
            group, island = islands(held, keys, start, end, reach)
            yield from work(held, group, island, continued).to_batches()

    return run


def _alone(group: np.ndarray, continued: bool, more: bool = False) -> np.ndarray:
    """Rows that are the only one of their group."""
    edges = np.append(np.flatnonzero(group), len(group))
    size = np.repeat(np.diff(edges), np.diff(edges)) if len(edges) > 1 and edges[0] == 0 else np.repeat(np.diff(np.append(0, edges)), np.diff(np.append(0, edges)))
    out = size == 1
    if continued and len(out):
        out[: edges[1] if len(edges) > 1 else len(out)] = False
    return out


def _swept(keys: list[str], start: str, end: str, flag: str, k: int, limit: float, rule: Kernel | Callable):
    def work(t: pa.Table, group: np.ndarray, island: np.ndarray, continued: bool) -> pa.Table:
        s, e = (t.column(c).to_numpy().astype(np.int64) for c in (start, end))
        kept = (e > s) | _alone(group, continued)
        edges = np.append(np.flatnonzero(island), len(island))
        score, rank = t.column("_score").to_numpy(), t.column("rank").to_numpy()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                kept[a:b] = rule(s[a:b], e[a:b], score[a:b], rank[a:b], k, limit)
        return t.set_column(t.column_names.index(flag), flag, pa.array(kept))

    return stream(keys, start, end, work)


class _Sweep:
    """One group's sweep with what is active as its only state. :func:`mark` is the same over a whole group.

    An entry is [-score, start, rank, end, row, good, bad, came]; ``done`` gets (row, kept) of each as its end passes.
    """

    def __init__(self, k: int, limit: float):
        self.k, self.limit = k, limit
        self.active: list[list] = []  # in order of score, start, rank
        self.ends: list[tuple] = []  # heap of (end, rank, entry)
        self.top: list[list] = []
        self.came: list[list] = []
        self.at, self.rows, self.lone = None, 0, None

    def look(self) -> None:
        """Judge what is active at the position at hand, once all that ends or starts there is known."""
        active, k, came, top = self.active, self.k, self.came, self.top
        now = active[:k]
        new = [i for i in now if i not in top]
        for i in new:
            i[5] = True
        if self.limit < 1 and len(active) > k and (new or came):
            # what wasn't compared before: all below with new tops, and what came with the old tops
            for j in active[k:] if new else came:
                if j[6] or not new and j in now:
                    continue
                for i in now if j[7] or j in top else new:
                    if (min(i[3], j[3]) - max(i[1], j[1])) / min(i[3] - i[1], j[3] - j[1]) > self.limit:
                        j[6] = True
                        break
        for j in came:
            j[7] = False
        self.top, self.came = now, []

    def leave(self, p: int, done: list[tuple[int, bool]]) -> None:
        """Take out what ends at ``p``."""
        while self.ends and self.ends[0][0] == p:
            entry = heappop(self.ends)[2]
            del self.active[bisect_left(self.active, entry)]
            done.append((entry[4], entry[5] and not entry[6]))

    def advance(self, p: int | None, done: list[tuple[int, bool]]) -> None:
        """Go on to a later position, or to the end of the group (None), by way of the ends before it."""
        if self.at is not None:
            self.look()
        while self.ends and (p is None or self.ends[0][0] < p):
            self.leave(self.ends[0][0], done)
            self.look()
        if p is not None:
            self.leave(p, done)
        self.at = p

    def add(self, start: int, end: int, score: float, rank: int, row: int, done: list[tuple[int, bool]]) -> None:
        self.rows += 1
        if self.rows == 2 and self.lone is not None:
            done.append((self.lone, False))
            self.lone = None
        if end <= start:  # active nowhere; kept if alone in its group
            if self.rows == 1:
                self.lone = row
            else:
                done.append((row, False))
            return
        if start != self.at:
            self.advance(start, done)
        entry = [-score, start, rank, end, row, False, False, True]
        insort(self.active, entry)
        heappush(self.ends, (end, rank, entry))
        self.came.append(entry)

    def finish(self, done: list[tuple[int, bool]]) -> None:
        self.advance(None, done)
        if self.lone is not None:
            done.append((self.lone, True))

    def move(self, place: list[int]) -> None:
        """Rows have new numbers."""
        for entry in self.active:
            entry[4] = place[entry[4]]
        if self.lone is not None:
            self.lone = place[self.lone]


def _flagged(keys: list[str], start: str, end: str, flag: str, k: int, limit: float):
    """A function for ``mapInArrow`` over rows sorted by keys, start and rank: sets ``flag`` and hands a row on once its end has passed. Memory holds a batch and what is active."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, sweep = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            before = 0 if held is None else held.num_rows
            first = _changes(b, keys)
            first[0] = tuple(b.column(c)[0].as_py() for c in keys) != last
            last = tuple(b.column(c)[b.num_rows - 1].as_py() for c in keys)
            done: list[tuple[int, bool]] = []
            cols = (b.column(c).to_numpy(zero_copy_only=False).tolist() for c in (start, end, "_score", "rank"))
            for row, (new, s, e, score, rank) in enumerate(zip(first.tolist(), *cols, strict=True), before):
                if new:
                    if sweep is not None:
                        sweep.finish(done)
                    sweep = _Sweep(k, limit)
                sweep.add(s, e, score, rank, row, done)
            held = t if held is None else pa.concat_tables([held, t])
            held = yield from _handed(held, done, sweep, flag)
        if sweep is not None:
            done = []
            sweep.finish(done)
            yield from _handed(held, done, sweep, flag)

    return run


def _handed(t: pa.Table, done: list[tuple[int, bool]], sweep: _Sweep, flag: str):
    """Hand on the rows that are done, with their flag; the others are left, with new numbers."""
    ready, kept = np.zeros(t.num_rows, bool), np.zeros(t.num_rows, bool)
    if done:
        rows, flags = zip(*done, strict=True)
        ready[list(rows)], kept[list(rows)] = True, flags
        yield from t.set_column(t.column_names.index(flag), flag, pa.array(kept)).filter(pa.array(ready)).to_batches()
    sweep.move((np.cumsum(~ready) - 1).tolist())
    return t.filter(pa.array(~ready)).combine_chunks()


def flag_axis(df: DataFrame, keys: list[str], axis: str, k: int | None, limit: float, flag: str, scoring: Scoring | str = Scoring.LOG_LENGTH_IDENTITY) -> DataFrame:
    """``df`` with a boolean ``flag``: whether the sweep on ``axis`` (query or target) within ``keys`` keeps the row.

    Without a limit (k None) every mapping is among the best wherever it is active, so the sweep is a count per group.
    Else rows are dealt by their keys, sorted by start, and read as a stream: one shuffle, no join back.
    A row alone in its group is kept whatever its length. ``df`` needs ``rank``, unique.
    """
    start, end = f"{axis}_start", f"{axis}_end"
    if k is None:
        return df.withColumn(flag, (F.col(end) > F.col(start)) | (F.count("*").over(W.partitionBy(*keys)) == 1))
    ship(df.sparkSession)
    rows = df.select("*", score_of(scoring).alias("_score"), F.lit(False).alias(flag))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, start, "rank")
    return dealt.mapInArrow(_flagged(keys, start, end, flag, k, limit), dealt.schema).drop("_score")


def sweep(df: DataFrame, keys: list[str], axis: str = "query", k: int | None = 1, limit: float = 0.95, scoring: Scoring | str = Scoring.LOG_LENGTH_IDENTITY) -> DataFrame:
    """The rows a sweep on one axis keeps."""
    return flag_axis(df, keys, axis, k, limit, "_kept", scoring).filter("_kept").drop("_kept")


def sweep_both(df: DataFrame, keys: list[str], query_limit: int | None = 1, target_limit: int | None = 1, limit: float = 0.95, scoring: Scoring | str = Scoring.LOG_LENGTH_IDENTITY) -> DataFrame:
    """One axis after the other: the target axis sees what the query axis kept. Both use the same keys."""
    return sweep(sweep(df, keys, "query", query_limit, limit, scoring), keys, "target", target_limit, limit, scoring)


def sweep_intersect(df: DataFrame, query_keys: list[str], target_keys: list[str], query_limit: int | None, target_limit: int | None, limit: float, scoring: Scoring | str = Scoring.LOG_LENGTH_IDENTITY) -> DataFrame:
    """Rows that both axes keep, each judged on all rows."""
    rows = flag_axis(df, query_keys, "query", query_limit, limit, "_kept_query", scoring)
    rows = flag_axis(rows, target_keys, "target", target_limit, limit, "_kept_target", scoring)
    return rows.filter("_kept_query and _kept_target").drop("_kept_query", "_kept_target")


def _greedy(keys: list[str], axes: tuple[str, ...], flag: str, limit: float):
    """Best first, a row is kept unless it overlaps a kept one on all axes by more than ``limit``."""
    start, end = f"{axes[0]}_start", f"{axes[0]}_end"

    def work(t: pa.Table, group: np.ndarray, island: np.ndarray, continued: bool) -> pa.Table:
        ends = [(t.column(f"{a}_start").to_numpy().astype(np.int64), t.column(f"{a}_end").to_numpy().astype(np.int64)) for a in axes]
        score, rank = t.column("_score").to_numpy(), t.column("rank").to_numpy()
        kept = np.ones(t.num_rows, bool)
        edges = np.append(np.flatnonzero(island), len(island))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a < 2:
                continue
            chosen: list[int] = []
            for i in (a + np.lexsort((rank[a:b], ends[0][0][a:b], -score[a:b]))).tolist():
                c = np.array(chosen, np.int64)
                hit = np.ones(len(c), bool)
                for s, e in ends:
                    least = np.minimum(e[c] - s[c], e[i] - s[i])
                    both = np.minimum(e[c], e[i]) - np.maximum(s[c], s[i])
                    hit &= (least > 0) & (both > limit * least)
                if hit.any():
                    kept[i] = False
                else:
                    chosen.append(i)
        return t.set_column(t.column_names.index(flag), flag, pa.array(kept))

    return stream(keys, start, end, work)


def greedy_non_overlapping(df: DataFrame, keys: list[str], axes: tuple[str, ...] = ("query",), limit: float = 0.0, scoring: Scoring | str = Scoring.LOG_LENGTH_IDENTITY) -> DataFrame:
    """Best first, keep what overlaps nothing kept by more than ``limit`` on every axis given, within ``keys``."""
    ship(df.sparkSession)
    rows = df.select("*", score_of(scoring).alias("_score"), F.lit(False).alias("_kept"))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, f"{axes[0]}_start", "rank")
    return dealt.mapInArrow(_greedy(keys, axes, "_kept", limit), dealt.schema).filter("_kept").drop("_kept", "_score")


def mark_at_starts(start: np.ndarray, end: np.ndarray, score: np.ndarray, rank: np.ndarray, k: int, limit: float) -> np.ndarray:
    """A variant: intervals among the k best when some interval begins; of these, best first, what overlaps no better one by more than ``limit``."""
    n = len(start)
    order = np.lexsort((rank, start, -score))
    s, e = start[order], end[order]
    good = np.zeros(n, bool)
    for p in np.unique(s[e > s]).tolist():
        good[np.flatnonzero((s <= p) & (p < e))[:k]] = True
    chosen: list[int] = []
    for i in np.flatnonzero(good).tolist():
        c = np.array(chosen, np.int64)
        least = np.minimum(e[c] - s[c], e[i] - s[i])
        if limit >= 1 or not (np.minimum(e[c], e[i]) - np.maximum(s[c], s[i]) > limit * least).any():
            chosen.append(i)
    kept = np.zeros(n, bool)
    kept[order[chosen]] = True
    return kept


def sweep_at_starts(df: DataFrame, keys: list[str], axis: str = "query", k: int | None = 1, limit: float = 0.95, scoring: Scoring | str = Scoring.LOG_LENGTH_IDENTITY) -> DataFrame:
    """As :func:`sweep`, by the variant that marks at starts only and then removes overlaps greedily; no limit keeps all."""
    if k is None:
        return df
    ship(df.sparkSession)
    rows = df.select("*", score_of(scoring).alias("_score"), F.lit(False).alias("_kept"))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, f"{axis}_start", "rank")
    return dealt.mapInArrow(_swept(keys, f"{axis}_start", f"{axis}_end", "_kept", k, limit, mark_at_starts), dealt.schema).filter("_kept").drop("_kept", "_score")


def sweep_sql(relation: str, keys: list[str], axis: str, k: int, limit: float, score: str) -> str:
    """The sweep as SQL: ranks of the active rows at every start and end. For checks; its cost grows with depth."""
    s, e, key = f"{axis}_start", f"{axis}_end", ", ".join(keys)
    on = " AND ".join(f"m.{c} = p.{c}" for c in keys)
    on2 = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    return f"""(WITH m AS MATERIALIZED (SELECT *, {score} AS sc, count(*) OVER (PARTITION BY {key}) AS gn FROM {relation}),
  p AS MATERIALIZED (SELECT DISTINCT {key}, {s} AS pos FROM m UNION SELECT DISTINCT {key}, {e} FROM m),
  a AS MATERIALIZED (SELECT m.*, p.pos, row_number() OVER (PARTITION BY {', '.join(f'm.{c}' for c in keys)}, p.pos ORDER BY sc DESC, {s}, "rank") AS rn
    FROM p JOIN m ON {on} AND m.{s} <= p.pos AND p.pos < m.{e}),
  good AS (SELECT DISTINCT "rank" FROM a WHERE rn <= {k}),
  bad AS (SELECT DISTINCT a."rank" FROM a JOIN a b ON {on2} AND a.pos = b.pos AND a.rn > {k} AND b.rn <= {k}
    WHERE {limit} < 1 AND (least(a.{e}, b.{e}) - greatest(a.{s}, b.{s})) / least(a.{e} - a.{s}, b.{e} - b.{s})::DOUBLE > {limit})
  SELECT * EXCLUDE (sc, gn) FROM m WHERE gn = 1 OR ("rank" IN (SELECT "rank" FROM good) AND "rank" NOT IN (SELECT "rank" FROM bad)))"""


def _replacing(keys: list[str], start: str, end: str, flag: str, limit: float):
    """A function for ``mapInArrow``: of rows sorted by keys and start, each takes the place of those before it that it overlaps by more than ``limit``, unless one of them scores higher."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, kept = None, None, _Kept()
        for b in batches:
            if not b.num_rows:
                continue
            before = 0 if held is None else held.num_rows
            first = _changes(b, keys)
            first[0] = tuple(b.column(c)[0].as_py() for c in keys) != last
            last = tuple(b.column(c)[b.num_rows - 1].as_py() for c in keys)
            done: list[tuple[int, bool]] = []
            cols = (b.column(c).to_numpy(zero_copy_only=False).tolist() for c in (start, end, "_score"))
            for row, (new, s, e, score) in enumerate(zip(first.tolist(), *cols, strict=True), before):
                if new:
                    kept.settle(None, done)
                kept.settle(s, done)
                hits = [x for x in kept.rows if min(e, x[1]) > max(s, x[0]) and min(e, x[1]) - max(s, x[0]) > limit * min(e - s, x[1] - x[0])]
                lost = [x for x in hits if not x[2] > score]
                done += [(x[3], False) for x in lost]
                kept.rows = [x for x in kept.rows if x not in lost]
                if len(lost) < len(hits):
                    done.append((row, False))
                else:
                    kept.rows.append((s, e, score, row))
            t = pa.Table.from_batches([b])
            held = yield from _handed(t if held is None else pa.concat_tables([held, t]), done, kept, flag)
        if held is not None:
            done = []
            kept.settle(None, done)
            yield from _handed(held, done, kept, flag)

    return run


class _Kept:
    """Rows (start, end, score, row) that are kept so far and that a later row may still overlap."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def settle(self, p: int | None, done: list[tuple[int, bool]]) -> None:
        """What ends by ``p`` (None: all) is kept for good."""
        done += [(x[3], True) for x in self.rows if p is None or x[1] <= p]
        self.rows = [x for x in self.rows if p is not None and x[1] > p]

    def move(self, place: list[int]) -> None:
        self.rows = [(*x[:3], place[x[3]]) for x in self.rows]


def replace_worse(df: DataFrame, keys: list[str], axis: str = "query", limit: float = 0.5, scoring: Scoring | str = Scoring.LOG_LENGTH_IDENTITY) -> DataFrame:
    """A variant for chains: in order of start, a row replaces the kept ones that it overlaps by more than ``limit``, but for those that score higher, any one of which drops the row."""
    ship(df.sparkSession)
    rows = df.select("*", score_of(scoring).alias("_score"), F.lit(False).alias("_kept"))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, f"{axis}_start", "rank")
    return dealt.mapInArrow(_replacing(keys, f"{axis}_start", f"{axis}_end", "_kept", limit), dealt.schema).filter("_kept").drop("_kept", "_score")


def replace_sql(relation: str, keys: list[str], axis: str, limit: float, score: str) -> str:
    """Tables o and f: what is kept after each row of a group, one row of every group a round. For checks."""
    key, s, e = ", ".join(keys), f"{axis}_start", f"{axis}_end"
    hit = f"least(k.e, o.{e}) > greatest(k.s, o.{s}) AND least(k.e, o.{e}) - greatest(k.s, o.{s}) > {limit} * least(k.e - k.s, o.{e} - o.{s})"
    one = f"struct_pack(s := o.{s}, e := o.{e}, sc := o.sc, r := o.\"rank\")"
    on = " AND ".join(f"o.{k} = f.{k}" for k in keys)
    return f"""o AS MATERIALIZED (SELECT *, {score} AS sc, row_number() OVER (PARTITION BY {key} ORDER BY {s}, "rank") AS n, count(*) OVER (PARTITION BY {key}) AS size FROM {relation}),
  f AS (SELECT {', '.join(f'o.{k}' for k in keys)}, n, size, [{one}] AS kept FROM o WHERE n = 1
    UNION ALL SELECT {', '.join(f'o.{k}' for k in keys)}, o.n, o.size, list_concat(list_filter(f.kept, lambda k: NOT ({hit}) OR k.sc > o.sc), CASE WHEN len(list_filter(f.kept, lambda k: {hit} AND k.sc > o.sc)) = 0 THEN [{one}] ELSE [] END) AS kept
    FROM f JOIN o ON {on} AND o.n = f.n + 1)"""


def greedy_sql(relation: str, keys: list[str], axes: tuple[str, ...], limit: float, score: str) -> str:
    """Tables o and f: best first, the rows of each group that overlap no kept one on all axes by more than ``limit``, one row of every group a round. For checks."""
    key = ", ".join(keys)
    spans = ", ".join(f"{a[0]}s := o.{a}_start, {a[0]}e := o.{a}_end" for a in axes)
    over = " AND ".join(f"least(k.{a[0]}e - k.{a[0]}s, o.{a}_end - o.{a}_start) > 0 AND least(k.{a[0]}e, o.{a}_end) - greatest(k.{a[0]}s, o.{a}_start) > {limit} * least(k.{a[0]}e - k.{a[0]}s, o.{a}_end - o.{a}_start)" for a in axes)
    hit = f"len(list_filter(f.kept, lambda k: {over})) > 0"
    on = " AND ".join(f"o.{k} = f.{k}" for k in keys)
    return f"""o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {score} DESC, {axes[0]}_start, "rank") AS n FROM {relation}),
  f AS (SELECT {', '.join(f'o.{k}' for k in keys)}, n, "rank", true AS stays, [struct_pack({spans})] AS kept FROM o WHERE n = 1
    UNION ALL SELECT {', '.join(f'o.{k}' for k in keys)}, o.n, o."rank", NOT ({hit}) AS stays, CASE WHEN {hit} THEN f.kept ELSE list_append(f.kept, struct_pack({spans})) END AS kept FROM f JOIN o ON {on} AND o.n = f.n + 1)"""


def starts_sql(relation: str, keys: list[str], axis: str, k: int, score: str) -> str:
    """The rows of a relation that are among the k best where some row of their group begins, or alone in it."""
    s, e, key = f"{axis}_start", f"{axis}_end", ", ".join(keys)
    on = " AND ".join(f"m.{c} = p.{c}" for c in keys)
    return f"""(WITH p AS (SELECT DISTINCT {key}, {s} AS pos FROM {relation} WHERE {e} > {s}),
  a AS (SELECT m."rank", row_number() OVER (PARTITION BY {', '.join(f'm.{c}' for c in keys)}, p.pos ORDER BY {score} DESC, {s}, "rank") AS rn FROM p JOIN {relation} m ON {on} AND m.{s} <= p.pos AND p.pos < m.{e})
  SELECT * FROM {relation} WHERE "rank" IN (SELECT "rank" FROM a WHERE rn <= {k}))"""


def best(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in ``order``."""
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_nth") <= n).drop("_nth")
