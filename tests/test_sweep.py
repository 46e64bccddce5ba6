import random

import numpy as np
import pytest

from spanweave.operators import sweep
from spanweave.schema import Scoring

from .helpers import mappings, ranks


def kept(spark, intervals, k, limit, scoring=Scoring.LOG_LENGTH_IDENTITY):
    rows = [("q", s, e, "t", 10 * n, 10 * n + 10, i) for n, (s, e, i) in enumerate(intervals)]
    return ranks(sweep.sweep(mappings(spark, rows), ["query"], "query", k, limit, scoring))


SAME, FOUR = [(100, 200, 1.0)] * 3, [(100, 300, 1.0)] * 4
STAIRS = [(0, 100, 1.0), (50, 150, 1.0), (120, 220, 1.0), (200, 300, 1.0), (280, 380, 1.0)]


@pytest.mark.parametrize(("intervals", "k", "limit", "scoring", "want"), [
    ([], 1, 0.95, "log-length-ani", []), ([(5, 9, 0.5)], 1, 0.95, "log-length-ani", [0]),
    (SAME, 1, 0.95, "log-length-ani", [0]), (SAME, 2, 0.95, "log-length-ani", [0, 1]), (SAME, None, 0.95, "log-length-ani", [0, 1, 2]),
    ([(100, 300, 1.0), (150, 180, 1.0)], 1, 0.95, "log-length-ani", [0]), ([(100, 300, 1.0), (150, 180, 1.0)], 2, 0.95, "log-length-ani", [0, 1]),
    (FOUR, 2, 0.5, "log-length-ani", [0, 1]), (STAIRS, 1, 0.95, "log-length-ani", [0, 1, 2, 3, 4]),
    ([(100, 200, 0.95), (150, 250, 0.90)], 1, 0.95, "log-length-ani", [0, 1]),
    ([(100, 500, 0.70), (100, 200, 0.99), (100, 300, 0.85)], 1, 0.95, "ani", [1]),
    ([(100, 200, 0.99), (100, 600, 0.50), (100, 350, 0.75)], 1, 0.95, "length", [1]),
    ([(100, 200, 0.95), (100, 400, 0.60), (100, 300, 0.80)], 1, 0.95, "length-ani", [1]),
    ([(100, 200, 0.95), (100, 1100, 0.60), (100, 600, 0.75)], 1, 0.95, "log-length-ani", [2]),
    ([(5, 5, 1.0), (0, 10, 1.0)], None, 0.95, "log-length-ani", [1]), ([(5, 5, 1.0)], None, 0.95, "log-length-ani", [0]),
    ([(9, 5, 1.0), (0, 10, 1.0)], 1, 0.95, "log-length-ani", [1]), ([(9, 5, 1.0)], 1, 0.95, "log-length-ani", [0]),
])
def test_literal_intervals(spark, intervals, k, limit, scoring, want):
    assert kept(spark, intervals, k, limit, scoring) == want


def test_both_axes(spark):
    rows = [("q", 100, 200, "t", 300, 400, 1.0), ("q", 100, 200, "t", 500, 600, 1.0), ("q", 300, 400, "t", 300, 400, 1.0), ("q", 500, 600, "t", 700, 800, 1.0)]
    assert ranks(sweep.sweep_both(mappings(spark, rows), ["query", "target"], 1, 1, 0.95)) == [0, 3]


def brute(start, end, score, rank, k, limit):
    """The rule itself, position by position."""
    n, good, bad = len(start), set(), set()
    for p in sorted({*start, *end}):
        live = sorted((m for m in range(n) if start[m] <= p < end[m]), key=lambda m: (-score[m], start[m], rank[m]))
        top, rest = live[:k], live[k:]
        good |= set(top)
        for m in rest:
            for b in top:
                if limit < 1 and (min(end[m], end[b]) - max(start[m], start[b])) / min(end[m] - start[m], end[b] - start[b]) > limit:
                    bad.add(m)
    return [m in good and m not in bad for m in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_marks_match_the_rule(seed):
    g = random.Random(seed)
    for _ in range(25):
        n = g.randint(2, 12)
        s = [g.randint(0, 30) for _ in range(n)]
        e = [x + g.randint(0, 12) for x in s]
        score = [g.choice([1.0, 2.0, 3.0]) for _ in range(n)]
        k, limit = g.randint(1, 3), g.choice([0.0, 0.3, 0.5, 0.95, 1.0])
        got = sweep.mark(np.array(s), np.array(e), np.array(score), np.arange(n), k, limit)
        assert got.tolist() == brute(s, e, score, range(n), k, limit)


def test_partitioning_changes_nothing(spark):
    g = random.Random(5)
    rows = [(f"A#1#c{g.randint(0, 2)}", s := g.randint(0, 3000), s + g.randint(0, 400), f"B#1#c{g.randint(0, 2)}", t := g.randint(0, 3000), t + g.randint(1, 400), g.choice([0.9, 0.95, 1.0])) for _ in range(400)]
    found, old = set(), spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.add(tuple(ranks(sweep.sweep(mappings(spark, rows), ["query", "target"], "query", 2, 0.5))))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(found) == 1


def test_small_batches_stream_the_same(spark):
    g = random.Random(6)
    rows = [("q", s := g.randint(0, 20000), s + g.randint(0, 300), "t", 0, 10, g.choice([0.9, 1.0])) for _ in range(300)]
    df = mappings(spark, rows)
    want = ranks(sweep.sweep(df, ["query"], "query", 1, 0.5))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    got = ranks(sweep.sweep(df, ["query"], "query", 1, 0.5))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    s, e = [r[1] for r in rows], [r[2] for r in rows]
    score = [0 if b <= a else round(r[6] * np.log(b - a), 9) for a, b, r in zip(s, e, rows)]
    assert got == want == [k for k, x in enumerate(brute(s, e, score, range(300), 1, 0.5)) if x]


def test_more_is_kept_with_a_larger_limit(spark):
    g = random.Random(9)
    rows = [("q", s := g.randint(0, 500), s + g.randint(1, 80), "t", 0, 10, 1.0) for _ in range(60)]
    sizes = [len(kept(spark, [(r[1], r[2], r[6]) for r in rows], k, 1.0)) for k in (1, 2, 3, None)]
    assert sizes == sorted(sizes)


def test_empty_table(spark):
    assert sweep.sweep_both(mappings(spark, []), ["query", "target"], 1, 1, 0.95).count() == 0


def test_greedy(spark):
    rows = [("q", 0, 100, "t", 0, 100, 1.0), ("q", 50, 120, "t", 0, 100, 1.0), ("q", 100, 150, "t", 0, 100, 1.0)]
    assert ranks(sweep.greedy_non_overlapping(mappings(spark, rows), ["query"])) == [0, 2]


def test_marks_at_starts():
    s, e = np.array([0, 50, 200, 210]), np.array([100, 150, 300, 260])
    assert sweep.mark_at_starts(s, e, np.array([3.0, 2.0, 1.0, 5.0]), np.arange(4), 1, 0.3).tolist() == [True, False, False, True]
    assert sweep.mark_at_starts(s, e, np.array([3.0, 2.0, 1.0, 5.0]), np.arange(4), 2, 1.0).tolist() == [True] * 4


@pytest.mark.parametrize("seed", range(30))
def test_streamed_sweep_matches_the_rule(seed):
    """Any cut of the rows into batches gives the rule's flags, group by group."""
    import pyarrow as pa

    g = random.Random(seed)
    rows, want = [], {}
    for group in range(6):
        n = g.randint(1, 30)
        own = sorted([(x := g.randint(0, 40), x + g.randint(-1, 12), g.choice([1.0, 2.0, 3.0]), 100 * group + r) for r in range(n)], key=lambda r: (r[0], r[3]))
        k, limit = seed % 3 + 1, [0.0, 0.3, 0.5, 0.95, 1.0][seed % 5]
        flags = brute([r[0] for r in own], [r[1] for r in own], [r[2] for r in own], [r[3] for r in own], k, limit)
        want |= {r[3]: f or n == 1 for r, f in zip(own, flags)}
        rows += [("g", group, *r) for r in own]
    t = pa.table({c: [r[i] for r in rows] for i, c in enumerate(("a", "b", "s", "e", "_score", "rank"))}).append_column("kept", pa.array([False] * len(rows)))
    at = 0
    batches = []
    while at < len(rows):
        size = g.randint(1, 9)
        batches += t.slice(at, size).combine_chunks().to_batches()
        at += size
    got = {r["rank"]: r["kept"] for b in sweep._flagged(["a", "b"], "s", "e", "kept", k, limit)(iter(batches)) for r in b.to_pylist()}
    assert got == want


def test_one_long_island_is_held_only_where_it_is_active():
    import pyarrow as pa

    n = 20_000  # each overlaps the next ones: one island
    t = pa.table({"q": ["x"] * n, "s": list(range(0, 10 * n, 10)), "e": list(range(35, 10 * n + 35, 10)), "_score": [float(k % 7) for k in range(n)], "rank": list(range(n)), "kept": [False] * n})
    most, out = 0, 0

    def watched():
        nonlocal most
        for k, b in enumerate(t.to_batches(max_chunksize=100)):
            most = max(most, 100 * k - out)
            yield b

    for b in sweep._flagged(["q"], "s", "e", "kept", 1, 0.5)(watched()):
        out += b.num_rows
    assert out == n and most < 10
