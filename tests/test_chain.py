import random

import numpy as np
import pytest

from spanweave.operators import chain

from .helpers import mappings


def naive_links(rows, forward, gap):
    """The same choice, mapping by mapping, in plain loops."""
    best, links = {}, {}
    for i, (qs, qe, ts, te) in enumerate(rows):
        pick = None
        for j in range(i + 1, len(rows)):
            s, _, u, v = rows[j]
            if s > qe + gap:
                break
            far = []
            for ahead in (s - qe, u - te if forward else ts - v):
                far.append(ahead if ahead >= 0 else -ahead if -ahead <= gap // 5 else gap + 1)
            d = far[0] ** 2 + far[1] ** 2
            if max(far) <= gap and (pick is None or d < pick[0]) and d < best.get(j, float("inf")):
                pick = (d, j)
        if pick:
            best[pick[1]], links[pick[1]] = pick[0], i
    return sorted((i, j) for j, i in links.items())


@pytest.mark.parametrize("seed", range(30))
def test_links_match_plain_loops(seed):
    g = random.Random(seed)
    for _ in range(20):
        rows = sorted(((s := g.randint(0, 200), s + g.randint(1, 40), t := g.randint(0, 200), t + g.randint(1, 40)) for _ in range(g.randint(1, 15))), key=lambda r: r[0])
        a = np.array(rows, np.int64)
        for forward in (True, False):
            assert sorted(chain.best_links(a[:, 0], a[:, 1], a[:, 2], a[:, 3], forward, 50)) == naive_links(rows, forward, 50)


def chains(spark, rows, gap):
    t = chain.chain_table(chain.chain_members(mappings(spark, rows), gap))
    return sorted((r["query_start"], r["query_end"], r["members"]) for r in t.collect())


def test_nearest_and_overlap(spark):
    near = [("q", a, b, "t", a, b, 1.0) for a, b in ((0, 1000), (1100, 2100), (5000, 6000))]
    assert chains(spark, near, 10_000) == [(0, 6000, 3)]
    over = [("q", a, b, "t", a, b, 1.0) for a, b in ((0, 1000), (900, 1900), (1100, 2100))]
    assert chains(spark, over, 10_000) == [(0, 2100, 3)]
    assert chains(spark, near, 2000) == [(0, 2100, 2), (5000, 6000, 1)]


def test_strands_apart_and_reverse_goes_back(spark):
    rows = [("q", 0, 100, "t", 500, 600, 1.0, "-"), ("q", 110, 200, "t", 390, 480, 1.0, "-"), ("q", 110, 200, "t", 610, 700, 1.0, "+")]
    assert chains(spark, rows, 50) == [(0, 200, 2), (110, 200, 1)]


def test_weighted_identity(spark):
    rows = [("q", 0, 1000, "t", 0, 1000, 0.9), ("q", 2000, 3000, "t", 2000, 3000, 0.8)]
    got = chain.chain_table(chain.chain_members(mappings(spark, rows), 10_000)).first()
    assert got["span"] == 3000 and got["identity"] == pytest.approx(1700 / (2000 + np.log(1000)))


def test_union_by_rank():
    s = chain.Sets(5)
    s.join(0, 1)
    s.join(2, 3)
    s.join(1, 3)
    assert s.root(3) == 0 and s.groups() == [[0, 1, 2, 3], [4]]


def test_windows(spark):
    rows = [("q", 0, 100, "t", 0, 100, 0.8), ("q", 150, 250, "t", 150, 250, 1.0), ("q", 900, 950, "t", 900, 950, 1.0)]
    df = mappings(spark, rows)
    assert sorted((r["members"], round(r["identity"], 3)) for r in chain.merge_near(df, 60).collect()) == [(1, 1.0), (2, 0.9)]
    assert sorted(r["members"] for r in chain.merge_close(df, 100).collect()) == [1, 2]
    assert [r["run"] for r in chain.chain_query_gaps(df, 60).orderBy("rank").collect()] == [0, 0, 1]
    assert [r["run"] for r in chain.chain_adjacent(df, 60).orderBy("rank").collect()] == [0, 0, 1]
    t = chain.chain_transitive(df, 60)
    assert t.select(*chain.CHAIN).distinct().count() == 2


def test_merge_close_measures_gaps_from_the_run_itself(spark):
    """A long mapping of an earlier run hides no gap of a later one."""
    rows = [("q", 0, 10000, "t", 0, 1000, 1.0), ("q", 100, 200, "t", 5000, 5100, 1.0), ("q", 400, 500, "t", 5150, 5250, 1.0)]
    assert sorted(r["members"] for r in chain.merge_close(mappings(spark, rows), 100).collect()) == [1, 1, 1]


def test_merge_close_reverse_keeps_the_greatest_start(spark):
    rows = [("q", 0, 100, "t", 500, 600, 1.0, "-"), ("q", 110, 200, "t", 420, 510, 1.0, "-")]
    got = chain.merge_close(mappings(spark, rows), 100).first()
    assert (got["query_start"], got["query_end"], got["target_start"], got["target_end"], got["members"]) == (0, 200, 500, 600, 2)


def test_merge_near_breaks_at_a_strand_change(spark):
    rows = [("q", 0, 100, "t", 0, 100, 1.0), ("q", 110, 210, "t", 110, 210, 1.0, "-"), ("q", 220, 320, "t", 220, 320, 1.0)]
    assert sorted(r["members"] for r in chain.merge_near(mappings(spark, rows), 500).collect()) == [1, 1, 1]
