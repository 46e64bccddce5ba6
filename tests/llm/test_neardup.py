import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from spanweave.llm import neardup
from spanweave.llm.common import table

from .conftest import DOCS, ODD, untouched


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(docs, rule):
    """{id: (n, component)} from all pairs that share a shingle."""
    sets = {i: shingle_set(t, rule.size) for i, t in docs}
    at, up = defaultdict(set), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            at[x].add(i)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        for j in {j for x in s for j in at[x] if j < i}:
            both = len(s & sets[j])
            if rule.den * both >= rule.num * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def families(seed, n=40, size=12):
    g = random.Random(seed)
    word = lambda: "".join(g.choice("abcdefghijklmnop") for _ in range(5))
    out = []
    for _ in range(n):
        base = [word() for _ in range(g.randint(5, 150))]
        for _ in range(g.randint(1, size)):
            w = list(base)
            for _ in range(g.randint(0, max(1, len(w) // 25))):
                w[g.randrange(len(w))] = word()
            out.append(" ".join(w))
    g.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("rule", "seed"), [(neardup.CONTRACT, 1), (neardup.Rule(), 2)])
def test_components_match_all_pairs(spark, rule, seed):
    docs = families(seed)
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in docs], DOCS)
    want = brute(docs, rule)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, rule).collect()}
    assert got == want


def test_documents_match_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.query(spark, sf).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute(docs, neardup.CONTRACT).items()}


def test_odd(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["component_id"] == by[4]["component_id"] == 0 and by[1]["n_shingles"] == by[2]["n_shingles"] == by[3]["n_shingles"] == 0 and by[2]["kept"] and by[None]["kept"]
    kept = neardup.keep_first(odd)
    assert untouched(kept.collect())
    assert kept.columns == odd.columns and sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, i) for i in (0, 1, 2, 3, 5, 7, 8, 9)] + [(True, None)]
    assert neardup.near_duplicates(none).count() == 0 and neardup.keep_first(none).count() == 0


def test_sketches_merge_and_estimate():
    g = np.random.default_rng(1)
    x = g.integers(0, 2**63, 900).astype(np.uint64)
    a, b = x[:600], x[300:]
    one, two, both = (neardup.sketch(s, 256) for s in (a, b, x))
    assert (np.maximum(one, two) == both).all()
    got = neardup.estimate(one[None], two[None], np.array([600.0]), np.array([600.0]))[0]
    assert abs(got - 1 / 3) < 0.12
    assert neardup.estimate(one[None], one[None], np.array([600.0]), np.array([600.0]))[0] > 0.99


def test_shingles():
    assert len(neardup.shingles("", 3)) == 0 and len(neardup.shingles(" \n", 3)) == 0 and len(neardup.shingles("a b", 3)) == 1
    same = [neardup.shingles(t, 3) for t in ("A  b\tC d", "a b c D", "a b\x0bc d")]
    assert all((s == same[0]).all() for s in same) and len(same[0]) == 2
    assert (neardup.shingles("ab c d", 3) != neardup.shingles("a bc d", 3)).all() and (neardup.shingles("Ä b c", 3) != neardup.shingles("ä b c", 3)).all()


def test_components(spark):
    n = 40
    edges = [(i, i + 1) for i in range(n)] + [(100, 101), (101, 105), (200, 200)]
    got = {r["id"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100, 105: 100}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("shuffled", [False, True])
def test_components_of_a_long_path(spark, shuffled):
    ids = list(range(1500))
    if shuffled:
        random.Random(5).shuffle(ids)
    rows = neardup.components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")).collect()
    assert sorted((r["id"], r["component"]) for r in rows) == [(i, 0) for i in range(1500)]


@pytest.mark.parametrize("rule", [neardup.CONTRACT, neardup.Rule()])
def test_estimates_well_under_the_threshold_are_still_compared(rule):
    m, t = rule.registers, rule.num / rule.den
    differ = round(m * (1 - t + 4.5 * (t * (1 - t) / m) ** 0.5) / 2)
    a = np.full(m, 30000, "<u2")
    b = a.copy()
    b[:differ] += 500
    b[differ : 2 * differ] -= 500
    batch = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "na": [500], "nb": [500], "ra": [a.tobytes()], "rb": [b.tobytes()]})
    assert [x.num_rows for x in neardup._estimated(rule)([batch])] == [1]
