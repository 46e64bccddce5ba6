"""Mixing, sharding, quality rules and URL lists."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.llm import mix, rules, shard, urls
from spanweave.llm.common import table, written

from .conftest import CLASHES, DOCS, ODD, untouched

SF = "/root/testdata/sf0.001"


def share(budget, caps):
    """Water-filling in plain loops: {name: (weight, cap)} -> {name: amount}, exact."""
    out, left = {}, dict(caps)
    while left:
        level = budget / sum(w for w, _ in left.values())
        full = {n: c for n, (w, c) in left.items() if c <= w * level}
        if not full:
            return out | {n: w * level for n, (w, _) in left.items()}
        out |= full
        budget -= sum(full.values())
        left = {n: x for n, x in left.items() if n not in full}
    return out


def test_budgets_match_plain_loops(spark):
    rows = [("d1", "en", "a", 100), ("d1", "en", "b", 10), ("d1", "de", "c", 500), ("d2", "en", "e", 5), ("d2", "fr", "f", 0), ("d3", "en", "g", 4000)]
    supply = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    weights = {"d1": 3, "d2": 5, "d3": 2}, {"en": 2, "de": 1}, {"a": 1, "b": 4}
    got = {(r["domain"], r["lang"], r["source"]): r["alloc"] for r in mix.leaf_budgets(supply, *weights, max_epochs=2, budget=(1, 3)).collect()}
    cap = defaultdict(int)
    for d, la, s, t in rows:
        for k in ((d,), (d, la), (d, la, s)):
            cap[k] += 2 * t
    w = lambda m, n: m.get(n, 1)
    top = share(sum(r[3] for r in rows) // 3, {(d,): (w(weights[0], d), cap[d,]) for d in {r[0] for r in rows}})
    for (d,), b in top.items():
        for key, c in share(int(b), {(d, la): (w(weights[1], la), cap[d, la]) for la in {r[1] for r in rows if r[0] == d}}).items():
            for leaf, a in share(int(c), {(*key, s): (w(weights[2], s), cap[(*key, s)]) for s in {r[2] for r in rows if r[:2] == key}}).items():
                assert abs(got[leaf] - a) <= 1, (leaf, got[leaf], a)


def test_shortage_goes_to_siblings_first(spark):
    rows = [("d1", "en", "a", 10), ("d1", "en", "b", 1000), ("d2", "en", "c", 1000)]
    supply = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["alloc"] for r in mix.leaf_budgets(supply, {}, {}, {}, 1, (1, 2)).collect()}
    assert got["a"] == 10 and got["b"] == 492 and got["c"] == 502


def test_mix_prefixes(spark):
    docs = table(spark, SF, "documents")
    out = mix.mix(docs).select("domain", "lang", "source", "doc_id", "tokens", "copies").collect()
    assert len(out) == docs.count() and sum(r["tokens"] * r["copies"] for r in out) <= sum(r["tokens"] for r in out) // 2
    by = defaultdict(list)
    for r in out:
        by[r["domain"], r["lang"], r["source"]].append(r["copies"])
    assert all(max(c) - min(c) <= 1 and max(c) <= 4 for c in by.values())


def test_mix_odd(odd, none):
    rows = mix.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r["copies"] >= 0 for r in rows) and untouched(rows)
    assert len({r["copies"] for r in rows if r["doc_id"] == 5}) == 1
    assert mix.mix(none).count() == 0


def law(rows, n, shards=16):
    count = Counter(r["shard"] for r in rows)
    assert max(count[k] for k in range(shards)) - min(count[k] for k in range(shards)) <= 1 and sum(count.values()) == n
    for k in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(count[k]))


def test_shards(spark):
    docs = table(spark, SF, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    rows = shard.query(spark, SF).collect()
    law(rows, len(text))
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) and r["law"] == "rows" and r["grown_shard"] is None for r in rows)
    for s, n in Counter(source.values()).items():
        mine = Counter(r["shard"] for r in rows if source[r["doc_id"]] == s)
        assert all(abs(mine[k] - n / 16) <= 2 for k in range(16))
    again = shard.shard(docs.repartition(7)).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in rows}


def test_shards_match_plain_ranks(spark):
    """Every row's place from ranks of one sorted list for each source and one of all rows."""
    import struct

    import xxhash

    seed = xxhash.xxh64_intdigest(struct.pack("<i", 20240607), seed=42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    docs = [(r["doc_id"], r["source"]) for r in table(spark, SF, "documents").collect()]
    by = defaultdict(list)
    for i, s in docs:
        by[s].append((xxhash.xxh64_intdigest(struct.pack("<q", i), seed=seed), i))
    line = []
    for s, own in by.items():
        u = (signed(xxhash.xxh64_intdigest(s.encode(), seed=seed)) % 1_000_003 + 0.5) / 1_000_003
        line += [((k + u) / len(own), s, signed(h), i) for k, (h, i) in enumerate(sorted(own))]
    want, first = {}, {}
    for place, (_, _, _, i) in enumerate(sorted(line)):
        k = place * 16 // len(docs)
        want[i] = k, place - first.setdefault(k, place)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in shard.query(spark, SF).collect()} == want


def test_write_shards(spark, tmp_path):
    docs = table(spark, SF, "documents").unionByName(spark.createDataFrame([(None, "x", "en", "src0", 1)], DOCS))
    placed = shard.shard(docs)
    shard.write_shards(docs, placed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    key = lambda r: (r["doc_id"] or -1, r["shard"], r["slot"])
    assert sorted(map(key, back.collect())) == sorted(map(key, placed.collect())) and back.filter("doc_id is null").count() == 1


def test_shards_odd(odd, none):
    rows = shard.shard(odd).collect()
    law(rows, len(ODD))
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert shard.shard(none).count() == 0


def counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    again = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)


def test_base_counts(spark, odd):
    for df in (table(spark, SF, "documents"), odd):
        for r in rules.base_counts(df).collect():
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == counts(r["text"]), r["doc_id"]


def test_rules_reject_outliers_and_keep_plain_text(spark):
    import random

    g = random.Random(1)
    word = lambda: "".join(g.choice("abcdefghij") for _ in range(g.randint(2, 8)))
    plain = [(k, " ".join(word() for _ in range(g.randint(30, 300))), "en", "s", 0) for k in range(300)]
    bad = [(1000 + k, " ".join(word() + "***" for _ in range(100)), "en", "s", 0) for k in range(20)]
    out = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(plain + bad, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert all(out[r[0]]["kept"] for r in plain) and not any(out[r[0]]["kept"] for r in bad)


def plain_mcd(x):
    """(location, scatter, least log determinant, steps) of one pool by plain matrix code: the same starts, cores and stops."""
    floor = np.eye(rules.P) * (rules.FLOOR * rules.UNIT) ** 2
    low = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]
    med = low(x)
    s = np.maximum(1.4826 * low(np.abs(x - med)), rules.FLOOR * rules.UNIT)
    z = (x - med) / s
    norm = (z * z).sum(1)
    b = np.floor(rules.BINS * np.log1p(norm))
    half, at, way = z[b <= low(b)], np.tanh(z), z[norm > 0] / np.sqrt(norm[norm > 0])[:, None]
    ridge = 1e-3 * np.eye(rules.P)
    best, steps = None, 0
    for r in (np.eye(rules.P), at.T @ at / len(z) + ridge, way.T @ way / len(z) + ridge, half.T @ half / len(half) + ridge):
        m, c, det = med, r * np.outer(s, s) + floor, np.inf
        while True:
            m2, c2, d2 = concentrated(x, m, c, floor)
            if d2 >= det - rules.STILL:
                break
            m, c, det, steps = m2, c2, d2, steps + 1
        if best is None or det < best[2]:
            best = m, c, det
    return *best, steps


def core_of(x, m, c):
    d = (np.linalg.solve(np.linalg.cholesky(c), (x - m).T) ** 2).sum(0)
    b = np.floor(rules.BINS * np.log1p(d))
    edge = np.sort(b)[-(-rules.CORE[0] * len(b) // rules.CORE[1]) - 1]
    return d, b <= edge, edge


def concentrated(x, m, c, floor):
    core = x[core_of(x, m, c)[1]]
    cov = np.cov(core.T, bias=True) + floor
    return core.mean(0), cov, np.linalg.slogdet(cov)[1]


def plain_features(docs):
    """{id: features} and {id: pool} of the rows (id, text, lang, source) that pass the base rules, text by text."""
    import math

    import regex

    marks, upper = regex.compile(r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]"), regex.compile(r"\p{Lu}")
    good = {}
    for i, t, la, s in docs:
        n, chars, _, _, _, failed = counts(t)
        if not failed:
            good[i] = la or "", s or "", n, chars, len(marks.findall(t)), len(upper.findall(t)), len(set(re.findall(r"[^\x20\x09-\x0D]+", t)))
    size = Counter((g[0], g[1]) for g in good.values())
    small = Counter()
    for (la, _), n in size.items():
        small[la] += n if n < rules.MIN_ROWS else 0
    pool = {i: (g[0], g[1]) if size[g[0], g[1]] >= rules.MIN_ROWS else g[0] if small[g[0]] >= rules.MIN_ROWS else None for i, g in good.items()}
    half = lambda x: int(math.floor(x + 0.5)) if x >= 0 else -int(math.floor(0.5 - x))  # noqa: E731  round half away from zero
    out = {}
    for p in set(pool.values()):
        own = [(i, good[i]) for i in good if pool[i] == p]
        if len(own) < rules.MIN_ROWS:
            continue
        words = sum(g[2] for _, g in own)
        rate = [sum(g[k] for _, g in own) / words for k in (3, 4, 5)]
        x, y = (np.array([half(100 * math.log(g[k])) for _, g in own], float) for k in (2, 6))
        power = ((x * y).mean() - x.mean() * y.mean()) / ((x * x).mean() - x.mean() ** 2)
        for i, g in own:
            shares = [math.log((g[k] + rules.PRIOR * r + more) / (g[2] + rules.PRIOR)) for k, r, more in ((3, rate[0], 0.0), (4, rate[1], 0.5), (5, rate[2], 0.5))]
            out[i] = [half(rules.UNIT * v) for v in (*shares, math.log(g[6]) - power * math.log(g[2]))]
    return out, pool


def plain_verdicts(docs):
    """{id: whether the row stays, None where its distance is at the cut} by plain code alone."""
    features, pool = plain_features(docs)
    out = {i: False for i, *_ in docs} | {i: True for i in pool}
    for p in {pool[i] for i in features}:
        ids = [i for i in features if pool[i] == p]
        x = np.array([features[i] for i in ids], float)
        m, c, _, _ = plain_mcd(x)
        d, _, edge = core_of(x, m, c)
        d = d / max(1.0, np.expm1((edge + 0.5) / rules.BINS) / rules.CHI_CORE)
        out |= {i: None if abs(far - rules.CUT) < 0.5 else bool(far <= rules.CUT) for i, far in zip(ids, d)}
    return out


def test_rules_match_plain_code(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = plain_verdicts([(r["doc_id"], r["text"] or "", r["lang"], r["source"]) for r in docs.collect()])
    got = {r["doc_id"]: r["kept"] for r in rules.judge(docs).collect()}
    assert got.keys() == want.keys() and all(want[i] is None or want[i] == k for i, k in got.items()) and sum(x is None for x in want.values()) < 10


def test_rules_match_plain_mcd(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    counted = written(rules._counted(docs, "text", "lang", "source"), "test-counts")
    pools, good = rules.featured(counted)
    by = defaultdict(list)
    for r in good.collect():
        by[r["pool"]].append([r[f"_q{i}"] for i in range(rules.P)])
    model, untouched = {}, {}
    for pool, v in by.items():
        x = np.array(v, float)
        m, c, _, steps = plain_mcd(x)
        assert steps >= 4
        d, _, edge = core_of(x, m, c)
        model[pool] = m, c, max(1.0, np.expm1((edge + 0.5) / rules.BINS) / rules.CHI_CORE)
        med = np.sort(x, axis=0)[(len(x) + 1) // 2 - 1]
        s = np.maximum(1.4826 * np.sort(np.abs(x - med), axis=0)[(len(x) + 1) // 2 - 1], 5)
        untouched[pool] = med, np.diag(s**2), max(1.0, np.expm1((core_of(x, med, np.diag(s**2))[2] + 0.5) / rules.BINS) / rules.CHI_CORE)
    assert len({round(float(np.linalg.slogdet(c)[1]), 2) for _, c, _ in model.values()}) == len(model)  # each pool has a scatter of its own
    got = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    rows = counted.join(pools.withColumnsRenamed({"lang": "_lang", "source": "_source"}), ["_lang", "_source"]).withColumns(rules._features()).filter("not base_failed").collect()
    assert len(rows) == sum(not r["base_failed"] for r in got.values())
    changed = 0
    for r in rows:
        x = np.array([r[f"_q{i}"] for i in range(rules.P)], float)
        far = lambda m, c, k: ((np.linalg.solve(np.linalg.cholesky(c), x - m)) ** 2).sum() / k  # noqa: B023, E731
        d = far(*model[r["pool"]])
        assert got[r["doc_id"]]["distance"] == pytest.approx(d, rel=1e-3, abs=2e-3), r["doc_id"]
        if abs(d - rules.CUT) > 0.1:
            assert got[r["doc_id"]]["kept"] == (d <= rules.CUT)
        changed += abs(far(*untouched[r["pool"]]) - d) > 0.1 * d
    assert changed > len(rows) / 2  # the steps matter


def test_rules_judge_each_pool_by_its_own_scatter(spark):
    import random

    g = random.Random(3)
    word = lambda low, high: "".join(g.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(g.randint(low, high)))
    tight = [(k, " ".join(word(5, 5) for _ in range(200)), "en", "tight", 0) for k in range(100)]
    wide = [(1000 + k, " ".join(word(n, n + 2) for _ in range(200)), "en", "wide", 0) for k in range(100) for n in [g.randint(5, 9)]]
    odd = [(5000, " ".join(word(7, 7) for _ in range(200)), "en", "tight", 0), (5001, " ".join(word(7, 7) for _ in range(200)), "en", "wide", 0)]
    out = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(tight + wide + odd, DOCS)).collect()}
    assert not out[5000]["kept"] and out[5001]["kept"] and sum(out[r[0]]["kept"] for r in tight + wide) >= 196


def test_chi_square():
    assert rules.chi_square(0.75) == pytest.approx(5.3853, abs=1e-4) and rules.chi_square(0.999) == pytest.approx(18.467, abs=1e-3)


def test_rules_odd(odd, none):
    rows = rules.judge(odd).collect()
    assert len(rows) == len(ODD) and all(r["kept"] is not None for r in rows) and not any(r["kept"] and r["base_failed"] for r in rows)
    kept = rules.keep(odd)
    after = kept.collect()
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in rows if r["kept"]) and untouched(after)
    assert rules.judge(none).count() == 0 and rules.keep(none).count() == 0


def test_rules_without_python(spark):
    df = rules.judge(table(spark, SF, "documents"))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


ENTRIES = [("l", "bad.com", "add", 10), ("l", "bad.com", "remove", 20), ("l", "bad.com", "add", 20), ("l", "bad.com", "remove", 90), ("l", "bad.com", "add", 95), ("m", "x.bad.com", "add", 0), ("l", None, "add", 1), ("m", "far.org", "add", 500), ("l", "BIG.net", "remove", 5), ("l", "again.io", "add", 1), ("l", "again.io", "add", 50), ("l", "again.io", "remove", 60)]


def as_of(host, day):
    found = {}
    parts = host.split(".")
    for name in {".".join(parts[k:]) for k in range(len(parts))}:
        for which in ("l", "m"):
            mine = sorted((d, {"remove": 0, "add": 1}[a]) for li, k, a, d in ENTRIES if li == which and k and k.lower() == name and d <= day)
            if mine and mine[-1][1]:
                found[which] = True
    return ",".join(sorted(found))


def test_urls_as_of(spark):
    hosts = ["bad.com", "x.bad.com", "notbad.com", "far.org", "big.net", "again.io", "a.b.c.again.io"]
    caps = [(k, f"https://U@{h.upper()}:80/p?q#f", d) for k, (h, d) in enumerate((h, d) for h in hosts for d in range(0, 120, 5))] + [(900, None, 5), (901, "nonsense", 5), (902, "http://bad.com/", None), (0, "https://bad.com/", 15), (0, "https://bad.com/", 15)]
    df = spark.createDataFrame(caps, "page_id long, url string, fetch_day long").withColumn("lists", F.lit("old")).withColumns({c: F.lit(k) for k, c in enumerate(CLASHES)})
    out = urls.filter_urls(df, spark.createDataFrame(ENTRIES, "list string, key string, action string, day long")).collect()
    assert len(out) == len(caps) and all(r[c] == k for r in out for k, c in enumerate(CLASHES) if c != "host")
    for r in out:
        want = "" if r["url"] in (None, "nonsense") or r["fetch_day"] is None else as_of(r["host"], r["fetch_day"])
        assert (r["lists"], r["blocked"]) == (want, want != ""), r
    since = {r["fetch_day"]: r["listed_since"] for r in out if r["host"] == "again.io"}
    assert since[55] == 1 and since[60] is None


def test_urls_empty(spark):
    none = spark.createDataFrame([], "list string, key string, action string, day long")
    df = spark.createDataFrame([(1, "http://a.b/", 3)], "page_id long, url string, fetch_day long")
    assert not urls.filter_urls(df, none).first()["blocked"] and urls.filter_urls(df.limit(0), none).count() == 0


@pytest.mark.parametrize(("url", "host"), [("http://A.b/c", "a.b"), ("https://u:p@h.org:8/x", "h.org"), ("ftp://h.", "h"), ("http://[2001:db8::1]:80/x", "2001:db8::1"), ("http://u@[::1]/", "::1"), ("mailto:x", ""), ("", "")])
def test_hosts(spark, url, host):
    assert spark.createDataFrame([(url,)], "u string").select(urls.host_of(F.col("u"))).first()[0] == host


@pytest.mark.parametrize("name", ["op1_mix", "op10_urls"])
def test_sql(spark, name):
    import duckdb

    from spanweave.llm.queries import ORACLES, QUERIES

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, sql = QUERIES[name](spark, SF), c.sql(ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(sql.columns)
    at = [sql.columns.index(x) for x in order]
    assert sorted(tuple(r[x] for x in order) for r in df.collect()) == sorted(tuple(r[k] for k in at) for r in sql.fetchall())


def test_a_step_of_the_rules_stays_small_below_a_filter(spark):
    """A filter on the determinant is pushed below the Cholesky factor; it must not spell out every element in the next."""
    rows = spark.createDataFrame([("all", *(i * k % 17 for k in range(1, rules.P + 1))) for i in range(40)], f"pool string, {', '.join(f'_q{i} long' for i in range(rules.P))}")
    first = rules._starts(rows, True)
    step = rules._step(rows, first, True).filter(F.col("det") < 1e9)
    plan = step._jdf.queryExecution().optimizedPlan()
    longest = max(len(line) for line in plan.toString().split("\n"))
    assert 1_000 < longest < 12_000
    assert step.count() == 4
