"""Operator 7, near-duplicates: SetSketch registers in bands, joint estimation by likelihood, then exact sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import renamed, small, small_batches, table, written

#: SetSketch with base B, rate A and registers 0 .. Q + 1.
B, A, Q = 1.001, 20.0, (1 << 16) - 2
#: Standard errors by which an estimate may lie under the threshold before a pair is let go.
SLACK = 5.0
#: Ids that are sent to all executors at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_POLY, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass(frozen=True)
class Rule:
    """Word shingles of a size, the least similarity num / den, and bands of rows registers."""

    size: int = 5
    num: int = 80
    den: int = 100
    bands: int = 40
    rows: int = 7

    @property
    def registers(self) -> int:
        return self.bands * self.rows


CONTRACT = Rule(3, 85, 100, 32, 8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the word polynomial's base and of its inverse, as far as any text has needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 1 << 16)
            one = np.ones(1, np.uint64)
            cls.up = np.concatenate((one, np.cumprod(np.full(n, _POLY), dtype=np.uint64)))
            cls.down = np.concatenate((one, np.cumprod(np.full(n, _INVERSE), dtype=np.uint64)))
        return cls.up, cls.down


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's word shingles; one of all words if they are fewer; none without words.

    Words are runs of bytes that aren't ASCII white space, A-Z in lower case. A word's hash is a difference of prefix
    sums, so a text of any length takes a few passes over its bytes.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _Powers.upto(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
    h = _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _M2)
    size = min(size, len(h))
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out = _mix(out * _POLY + h[k : len(h) - size + 1 + k])
    out = _mix(out + np.uint64(size))
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def _seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    s = _mix(np.arange(1, 2 * m + 1, dtype=np.uint64) * _POLY)
    return (s[:m] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (s[m:] >> np.uint64(32)).astype(np.uint32)


def sketch(found: np.ndarray, m: int) -> np.ndarray:
    """The SetSketch of a set: register i is floor(1 - log_B x), cut to 0 .. Q + 1, with x the least of exponential variates of rate A that the elements draw for i.

    The least variate comes from the least uniform number, so that is taken first; registers of a union are maxima.
    """
    mul, add = _seeds(m)
    low, high = found.astype(np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(m, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(found), 512):
        x = low[at : at + 512, None] * mul
        x += add
        x ^= x >> np.uint32(15)
        x += high[at : at + 512, None]
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(least, x.min(0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**32
    return np.clip(np.floor(1 - np.log(-np.log1p(-u) / A) / np.log(B)), 0, Q + 1).astype(np.uint16)


def band_keys(registers: np.ndarray, rule: Rule) -> np.ndarray:
    r = registers.reshape(rule.bands, rule.rows).astype(np.uint64)
    h = np.arange(rule.bands, dtype=np.uint64) * _M1
    for k in range(rule.rows):
        h = _mix(h * _POLY + r[:, k])
    return h.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches (rows) with known set sizes, by maximum likelihood.

    The chance that a register of the first set is the larger is p(u - vJ), of the second p(v - uJ), with u, v the sets'
    shares of the sum of sizes and p(x) = -log_B(1 - x (B - 1) / B); the likelihood of the counts is concave in J.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    def value(j: np.ndarray) -> np.ndarray:
        one, two = p(u - v * j), p(v - u * j)
        f = lambda n, q: n * np.log(np.maximum(q, 1e-300))
        return f(more, one) + f(less, two) + f(same, 1 - one - two)

    for _ in range(30):
        c, d = lo + 0.382 * (hi - lo), lo + 0.618 * (hi - lo)
        left = value(c) >= value(d)
        lo, hi = np.where(left, lo, c), np.where(left, d, hi)
    return (lo + hi) / 2


def _profiles(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {k: [] for k in ("n", "s1", "s2", "registers", "keys")}
            for text in b.column("text").to_pylist():
                s = shingles(text, rule.size)
                r = sketch(s, rule.registers) if len(s) else np.zeros(0, np.uint16)
                out["n"].append(len(s))
                with np.errstate(over="ignore"):
                    out["s1"].append(int(_mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    out["s2"].append(int((_mix(s + _POLY) * _M2).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                out["registers"].append(r.astype("<u2").tobytes())
                out["keys"].append(band_keys(r, rule) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), *(pa.array(out[k], pa.int64()) for k in ("n", "s1", "s2")), pa.array(out["registers"], pa.binary()), pa.array(out["keys"], pa.list_(pa.int64()))],
                ["id", "n", "s1", "s2", "registers", "keys"])

    return run


def _estimated(rule: Rule):
    low = rule.num / rule.den
    low -= SLACK * (low * (1 - low) / rule.registers) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(b.num_rows, -1) for c in ("ra", "rb"))
            na, nb = (b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("na", "nb"))
            found = estimate(one, two, na, nb)
            good = np.flatnonzero(found >= low)
            if len(good):
                yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(good)), b.column("b").take(pa.array(good)), pa.array(found[good])], ["a", "b", "guess"])

    return run


def _verified(rule: Rule):
    """(a, b, linked) of pairs from their whole texts; pairs with one ``b`` come together where a sorted join made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            linked = []
            for b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("b", "ta", "tb")), strict=True):
                if b != last[0]:
                    last = (b, shingles(tb, rule.size))
                one, two = shingles(ta, rule.size), last[1]
                both = len(np.intersect1d(one, two, assume_unique=True))
                union = len(one) + len(two) - both
                linked.append(union > 0 and rule.den * both >= rule.num * union)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def _differing(rule: Rule):
    """(a, b, na, nb, m, d): the m shingles that only one of the texts a and b has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            na, nb, d = [], [], []
            for b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("b", "ta", "tb")), strict=True):
                if b != last[0]:
                    last = (b, shingles(tb, rule.size))
                one = shingles(ta, rule.size)
                na.append(len(one))
                nb.append(len(last[1]))
                d.append(np.setxor1d(one, last[1], assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(na, pa.int64()), pa.array(nb, pa.int64()), pa.array([len(x) for x in d], pa.int64()), pa.array(d, pa.list_(pa.int64()))], ["a", "b", "na", "nb", "m", "d"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over undirected ``edges`` (a, b); ids without an edge are absent.

    Each round, every node tells its neighbours the least id it knows, the node of that id hears of any lesser one, and
    then every node takes the label of its label, which keeps rounds logarithmic on paths (a path of 1,000 ids takes 10).
    Labels only fall, and rounds end when nothing is told anew. Exchanges are aggregations by node with partial minima or
    joins on a node; labels of labels are only those that differ, broadcast behind a count, so a node with many edges or
    a label of many nodes is no burden. Each round is written to the shared folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = written(both, "cc-edges")
    label = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("c")), "cc-label")
    while True:
        told = both.join(label, both["a"] == label["id"]).groupBy(F.col("b").alias("id")).agg(F.min("c").alias("n"))
        heard = told.join(label, "id").select("id", "c", F.least("c", "n").alias("n"))
        said = heard.select(F.explode(F.array(F.struct(F.col("id"), F.col("n").alias("c"), F.col("c").alias("was")), F.struct(F.col("c").alias("id"), F.col("n").alias("c"), F.lit(None).cast("long").alias("was")))).alias("x"))
        new = written(said.groupBy("x.id").agg(F.min("x.c").alias("c"), F.max("x.was").alias("was")), "cc-label")
        if not new.filter("c <> was").limit(1).count():
            return new.select("id", F.col("c").alias("component"))
        label = new.select("id", "c")
        lesser = label.filter("c < id").select(F.col("id").alias("c"), F.col("c").alias("cc")).join(label.select("c").distinct(), "c", "left_semi")
        lesser = written(lesser, "cc-lesser")
        if lesser.limit(1).count():
            label = written(label.join(small(lesser), "c", "left").select("id", F.coalesce("cc", "c").alias("c")), "cc-label")


def _guess(pairs: DataFrame, profiles: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, guess) of candidate pairs whose sizes and likelihood estimate don't rule a link out."""
    near = f"least(na, nb) * {rule.den} >= greatest(na, nb) * {rule.num}"
    r = profiles.select("id", "n", "registers")
    two = pairs.join(r.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra")), "a")
    two = two.join(r.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb")), "b").filter(near)
    return written(two.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimated(rule), "a long, b long, guess double"), "near-pairs")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, ta, tb) of pairs of ids. Only texts that are named are moved; ids are counted before they are broadcast."""
    named = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "near-named")
    of = written(texts.join(small(named, BROADCAST_IDS), "id", "left_semi").select("id", "text"), "near-texts")
    full = pairs.join(of.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(of.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return full.select("a", "b", "ta", "tb")


def _links(pairs: DataFrame, profiles: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that are linked: likelihood estimates let go what is clearly below, whole sets decide on the rest."""
    near = _guess(pairs, profiles, rule).select("a", "b")
    return written(_with_texts(near, texts).mapInArrow(_verified(rule), "a long, b long, linked boolean").filter("linked").select("a", "b"), "near-links")


def _rest_links(open_rows: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The links (a, b) between members of one group that are in different components; ``open_rows``: (v, a, c), a member of group v in component c.

    Exact, and without the pairs of a group. With D(x) what differs between x and the group's reference text v, two
    members differ in ``|D(a)| + |D(b)| - 2 common(a, b)`` shingles, so with W(x) = (den + num) |D(x)| - (den - num) |x| they
    are linked if and only if ``2 (den + num) common(a, b) >= W(a) + W(b)``. A member with W at most (den - num) |v| is
    linked with v. Any other one (an outer one) needs a partner with which it has differences in common, of which v knows
    nothing: those that only one member has are left out, and the rarest first, of the member with the lesser W as many
    are looked up as the least number in common demands (a prefix), by as many of the outer one. What
    each place in both lists still allows in common is part of the join, then whole lists decide.
    """
    whole, off = rule.den + rule.num, rule.den - rule.num
    named = open_rows.filter("a <> v").select("a", F.col("v").alias("b")).distinct()
    made = written(_with_texts(named, texts).mapInArrow(_differing(rule), "a long, b long, na long, nb long, m long, d array<long>"), "near-differences")
    weighed = made.withColumn("w", whole * F.col("m") - off * F.col("na")).withColumn("outer", F.col("w") > off * F.col("nb"))
    direct = weighed.filter("not outer").select("a", "b")

    each = made.select(F.col("b").alias("v"), "a", F.explode("d").alias("e"))
    common = each.groupBy("v", "e").agg(F.count("*").alias("f")).filter("f > 1")
    lists = each.join(common, ["v", "e"]).groupBy("v", "a").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("d"))
    rows = weighed.select(F.col("b").alias("v"), "a", F.col("na").alias("n"), F.col("nb").alias("nv"), "w", "outer")
    rows = written(rows.join(lists, ["v", "a"]).join(open_rows.select("v", "a", "c").distinct(), ["v", "a"]).withColumn("m", F.size("d")), "near-lists")

    def prefix(least: str, names: str) -> DataFrame:
        some = rows.withColumn("p", F.expr(f"m - greatest(1, cast(ceil({least}) as bigint)) + 1")).filter("p > 0")
        return some.select("v", "a", "n", "w", "m", "c", F.posexplode(F.slice("d", F.lit(1), F.col("p").cast("int"))).alias("at", "x")).select("v", F.col("x.e").alias("e"), *(F.col(k).alias(f"{k}{names}") for k in ("a", "n", "w", "m", "c", "at")))

    low = prefix(f"(w + greatest(w, {off} * nv + 1)) / {2 * whole}", "1")
    high = prefix(f"(w - {off} * floor(n * {rule.den} / {rule.num})) / {whole}", "2").join(rows.filter("outer").select("v", F.col("a").alias("a2")), ["v", "a2"], "left_semi")
    fits = F.expr(f"c1 <> c2 and (w1 < w2 or w1 = w2 and a1 < a2) and least(n1, n2) * {rule.den} >= greatest(n1, n2) * {rule.num} and {2 * whole} * least(m1 - at1, m2 - at2) >= w1 + w2")
    met = written(low.join(high, ["v", "e"]).filter(fits).select("v", "a1", "a2").distinct(), "near-met")
    side = lambda k: rows.select("v", F.col("a").alias(f"a{k}"), F.col("w").alias(f"w{k}"), F.col("d").alias(f"d{k}"))
    decided = met.join(side(1), ["v", "a1"]).join(side(2), ["v", "a2"]).filter(F.expr(f"{2 * whole} * size(array_intersect(d1, d2)) >= w1 + w2"))
    return written(direct.unionByName(decided.select(F.col("a1").alias("a"), F.col("a2").alias("b"))), "near-rest")


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    1. Texts with one and the same shingle set are a class (a 128-bit sum of its hashes); its least id stands for it.
    2. Classes get SetSketch registers; bands of registers are buckets. The centre of a bucket is the member whose buckets
       are the largest, the least id of equal ones. Each class is paired with the centres of its buckets. Pairs whose sizes allow
       the similarity are estimated by likelihood; what isn't clearly below is compared on whole sets. Links make components.
    3. Where members of a bucket beside its centre are still in several components, the links between them are found
       from what each differs in from one reference text, the bucket's centre or the largest one that is linked with it
       (:func:`_rest_links`), exactly.
    So a candidate is let go without an exact comparison only beside a centre from which its estimate lies SLACK standard
    errors under the threshold, and a group of near copies is never spread out into its pairs.

    Null or empty text, or only white space: no shingles, component of its own. Null ids get null components and are
    kept. Rows with equal ids must have one text; they are one document here. An empty table gives no rows. Other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = written(texts.mapInArrow(_profiles(rule), "id long, n long, s1 long, s2 long, registers binary, keys array<long>"), "near-profiles")
    same = ["n", "s1", "s2"]
    heads = written(made.filter("n > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("head")), "near-heads")
    profiles = made.join(heads.select(F.col("head").alias("id")), "id", "left_semi")
    twice = written(made.filter("id is not null").groupBy("id").count().filter("count > 1").select("id"), "near-twice")
    if twice.limit(1).count():
        profiles, texts = (d.join(small(twice), "id", "left_anti").unionByName(d.join(small(twice), "id", "left_semi").dropDuplicates(["id"])) for d in (profiles, texts))

    rows = profiles.select("id", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    shared = written(rows.join(buckets, "key"), "near-shared")  # members of buckets with two ids or more
    mass = shared.groupBy("id").agg(F.sum("m").alias("mass"))
    centres = shared.join(mass, "id").groupBy("key").agg(F.max(F.struct("mass", (-F.col("id")).alias("x"))).alias("top"))
    centres = written(centres.select("key", (-F.col("top.x")).alias("centre"), F.col("top.mass").alias("mass")), "near-centres")
    of = written(shared.select("key", "id").join(centres, "key").filter("id <> centre"), "near-members")
    star = written(of.select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct(), "near-star")
    links = _links(star, profiles, texts, rule)
    found = components(links)

    known = of.join(found, "id", "left").withColumn("c", F.coalesce("component", "id"))
    mixed = known.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("key")
    higher = links.join(centres.groupBy(F.col("centre").alias("b")).agg(F.max("mass").alias("mass")), "b").groupBy(F.col("a").alias("centre")).agg(F.max_by("b", F.struct("mass", -F.col("b"))).alias("above"))
    reference = centres.join(mixed, "key").join(higher, "centre", "left").select("key", F.coalesce("above", "centre").alias("v"))
    open_rows = known.join(written(reference, "near-references"), "key").select("v", F.col("id").alias("a"), "c").distinct()
    open_rows = written(open_rows, "near-open")
    if open_rows.limit(1).count():
        c = lambda k: found.select(F.col("id").alias(k), F.col("component").alias(f"c{k}"))
        rest = _rest_links(open_rows, texts, rule).join(c("a"), "a", "left").join(c("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        more = components(rest.filter("a <> b").distinct())
        label = more.withColumnsRenamed({"id": "old", "component": "new"})
        # components that were joined, and ids that were alone until now
        joined = found.join(label, found["component"] == label["old"], "left").select("id", F.coalesce("new", "component").alias("component"))
        found = joined.unionByName(more.join(found.select("id"), "id", "left_anti"))

    named = heads.join(found, heads["head"] == found["id"], "left").select(*same, F.coalesce("component", "head").alias("component"))
    out = made.select("id", *same).join(named, same, "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``docs``, all columns, without near-duplicates: of each component the row with the least id stays, once; rows with null ids stay.

    Texts are moved only of ids that come more than once, or if there are more than BROADCAST_IDS ids to drop.
    """
    rows, own = renamed(docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("id")).filter("id is not null")
    again = small(written(ids.groupBy("id").count().filter("count > 1").select("id"), "near-again"), BROADCAST_IDS)
    gone = near_duplicates(docs, rule).filter("not kept").select(F.col("doc_id").alias("id")).distinct()
    rows = rows.withColumn("id", F.col(own["doc_id"]).cast("long"))
    left = rows.join(small(written(gone, "near-gone"), BROADCAST_IDS), "id", "left_anti")
    once = left.join(again, "id", "left_semi").withColumn("_nth", F.row_number().over(W.partitionBy("id").orderBy("id"))).filter("_nth = 1").drop("_nth")
    out = left.join(again, "id", "left_anti").unionByName(once)
    return out.select(*(F.col(v).alias(k) for k, v in own.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), CONTRACT)
