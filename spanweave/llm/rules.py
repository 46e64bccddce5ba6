"""Operator 8, quality rules: base rules and minimum-covariance-determinant outliers, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import NON_SPACE, SPACE, renamed, small, table, written

SYMBOLS = "#*$%&|<>"
#: A language's source with fewer rows is judged with the rest of its language, and that with all such rows; with fewer even then, by the base rules alone.
MIN_ROWS = 60
#: Words of prior weight that draw the rates of short texts to those of their pool.
PRIOR = 60
#: Features are whole thousandths, so that sums are exact in any order.
UNIT = 1000
P = 4
#: What a text's features resolve at best, in natural-log units: the standard deviation that is added to each feature, so that a pool of one and the same text has a scatter.
FLOOR = 0.005
#: The share of a pool's rows that carries its estimate, and the probability beyond which a chi-square distance is an outlier's.
CORE, OUTLIER = (3, 4), 1e-5
#: A concentration step goes on if the logarithm of the determinant falls by more.
STILL = 1e-6
#: Languages' sources up to which tables with four rows for each are broadcast; with more they are joined by shuffles.
FEW = 25_000
#: Bins of ln(1 + squared distance) per unit.
BINS = 200
_N = "_q"


def chi_square(p: float) -> float:
    """The ``p`` quantile of chi square with P = 4 degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - math.exp(-mid / 2) * (1 + mid / 2) < p else (low, mid)
    return low


CHI_CORE, CUT = chi_square(CORE[0] / CORE[1]), chi_square(1 - OUTLIER)


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and ``_distinct`` (different words), ``_marks`` (neither letter nor digit nor space) and ``_upper`` (capitals).

    All from the whole text, by array functions in the row: nothing is exploded or shuffled. Null text counts as empty.
    Repeated five-word windows are found by 64-bit hashes of their words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_t", text)
    out = out.withColumn("_w", F.transform(F.array_remove(F.split("_t", SPACE), ""), lambda w: F.xxhash64(w)))
    out = out.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(NON_SPACE)))
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
        "_distinct": F.size(F.array_distinct("_w")).cast("long"),
        "_marks": F.length(F.regexp_replace("_t", r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+", "")).cast("long"),
        "_upper": F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
    }).drop("_t", "_l")
    gram = lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(5)))
    out = out.withColumn("_g", F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.size("_w") - 5), gram)).otherwise(F.array().cast("array<bigint>"))).drop("_w")
    # only texts in which a window comes again sort their windows
    pairs = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    out = out.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), pairs)).drop("_g")
    same = lambda k, x: F.coalesce(F.get("_s", k)["g"] == x["g"], F.lit(False))
    again = F.filter("_s", lambda x, k: same(k - 1, x) | same(k + 1, x))
    out = out.withColumn("_p", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("_s")
    covered = F.aggregate(F.transform("_p", lambda x, k: F.least(F.lit(5), F.coalesce(F.get("_p", k + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _pooled(rows: DataFrame) -> DataFrame:
    """(lang, source) of ``rows`` with the pool that judges it, null without enough rows, and the pool's rates per word and the power of a text's words with which its different words grow."""
    x, y = (F.round(100 * F.log(F.col(c))).cast("long") for c in ("n_words", "_distinct"))
    sums = {"n": F.lit(1), "words": F.col("n_words"), "chars": F.col("word_chars"), "marks": F.col("_marks"), "upper": F.col("_upper"), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y}
    n = rows.groupBy("lang", "source").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    first = n.select("*", F.when(F.col("n") >= MIN_ROWS, F.concat_ws("\x1f", "lang", "source")).alias("_own"))
    rest = W.partitionBy("lang", F.col("_own").isNull())
    second = first.select("*", F.when(F.sum("n").over(rest) >= MIN_ROWS, F.col("lang")).alias("_lang"))
    named = second.select("lang", "source", *sums, F.coalesce(F.concat(F.lit("s\x1f"), "_own"), F.concat(F.lit("l\x1f"), "_lang"), F.lit("all")).alias("pool"))
    whole = named.groupBy("pool").agg(*(F.sum(k).alias(k) for k in sums)).filter(F.col("n") >= MIN_ROWS)
    mean = lambda k: F.col(k) / F.col("n")
    spread = mean("sxx") - mean("sx") * mean("sx")
    power = F.when(spread > 0, (mean("sxy") - mean("sx") * mean("sy")) / spread).otherwise(F.lit(0.0))
    whole = whole.select("pool", *((F.col(k) / F.col("words")).alias(f"r_{k}") for k in ("chars", "marks", "upper")), power.alias("power"))
    return named.select("lang", "source", "pool").join(whole, "pool")


def _features() -> dict[str, Column]:
    """Logarithms of characters, marks and capitals per word, and of different words beside what a text of its length has in its pool."""
    unit = lambda x: F.round(UNIT * x).cast("long")
    rate = lambda c, r, more: unit(F.log((F.col(c) + PRIOR * F.col(r) + more) / (F.col("n_words") + PRIOR)))
    return {
        f"{_N}0": rate("word_chars", "r_chars", 0.0),
        f"{_N}1": rate("_marks", "r_marks", 0.5),
        f"{_N}2": rate("_upper", "r_upper", 0.5),
        f"{_N}3": unit(F.log(F.col("_distinct")) - F.col("power") * F.log(F.col("n_words"))),
    }


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution through the Cholesky factor in columns _c*."""
    y: list[Column] = []
    for i in range(P):
        d = F.col(f"{_N}{i}") - F.col(f"_m{i}")
        for j in range(i):
            d = d - F.col(f"_c{i}{j}") * y[j]
        y.append(d / F.col(f"_c{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _bin(d2: Column) -> Column:
    return F.floor(BINS * F.log1p(d2)).cast("long")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once; as an element of an array it is never written out again where it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _factor(df: DataFrame, cov) -> DataFrame:
    """``df`` with the Cholesky factor _c* of the matrix ``cov(i, j)``, the floor added, and the logarithm of its determinant.

    Each element is bound to a name: as columns upon columns, a filter on the determinant that is pushed below them would
    spell out all of them in each other, in more code than a class can hold.
    """

    def rest(c: dict[tuple[int, int], Column]) -> Column:
        if len(c) == len(_PAIRS):
            det = sum((2 * F.log(c[i, i]) for i in range(1, P)), 2 * F.log(c[0, 0]))
            return F.struct(*(v.alias(f"_c{i}{j}") for (i, j), v in c.items()), det.alias("det"))
        i, j = _PAIRS[len(c)]
        v = F.greatest(cov(i, j), F.lit(0.0)) + (FLOOR * UNIT) ** 2 if i == j else cov(i, j)
        for k in range(j):
            v = v - c[i, k] * c[j, k]
        return _let(F.sqrt(F.greatest(v, F.lit(1e-6))) if i == j else v / c[j, j], lambda x: rest(c | {(i, j): x}))

    return df.withColumn("_f", rest({})).select("*", "_f.*").drop("_f")


_PARAMS = [*(f"_m{i}" for i in range(P)), *(f"_c{i}{j}" for i in range(P) for j in range(i + 1))]
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _middle(values: DataFrame, by: list[str], of: str) -> DataFrame:
    """The least value of ``of`` (with counts n) that half of each group reaches."""
    at = W.partitionBy(*by)
    upto = values.withColumn("upto", F.sum("n").over(at.orderBy(of))).withColumn("all", F.sum("n").over(at))
    return upto.filter("2 * upto >= `all`").groupBy(*by).agg(F.min(of).alias("mid"))


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """Four deterministic starts (pool, start, _m*, _c*) for each pool: medians, and as scatter, in units of the median
    absolute deviations, no correlation; products of hyperbolic tangents; products of directions; products of the half of
    the rows that lies nearest."""
    long = rows.select("pool", F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"{_N}{i}").alias("q")) for i in range(P)))).alias("x")).groupBy("pool", "x.f", "x.q").agg(F.count("*").alias("n"))
    long = written(long, "rules-values")
    mid = _middle(long, ["pool", "f"], "q")
    off = long.join(mid, ["pool", "f"]).groupBy("pool", "f", F.abs(F.col("q") - F.col("mid")).alias("d")).agg(F.sum("n").alias("n"))
    wide = _middle(off, ["pool", "f"], "d").withColumnRenamed("mid", "mad").join(mid, ["pool", "f"])
    pick = lambda k, c: F.min(F.when(F.col("f") == k, F.col(c))).cast("double")
    at = wide.groupBy("pool").agg(*(pick(i, "mid").alias(f"_m{i}") for i in range(P)), *(F.greatest(1.4826 * pick(i, "mad"), F.lit(FLOOR * UNIT)).alias(f"_s{i}") for i in range(P)))
    at = _noted(at, "rules-scales", few)
    z = rows.join(_sent(at, few), "pool").select("pool", *(((F.col(f"{_N}{i}") - F.col(f"_m{i}")) / F.col(f"_s{i}")).alias(f"z{i}") for i in range(P)))
    z = z.withColumn("norm", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, P)), F.col("z0") * F.col("z0")))
    half = _middle(z.groupBy("pool", _bin(F.col("norm")).alias("b")).agg(F.count("*").alias("n")), ["pool"], "b").withColumnRenamed("mid", "edge")
    z = z.join(_sent(half, few), "pool")
    exact = lambda c: F.sum(F.round(1e6 * c).cast("long"))
    product = lambda i, j: F.col(f"z{i}") * F.col(f"z{j}")
    near = _bin(F.col("norm")) <= F.col("edge")
    kinds = {
        1: lambda i, j: exact(F.tanh(f"z{i}") * F.tanh(f"z{j}")) / F.count("*"),
        2: lambda i, j: exact(F.when(F.col("norm") > 0, product(i, j) / F.col("norm")).otherwise(0.0)) / F.count("*"),
        3: lambda i, j: exact(F.when(near, product(i, j)).otherwise(0.0)) / F.count_if(near),
    }
    sums = z.groupBy("pool").agg(*(f(i, j).alias(f"k{k}{i}{j}") for k, f in kinds.items() for i, j in _PAIRS))
    one = lambda k, i, j: F.lit(1.0 if i == j else 0.0) if not k else F.col(f"k{k}{i}{j}") / 1e6 + (1e-3 if i == j else 0.0)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("start"), *(one(k, i, j).alias(f"v{i}{j}") for i, j in _PAIRS)) for k in range(4)))).alias("x")
    flat = sums.select("pool", each).select("pool", "x.*").join(at, "pool")
    out = _factor(flat, lambda i, j: F.col(f"v{i}{j}") * F.col(f"_s{i}") * F.col(f"_s{j}"))
    return out.select("pool", "start", *_PARAMS, F.lit(float("inf")).alias("det"))


def _sent(table: DataFrame, few: bool) -> DataFrame:
    """A table with a row for each pool (and start), to be broadcast if its pools were counted to be few."""
    return F.broadcast(table) if few else table


def _noted(table: DataFrame, what: str, few: bool) -> DataFrame:
    """A written table with a row for each pool (and start), in a few files if its pools were counted to be few: the driver keeps a record of every task."""
    return written(table.coalesce(16) if few else table, what)


def _cores(rows: DataFrame, params: DataFrame, few: bool, sums: dict[str, Column]) -> DataFrame:
    """(pool, start, _edge, ``sums`` over the core) by each start of ``params``: the core is every bin of distances up to the one in which three quarters of the pool's rows are reached.

    "Nearest" is read off counts and sums of bins, in one pass: no rows are sorted, and a hot pool is summed by many
    tasks, as the tables with a row per pool and start are small enough to broadcast (a shuffled join otherwise).
    """
    far = rows.join(_sent(params, few), "pool").withColumn("_b", _bin(_distance()))
    bins = far.groupBy("pool", "start", "_b").agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in sums.items()))
    of = W.partitionBy("pool", "start")
    upto = bins.withColumn("upto", F.sum("n").over(of.orderBy("_b"))).withColumn("all", F.sum("n").over(of))
    core = upto.filter(f"{CORE[1]} * (upto - n) < {CORE[0]} * `all`")
    return core.groupBy("pool", "start").agg(F.max("_b").alias("_edge"), F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in sums))


def _step(rows: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """One concentration step: mean and covariance, with its determinant, of the core of each pool and start."""
    sums = {f"s{i}": F.col(f"{_N}{i}") for i in range(P)} | {f"p{i}{j}": F.col(f"{_N}{i}") * F.col(f"{_N}{j}") for i, j in _PAIRS}
    core = _cores(rows, params, few, sums)
    out = core.select("pool", "start", "n", *((F.col(f"s{i}") / F.col("n")).alias(f"_m{i}") for i in range(P)), *(f"p{i}{j}" for i, j in _PAIRS))
    return _factor(out, lambda i, j: F.col(f"p{i}{j}") / F.col("n") - F.col(f"_m{i}") * F.col(f"_m{j}")).select("pool", "start", *_PARAMS, "det")


def estimates(rows: DataFrame, few: bool = True) -> DataFrame:
    """(pool, _m*, _c*, _scale): the estimate with the least determinant of each pool, from rows (pool, features).

    Each start is followed by concentration steps for as long as the determinant falls. ``_scale`` makes squared
    distances chi-square ones at the edge of the core. ``few``: whether tables with a row for each pool and start may be broadcast.
    """
    now = _noted(_starts(rows, few), "rules-start", few)
    done = None
    while True:
        old = now.select("pool", "start", F.col("det").alias("old"))
        fell = _noted(_step(rows, now, few).join(old, ["pool", "start"]).filter(F.col("det") < F.col("old") - STILL).drop("old"), "rules-step", few)
        still = now.join(fell.select("pool", "start"), ["pool", "start"], "left_anti")
        done = still if done is None else done.unionByName(still)
        if not fell.limit(1).count():
            break
        now = fell
    best = done.groupBy("pool").agg(F.min_by(F.struct("start", *_PARAMS), F.struct("det", "start")).alias("x")).select("pool", "x.*")
    best = _noted(best, "rules-best", few)
    scale = F.greatest(F.lit(1.0), F.expm1((F.col("_edge") + 0.5) / BINS) / CHI_CORE)
    return _noted(best.join(_cores(rows, best, few, {}), ["pool", "start"]).select("pool", *_PARAMS, scale.alias("_scale")), "rules-estimates", few)


def _counted(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    rows = docs.withColumns({"_lang": F.coalesce(F.col(lang_col), F.lit("")), "_source": F.coalesce(F.col(source_col), F.lit(""))})
    return base_counts(rows, text_col)


def featured(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pools, rows (pool, features)) of the rows with base counts and _lang, _source, a written table, that pass the base rules."""
    good = rows.filter("not base_failed").select("n_words", "word_chars", "_distinct", "_marks", "_upper", F.col("_lang").alias("lang"), F.col("_source").alias("source"))
    pools = written(_pooled(good), "rules-pools")
    good = good.join(small(pools), ["lang", "source"]).withColumns(_features()).select("pool", *(f"{_N}{i}" for i in range(P)))
    return pools, written(good, "rules-features")


def fit(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pools, estimates) from rows with base counts and _lang, _source; see :func:`judge`."""
    pools, good = featured(rows)
    few = pools.count() <= FEW
    named = pools.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    return _sent(named, few), _sent(estimates(good, few), few)


def verdicts(rows: DataFrame, fitted: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``rows`` with base counts, with ``distance`` and ``kept``."""
    pools, params = fitted
    own = [c for c in rows.columns if c not in ("distance", "kept")]
    out = rows.join(pools, ["_lang", "_source"], "left").join(params, "pool", "left").withColumns(_features())
    out = out.withColumn("_far", F.when(~F.col("base_failed"), F.round(_distance() / F.col("_scale"), 3)))
    return out.select(*own, F.col("_far").alias("distance"), (~F.col("base_failed") & F.coalesce(F.col("_far") <= CUT, F.lit(True))).alias("kept"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Ids with the base counts, ``distance`` (squared, robust) and ``kept``.

    Four logarithms (characters, marks and capitals per word, different words for the length) are judged by the language
    and source they come from. Location and scatter are minimum-covariance-determinant estimates of the three quarters of
    a pool's rows that lie nearest, from several starts (:func:`estimates`). A squared distance that chi square exceeds with
    probability OUTLIER goes, as does what fails the base rules. Rows that fail them don't enter the estimates.

    Null text: no words, so it fails. Null lang or source: a group ``''``. Small groups: see MIN_ROWS; ``distance`` is null
    where there is no estimate, and such rows stay. Equal rows get equal verdicts. An empty table gives no rows. Other
    columns are ignored.
    """
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    rows = written(_counted(thin, "text", "lang", "source").drop("text", "lang", "source"), "rules-counts")
    out = verdicts(rows, fit(rows))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`judge` keeps. The rows are written once with their counts, which the estimates and the verdicts then read."""
    docs, own = renamed(docs)
    rows = written(_counted(docs, own[text_col], own[lang_col], own[source_col]), "rules-rows")
    out = verdicts(rows, fit(rows)).filter("kept")
    return out.select(*(F.col(v).alias(k) for k, v in own.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
