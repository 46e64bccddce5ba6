"""Operator 1, mixing sources to target weights: hierarchical token budgets, then a seeded token prefix of each leaf."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import NON_SPACE, small, table, written

#: Targets of the registered query and of the pipeline; a name that is missing has weight 1.
DOMAINS = {"hub": 40, "core": 35, "tail": 25}
LANGS = {"en": 55, "de": 15, "fr": 15, "es": 15}
SEED = "mix-1"


def domain_of(source: Column) -> Column:
    """The domain of a source of ``documents``: one large hub, core feeds, and the tail."""
    return F.when(source == "src0", "hub").when(source.rlike(r"^src[1-9]$"), "core").otherwise("tail")


def _weight(name: Column, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for k, v in weights.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def _fill(rows: DataFrame, parent: list[str], child: str, weight: str, cap: str, budget: str, out: str) -> DataFrame:
    """Share ``budget`` of each parent among its children by weight, none over its cap: what a short child leaves goes to its siblings.

    With children in order of cap / weight, the level at child i is (budget - caps before i) / (weights from i on); the
    largest of these is the level at which the parent's budget is spent or all its children are full.
    """
    sized = (F.col(cap) / F.col(weight)).alias("_ratio")
    at = W.partitionBy(*parent).orderBy("_ratio", child) if parent else W.partitionBy(F.lit(0)).orderBy("_ratio", child)
    whole = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    rows = rows.select("*", sized)
    rows = rows.select("*", ((F.col(budget) - F.sum(cap).over(at) + F.col(cap)) / (F.sum(weight).over(whole) - F.sum(weight).over(at) + F.col(weight))).alias("_level"))
    return rows.select("*", F.least(F.col(cap), F.floor(F.col(weight) * F.max("_level").over(whole))).alias(out)).drop("_ratio", "_level")


def leaf_budgets(supply: DataFrame, domains: Mapping[str, int], langs: Mapping[str, int], sources: Mapping[str, int], max_epochs: int, budget: tuple[int, int]) -> DataFrame:
    """``supply`` (domain, lang, source, tokens) with each leaf's token budget ``alloc``; one row per leaf.

    ``budget`` is the part (numerator, denominator) of all tokens to hand out; a leaf gives its tokens ``max_epochs``
    times at most. A shortage stays with the leaf's siblings while they can fill it, since a subtree is capped only by
    what all of it can give; only then do siblings of its ancestors get it.
    """
    leaves = supply.withColumn("cap", F.col("tokens") * max_epochs)
    by_lang = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("lang_cap"), F.sum("tokens").alias("tokens"))
    by_domain = by_lang.groupBy("domain").agg(F.sum("lang_cap").alias("domain_cap"), F.sum("tokens").alias("tokens"))
    top = by_domain.select("domain", "domain_cap", _weight(F.col("domain"), domains).alias("w"), F.sum("tokens").over(W.partitionBy(F.lit(0))).alias("all"))
    top = top.withColumn("root", F.expr(f"`all` * {budget[0]} div {budget[1]}"))
    top = _fill(top, [], "domain", "w", "domain_cap", "root", "domain_alloc").select("domain", "domain_alloc")
    mid = by_lang.drop("tokens").join(top, "domain").withColumn("w", _weight(F.col("lang"), langs))
    mid = _fill(mid, ["domain"], "lang", "w", "lang_cap", "domain_alloc", "lang_alloc").select("domain", "lang", "lang_alloc")
    low = leaves.join(mid, ["domain", "lang"]).withColumn("w", _weight(F.col("source"), sources))
    return _fill(low, ["domain", "lang"], "source", "w", "cap", "lang_alloc", "alloc").select("domain", "lang", "source", "tokens", "alloc")


def mix(docs: DataFrame, domains: Mapping[str, int] = DOMAINS, langs: Mapping[str, int] = LANGS, sources: Mapping[str, int] | None = None, max_epochs: int = 4, budget: tuple[int, int] = (1, 2), seed: str = SEED, domain: Column | None = None) -> DataFrame:
    """``docs`` with ``domain``, ``tokens`` and ``copies``: how often the mixture takes each row (0: not at all).

    Tokens are the words of the whole text. Budgets flow down domain, language, source (:func:`leaf_budgets`). A leaf
    with budget ``a`` and ``t`` tokens gives every row ``a div t`` times (whole epochs) and, from the next epoch, the
    longest prefix of its rows, in the order of a hash of seed, epoch and id, that holds ``a mod t`` tokens at most.
    The prefix ends at one hash value per leaf, found from sums over 4,096 hash ranges and a sort of the one range in
    which it ends, so that a leaf with a third of all rows is never sorted by one task.

    Null lang or source: a leaf named ``''``. Null text: no tokens. Rows without tokens cost nothing. Rows with equal
    ids share a hash: they are in or out together. An empty table gives none. Weights are positive integers; a name
    without one has 1. Columns that ``docs`` has by the names of the three new ones are replaced.
    """
    text, source, lang = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "source", "lang"))
    domain = domain_of(source) if domain is None else domain
    new = {"key": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "domain": domain, "lang": lang, "source": source, "tokens": F.regexp_count(text, F.lit(NON_SPACE + "+")).cast("long")}
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    thin = written(docs.select(*(c.alias(k) for k, c in new.items())), "mix-thin")
    leaf = ["domain", "lang", "source"]
    supply = thin.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"))
    plan = leaf_budgets(supply, domains, langs, sources or {}, max_epochs, budget)
    plan = plan.select(*leaf, F.expr("if(tokens = 0, 0, alloc div tokens)").alias("full"), F.expr("if(tokens = 0, 0, alloc % tokens)").alias("rest"))
    plan = written(plan, "mix-plan")

    def hashed(of: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(seed), F.col("full").cast("string"), of))

    rows = thin.join(small(plan), leaf).select(*leaf, "tokens", "rest", hashed(F.col("key")).alias("h")).withColumn("range", F.substring("h", 1, 3))
    sums = rows.groupBy(*leaf, "range").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"), F.max("h").alias("top"))
    sums = sums.withColumn("upto", F.sum("tokens").over(W.partitionBy(*leaf).orderBy("range")))
    fits = sums.filter("upto <= rest").groupBy(*leaf).agg(F.max("top").alias("cut"))
    ends = sums.filter("upto > rest and upto - tokens <= rest").select(*leaf, "range", (F.col("upto") - F.col("tokens")).alias("before"))
    inside = rows.join(ends, [*leaf, "range"]).withColumn("upto", F.col("before") + F.sum("tokens").over(W.partitionBy(*leaf, "range").orderBy("h").rangeBetween(W.unboundedPreceding, W.currentRow)))
    cuts = fits.unionByName(inside.filter("upto <= rest").groupBy(*leaf).agg(F.max("h").alias("cut"))).groupBy(*leaf).agg(F.max("cut").alias("cut"))
    plan = written(plan.join(cuts, leaf, "left").select(*(F.col(c).alias(f"_{c}") for c in leaf), "full", F.coalesce("cut", F.lit("")).alias("cut")), "mix-cuts")

    out = docs.select(*(F.col(c).alias(v) for c, v in own.items()), *(c.alias(k) for k, c in new.items()))
    out = out.join(small(plan), (F.col("domain") == F.col("_domain")) & (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source")))
    kept = [F.col(v).alias(c) for c, v in own.items() if c not in ("domain", "tokens", "copies")]
    return out.select(*kept, "domain", "tokens", (F.col("full") + F.when(hashed(F.col("key")) <= F.col("cut"), 1).otherwise(0)).cast("long").alias("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select("doc_id", "domain", "lang", "source", "tokens", "copies")


def _cases(name: str, weights: Mapping[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _fill_sql(rows: str, parent: str, child: str, cap: str, budget: str, out: str) -> str:
    over = f"PARTITION BY {parent}"
    return f"""SELECT *, least({cap}, CAST(floor(w * max(lev) OVER ({over})) AS BIGINT)) AS {out} FROM (
      SELECT *, ({budget} - sum({cap}) OVER ({over} ORDER BY ratio, {child} ROWS UNBOUNDED PRECEDING) + {cap})
        / (sum(w) OVER ({over}) - sum(w) OVER ({over} ORDER BY ratio, {child} ROWS UNBOUNDED PRECEDING) + w)::DOUBLE AS lev
      FROM (SELECT *, {cap} / w::DOUBLE AS ratio FROM ({rows})))"""


ORACLE = f"""WITH d AS MATERIALIZED (
  SELECT doc_id, CASE WHEN source = 'src0' THEN 'hub' WHEN regexp_full_match(source, 'src[1-9]') THEN 'core' ELSE 'tail' END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, (sum(tokens) * 4)::BIGINT AS cap FROM d GROUP BY ALL),
langs AS (SELECT domain, lang, sum(cap)::BIGINT AS lang_cap FROM leaves GROUP BY ALL),
doms AS (SELECT domain, sum(lang_cap)::BIGINT AS domain_cap, {_cases('domain', DOMAINS)} AS w, (SELECT sum(tokens)::BIGINT // 2 FROM leaves) AS root FROM langs GROUP BY domain),
a AS ({_fill_sql('SELECT * FROM doms', '1', 'domain', 'domain_cap', 'root', 'domain_alloc')}),
b AS ({_fill_sql(f"SELECT langs.*, domain_alloc, {_cases('lang', LANGS)} AS w FROM langs JOIN (SELECT domain, domain_alloc FROM a) USING (domain)", 'domain', 'lang', 'lang_cap', 'domain_alloc', 'lang_alloc')}),
c AS MATERIALIZED (SELECT domain, lang, source, CASE WHEN tokens = 0 THEN 0 ELSE alloc // tokens END AS "full", CASE WHEN tokens = 0 THEN 0 ELSE alloc % tokens END AS rest FROM ({_fill_sql('SELECT leaves.*, lang_alloc, 1 AS w FROM leaves JOIN (SELECT domain, lang, lang_alloc FROM b) USING (domain, lang)', 'domain, lang', 'source', 'cap', 'lang_alloc', 'alloc')})),
r AS (SELECT d.*, "full", rest, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws('|', '{SEED}', "full"::VARCHAR, coalesce(doc_id::VARCHAR, '')))) AS upto FROM d JOIN c USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, CAST("full" + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r"""
