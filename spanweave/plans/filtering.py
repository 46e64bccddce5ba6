"""The filter plan: predicates, sweeps, chains, scaffolds, inversions and rescue, from mappings to annotated mappings."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.exprs import prefix_last
from ..functions.grammar import connectivity_probability
from ..operators import chain, joins
from ..operators.stats import best_until_covered, ani_all, genome_identities
from ..operators.pairs import random_pairs, select_by_identity
from ..operators.sweep import sweep, sweep_both, sweep_intersect
from ..schema import FilterConfig, Scoring, Status
from ..sources.readers import numbered_lines, parse_lenient, read_any
from ..sources.writers import write_annotated

#: Ranks of one range of chain numbers.
RANGE = 1 << 16


def passing(df: DataFrame, cfg: FilterConfig) -> DataFrame:
    """The rows that pass the row predicates."""
    out = df
    if cfg.min_block_length:
        out = out.filter(F.col("block_length") >= cfg.min_block_length)
    if not cfg.keep_self:
        out = out.filter(F.col("query") != F.col("target"))
    return out.filter(F.col("identity") >= cfg.min_identity) if cfg.min_identity > 0 else out


def sweep_mappings(df: DataFrame, cfg: FilterConfig) -> DataFrame:
    """Per pair of genomes, what both axes keep: the query axis within each query, the target axis within each target."""
    rows = df.withColumns({"_g": prefix_last(F.col("query")), "_h": prefix_last(F.col("target"))})
    kept = sweep_intersect(rows, ["_g", "_h", "query"], ["_g", "_h", "target"], cfg.query_limit, cfg.target_limit, cfg.overlap, cfg.scoring)
    return kept.drop("_g", "_h")


def ordered_chains(members: DataFrame) -> DataFrame:
    """The chain table with ``place``: (least rank of the pair and strand, start and rank of the chain's root), by which chains are numbered."""
    chains = chain.chain_table(members)
    return chains.withColumn("pair_rank", F.min("first_rank").over(W.partitionBy(*chain.PAIR)))


PLACE = ["pair_rank", "chain_start", "chain_root"]


def numbered(chains: DataFrame) -> DataFrame:
    """``chains`` with ``order``, 1 and up in order of place: a count per range of pair ranks, and a rank within the range."""
    rows = chains.withColumn("_range", F.expr(f"pair_rank div {RANGE}"))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_n")).alias("_before"))
    return rows.join(before, "_range").withColumn("order", F.col("_before") + F.row_number().over(W.partitionBy("_range").orderBy(*PLACE))).drop("_range", "_before")


def sweep_scaffolds(chains: DataFrame, cfg: FilterConfig) -> DataFrame:
    """Chains that survive within their pair of sequences, both strands competing: the query axis, then the target axis."""
    rows = chains.withColumn("rank", F.row_number().over(W.partitionBy("query", "target").orderBy(*PLACE)).cast("long"))
    return sweep_both(rows, ["query", "target"], cfg.scaffold_query_limit, cfg.scaffold_target_limit, cfg.scaffold_overlap, cfg.scoring).drop("rank")


def _held(df: DataFrame) -> DataFrame:
    """``df``, kept in memory or on disk for this call alone: Spark would take what it holds of an equal plan, even where the files behind it have changed since."""
    return df.withColumn("_call", F.lit(uuid.uuid4().hex)).persist(StorageLevel.MEMORY_AND_DISK).drop("_call")


def filter_mappings(df: DataFrame, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """Mappings kept by ``cfg``, with chain_id and chain_status.

    With a scaffold gap of 0 the sweep's survivors are all, unassigned. Else survivors are chained, chains swept, and
    members of kept chains are scaffold rows; reverse mappings along a kept forward chain join it, and other mappings
    near a scaffold row are rescued, unless they belong to a chain that the sweep dropped. A rescued row has the chain of
    the nearest scaffold row, of equal ones that of the least rank.
    """
    base = passing(df, cfg)
    if cfg.scaffold_gap == 0:
        return sweep_mappings(base, cfg).withColumns({"chain_id": F.lit(None).cast("string"), "chain_status": F.lit(Status.UNASSIGNED.value)})
    base = _held(base)
    members = chain.chain_members(sweep_mappings(base, cfg), cfg.scaffold_gap).select(*chain.CHAIN, "rank", "query_start", "query_end", "target_start", "target_end", "matches", "block_length")
    members = _held(members)
    long = ordered_chains(members).filter((F.col("span") >= cfg.min_scaffold_length) & (F.col("identity") >= cfg.min_scaffold_identity))
    before = members.join(long.select(*chain.CHAIN), chain.CHAIN, "left_semi").select("rank")
    kept = _held(numbered(sweep_scaffolds(long, cfg)))
    anchors = members.join(kept.select(*chain.CHAIN, "order"), chain.CHAIN).select("rank", "order")
    if cfg.scaffolds_only:
        return _annotated(base.join(anchors, "rank"), Status.SCAFFOLD)
    turned = joins.on_diagonal(base, kept, cfg.scaffold_gap).join(anchors.select("rank"), "rank", "left_anti")
    anchors = anchors.unionByName(turned)
    out = _annotated(base.join(anchors, "rank"), Status.SCAFFOLD)
    if cfg.rescue_distance > 0:
        dropped = before.join(anchors.select("rank"), "rank", "left_anti")
        rest = base.join(anchors.select("rank"), "rank", "left_anti").join(dropped, "rank", "left_anti")
        near = joins.within_distance(rest, base.join(anchors.select("rank"), "rank", "left_semi"), cfg.rescue_distance)
        near = near.join(anchors.withColumnRenamed("rank", "anchor_rank"), "anchor_rank").select("rank", "order")
        out = out.unionByName(_annotated(base.join(near, "rank"), Status.RESCUED))
    return out


def _annotated(rows: DataFrame, status: Status) -> DataFrame:
    return rows.withColumns({"chain_id": F.concat(F.lit("chain_"), F.col("order").cast("string")), "chain_status": F.lit(status.value)}).drop("order")


def filter_text(spark: SparkSession, source: str, target: str, cfg: FilterConfig = FilterConfig(), passthrough: bool = False) -> None:
    """Filter a mapping text file into an annotated one; with ``passthrough`` lines go on as they are."""
    lines = numbered_lines(spark, source)
    if passthrough:
        lines.orderBy("rank").select("line").write.text(target)
        return
    write_annotated(lines, filter_mappings(parse_lenient(lines).drop("line"), cfg), target)


def filter_any(spark: SparkSession, source: str, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """Filter mappings of either format."""
    return filter_mappings(read_any(spark, source), cfg)


#: What the orthogonal survey filters with before it measures.
ORTHOGONAL = FilterConfig(min_block_length=1000, query_limit=1, target_limit=1, scoring=Scoring.MATCHES, scaffold_gap=10_000, min_scaffold_length=0, scaffold_query_limit=1, scaffold_target_limit=1, scaffold_overlap=0.95)


def survey(df: DataFrame, kind: str = "all", percent: float = 100.0, order: str = "identity") -> DataFrame:
    """The median identity of genome pairs: over all mappings, over a 1:1 filter's, or over the best until ``percent`` of the genome is covered."""
    if kind == "orthogonal":
        return ani_all(filter_mappings(df, ORTHOGONAL))
    return ani_all(best_until_covered(df, percent, order) if kind == "percentile" else df)


def tree_filter(df: DataFrame, near: int, far: int = 0, fraction: float = 0.0, seed: int = 0, key=None) -> DataFrame:
    """Mappings between genomes that are among each other's most (or least) alike, or in a random part."""
    from ..functions.exprs import prefix_two

    key = key or prefix_two
    pairs = select_by_identity(genome_identities(df, key), near, far, fraction, seed)
    return joins.of_pairs(df.filter(key(F.col("query")) != key(F.col("target"))), pairs, key)


def giant_filter(df: DataFrame, probability: float = 0.99, seed: int = 0, key=prefix_last) -> DataFrame:
    """Mappings of a random part of genome pairs, large enough that the graph of genomes stays connected with ``probability``."""
    pairs = genome_identities(df, key).select(F.col("a").alias("i"), F.col("b").alias("j"))
    n = pairs.select("i").unionByName(pairs.select(F.col("j").alias("i"))).distinct().count()
    chosen = random_pairs(pairs, connectivity_probability(n, probability), seed)
    return joins.of_pairs(df.filter(key(F.col("query")) != key(F.col("target"))), chosen.select(F.col("i").alias("a"), F.col("j").alias("b")), key)


def contained_with_rescue(df: DataFrame, chains: DataFrame, distance: int) -> DataFrame:
    """A variant of the scaffold plan: rows inside a chain's box are anchors, rows within ``distance`` of one are kept too."""
    anchors = joins.contained(df, chains)
    near = joins.within_distance(df.join(anchors.select("rank"), "rank", "left_anti"), anchors, distance)
    return anchors.withColumn("chain_status", F.lit(Status.SCAFFOLD.value)).unionByName(df.join(near.select("rank"), "rank", "left_semi").withColumn("chain_status", F.lit(Status.RESCUED.value)))


__all__ = ["contained_with_rescue", "filter_any", "filter_mappings", "filter_text", "giant_filter", "passing", "survey", "sweep", "sweep_mappings", "tree_filter"]
