"""Aligning: which pairs to align, with an aligner of one's own, then the filter plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.grammar import Selection, clamp_scaffolds, filter_mode, identity_threshold, selection
from ..operators.joins import remaining
from ..operators.pairs import group_of, select_pairs, shuffled_slice, sketch_distances, sketches
from ..schema import MAPPING, FilterConfig, Scoring
from ..session import ship
from .filtering import filter_mappings


class Aligner(Protocol):
    """Aligns two sequences; yields dicts with the columns of a mapping but for rank and names."""

    def __call__(self, query: str, target: str) -> Iterator[dict]: ...


def pairs_for(sequences: DataFrame, how: Selection | str = "none", k: int = 15, size: int = 1000, seed: int = 0) -> DataFrame:
    """(i, j) of sequence names to align, by sketches where the strategy asks for distances."""
    how = selection(how) if isinstance(how, str) else how
    names = sequences.select("name")
    needs = how.kind in ("giant", "tree", "auto")
    return select_pairs(names, how, sketch_distances(sketches(sequences, k, size), k) if needs else None, seed=seed)


def haplotype_pairs(sequences: DataFrame, how: Selection | str, seed: int = 0) -> DataFrame:
    """(i, j) of contigs: pairs of haplotypes by strategy, spread to their contigs, and pairs within haplotypes."""
    from ..operators.joins import expand_haplotypes
    from ..operators.pairs import K, merged_sketches

    how = selection(how) if isinstance(how, str) else how
    groups = group_of(sequences.select("name"))
    found = sketches(sequences).join(groups.withColumnRenamed("i", "name"), "name")
    merged = merged_sketches(found.select("g", "sketch"), F.col("g"))
    chosen = select_pairs(merged.select("name"), how, sketch_distances(merged, K), seed=seed)
    return expand_haplotypes(chosen.select(F.col("i").alias("a"), F.col("j").alias("b")), groups)


def pair_list(pairs: DataFrame, seed: int | None = None, start: int = 0, most: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """What is left to do of pairs (query, target): shuffled by a seed (in order of name without one), a slice, less the pairs already done."""
    out = shuffled_slice(pairs, seed, start, most) if seed is not None or start or most is not None else pairs
    return out if done is None else remaining(out, done)


def align_pairs(sequences: DataFrame, pairs: DataFrame, aligner: Aligner, both_ways: bool = True) -> DataFrame:
    """Mappings of the pairs (i, j), each aligned by one call of ``aligner`` on an executor."""
    ship(sequences.sparkSession)
    q, t = (sequences.select(F.col("name").alias(n), F.col("sequence").alias(s)) for n, s in (("query", "_qs"), ("target", "_ts")))
    todo = pairs.select(F.col("i").alias("query"), F.col("j").alias("target"))
    if both_ways:
        todo = todo.unionByName(todo.select(F.col("target").alias("query"), F.col("query").alias("target")))
    columns = [f.name for f in MAPPING if f.name != "rank"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [{"query": r.query, "target": r.target, "query_len": len(r.qs), "target_len": len(r.ts), **m} for r in p.rename(columns={"_qs": "qs", "_ts": "ts"}).itertuples() for m in aligner(r.qs, r.ts)]
            yield pd.DataFrame(rows, columns=columns)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MAPPING if f.name != "rank")
    found = todo.join(q, "query").join(t, "target").mapInPandas(run, schema)
    return found.withColumn("rank", F.monotonically_increasing_id()).select(*(f.name for f in MAPPING))


def config_from_options(num_mappings: str = "many:many", scaffold_filter: str = "many:many", min_identity: str = "0", min_scaffold_identity: str = "0", scoring: str = "log-length-ani", gap: int = 50_000, length: int = 10_000,
                        overlap: float = 0.95, scaffold_overlap: float = 0.5, distance: int = 0, keep_self: bool = False, min_block_length: int = 0, ani: float | None = None, mean_length: int | None = None, adaptive: bool = False,
                        scaffolds_only: bool = False, dialect: str = "cli") -> FilterConfig:
    """A configuration from option strings; an empty scaffold identity takes the mapping identity."""
    q, t = filter_mode(num_mappings, dialect)
    sq, st = filter_mode(scaffold_filter, dialect)
    gap, length = clamp_scaffolds(gap, length, mean_length, adaptive)
    least = identity_threshold(min_identity, ani)
    return FilterConfig(min_block_length, least, keep_self, q, t, overlap, Scoring(scoring), gap, length, least if min_scaffold_identity == "" else identity_threshold(min_scaffold_identity, ani), sq, st, scaffold_overlap, distance, scaffolds_only)


def align_and_filter(sequences: DataFrame, aligner: Callable, how: str = "none", cfg: FilterConfig = FilterConfig(), both_ways: bool = True) -> DataFrame:
    return filter_mappings(align_pairs(sequences, pairs_for(sequences, how), aligner, both_ways), cfg)
