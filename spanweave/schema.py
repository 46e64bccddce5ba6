"""Columns of the mapping table, and the options of the filter plan."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import types as T

#: A mapping: an interval on a query sequence paired with one on a target. Coordinates are half-open.
MAPPING = T.StructType([
    T.StructField("rank", T.LongType()),
    T.StructField("query", T.StringType()), T.StructField("query_len", T.LongType()), T.StructField("query_start", T.LongType()), T.StructField("query_end", T.LongType()),
    T.StructField("strand", T.StringType()),
    T.StructField("target", T.StringType()), T.StructField("target_len", T.LongType()), T.StructField("target_start", T.LongType()), T.StructField("target_end", T.LongType()),
    T.StructField("matches", T.LongType()), T.StructField("block_length", T.LongType()), T.StructField("identity", T.DoubleType()),
])
ALIGNMENT = T.StructType([*MAPPING.fields, T.StructField("diffs", T.LongType()), T.StructField("x_values", T.ArrayType(T.LongType()))])
SEQUENCE = T.StructType([T.StructField("name", T.StringType()), T.StructField("sequence", T.StringType())])


class Scoring(str, Enum):
    IDENTITY = "ani"
    LENGTH = "length"
    LENGTH_IDENTITY = "length-ani"
    LOG_LENGTH_IDENTITY = "log-length-ani"
    MATCHES = "matches"


class Status(str, Enum):
    SCAFFOLD = "scaffold"
    RESCUED = "rescued"
    UNASSIGNED = "unassigned"


@dataclass(frozen=True)
class FilterConfig:
    """Options of :func:`spanweave.plans.filtering.filter_mappings`; a limit of None keeps any number."""

    min_block_length: int = 0
    min_identity: float = 0.0
    keep_self: bool = False
    query_limit: int | None = None
    target_limit: int | None = None
    overlap: float = 0.95
    scoring: Scoring = Scoring.LOG_LENGTH_IDENTITY
    scaffold_gap: int = 50_000
    min_scaffold_length: int = 10_000
    min_scaffold_identity: float = 0.0
    scaffold_query_limit: int | None = None
    scaffold_target_limit: int | None = None
    scaffold_overlap: float = 0.5
    rescue_distance: int = 0
    scaffolds_only: bool = False

    def __post_init__(self) -> None:
        for k in ("query_limit", "target_limit", "scaffold_query_limit", "scaffold_target_limit"):
            if getattr(self, k) is not None and getattr(self, k) < 1:
                raise ValueError(f"{k} must be at least 1, or None for no limit")
        for k in ("min_block_length", "scaffold_gap", "min_scaffold_length", "rescue_distance"):
            if getattr(self, k) < 0:
                raise ValueError(f"{k} must not be negative")
        Scoring(self.scoring)

    def but(self, **changes: object) -> FilterConfig:
        return replace(self, **changes)
