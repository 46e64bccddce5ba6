"""Sources: alignment text, sequence files and their indexes, pair lists, tables of alignments."""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.exprs import prefix_last, prefix_two, resolve_identity, tags_map
from ..schema import ALIGNMENT
from ..session import ship

#: Lines of an unpacked file that are handed on at once.
LINES = 10_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(rank, line) of text: rank counts lines from 0, all of them, in order of file name and place.

    Lines get their number in two steps, a count per block of a file and a number within it, so a large file stays in
    pieces and no line leaves the JVM. Block-gzip files (``.bgz``, ``.bgzf``), which Spark has no reader for, are unpacked file by file.
    """
    if path.lower().endswith((".bgz", ".bgzf")):
        ship(spark)
        raw = spark.read.format("binaryFile").load(path).select("path", "content")
        lines = raw.mapInArrow(_unpacked, "file string, start long, at long, line string")
    else:
        at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
        lines = spark.read.text(path).select(*at, F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    blocks = lines.groupBy("file", "start").agg(F.min("at").alias("_first"), F.count("*").alias("_n"))
    before = blocks.select("file", "start", (F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("file", "start")) - F.col("_n") - F.col("_first")).alias("_before"))
    return lines.join(before, ["file", "start"]).select((F.col("at") + F.col("_before")).alias("rank"), "line")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, at, line) of gzip files read whole; block-gzip is a row of gzip members."""
    for b in batches:
        for name, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            with gzip.open(io.BytesIO(raw), "rt", encoding="utf-8", newline="\n") as f:
                at = 0
                while some := list(islice(f, LINES)):
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([0] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.array([x.rstrip("\r\n") for x in some])], ["file", "start", "at", "line"])
                    at += n


def _long(fields: Column, k: int, default: int) -> Column:
    return F.coalesce(F.get(fields, k).try_cast("long"), F.lit(default))


def parse_lenient(lines: DataFrame) -> DataFrame:
    """Mappings of (rank, line): lines of under 11 fields are skipped, numbers that can't be read are 0 (block length 1), a strand other than + is -.

    Beside ``matches``, which tags may set (:func:`resolve_identity`), ``raw_matches`` is the column of the file, and
    ``survey_matches`` that or what the first ``dv:f:`` tag says of the block length.
    """
    f = F.col("_f")
    rows = lines.withColumn("_f", F.split("line", "\t")).filter(F.size("_f") >= 11)
    rows = rows.select("rank", "line", "_f", _long(f, 9, 0).alias("_m"), _long(f, 10, 1).alias("_b"))
    rows = rows.withColumn("_i", resolve_identity(F.col("_m"), F.col("_b"), F.slice("_f", 12, 1 << 20)))
    said = F.transform(F.filter(F.slice("_f", 12, 1 << 20), lambda t: F.startswith(t, F.lit("dv:f:"))), lambda t: F.substring(t, 6, 1 << 30).try_cast("double"))
    dv = F.get(F.filter(said, lambda x: x.isNotNull()), 0)
    return rows.select(
        "rank", F.get(f, 0).alias("query"), *(_long(f, k, 0).alias(n) for k, n in ((1, "query_len"), (2, "query_start"), (3, "query_end"))),
        F.when(F.get(f, 4) == "+", "+").otherwise("-").alias("strand"), F.get(f, 5).alias("target"), *(_long(f, k, 0).alias(n) for k, n in ((6, "target_len"), (7, "target_start"), (8, "target_end"))),
        F.col("_i.matches").alias("matches"), F.col("_b").alias("block_length"), F.col("_i.identity").alias("identity"), F.col("_m").alias("raw_matches"),
        F.coalesce((1 - dv) * F.col("_b"), F.col("_m").cast("double")).alias("survey_matches"), "line")


def parse_strict(lines: DataFrame) -> DataFrame:
    """Records of (rank, line): 12 columns, ``tags`` and ``tag_types`` as maps, ``cigar``; anything else than 12 fields or more with good numbers fails the query."""
    f = F.col("_f")
    rows = lines.filter("line <> ''").withColumn("_f", F.split("line", "\t"))
    rows = rows.withColumn("_f", F.when(F.size("_f") >= 12, F.col("_f")).otherwise(F.raise_error(F.concat(F.lit("fewer than 12 fields in line "), F.col("rank").cast("string"))).cast("array<string>")))
    number = lambda k: F.get(f, k).cast("long")  # noqa: E731  fails on a bad number
    return rows.select(
        "rank", F.get(f, 0).alias("query"), *(number(k).alias(n) for k, n in ((1, "query_len"), (2, "query_start"), (3, "query_end"))),
        F.get(f, 4).alias("strand"), F.get(f, 5).alias("target"), *(number(k).alias(n) for k, n in ((6, "target_len"), (7, "target_start"), (8, "target_end"), (9, "matches"), (10, "block_length"))),
        F.get(f, 11).cast("int").alias("mapq"), tags_map(F.slice("_f", 13, 1 << 20)).alias("tags"), tags_map(F.slice("_f", 13, 1 << 20), "type").alias("tag_types")).withColumn("cigar", F.col("tags")["cg"])


def read_mappings(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Alignment text, plain, gzip or block-gzip by its name."""
    return (parse_strict if strict else parse_lenient)(numbered_lines(spark, path))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Binary alignment tables are read as Parquet with the columns of ``ALIGNMENT``; names end at the first blank.

    Block length is the sum of both spans, identity matches over the query span; matches default to the query span less
    the differences.
    """
    raw = spark.read.parquet(path)
    span = F.col("query_end") - F.col("query_start")
    col = lambda n: F.col(n) if n in raw.columns else F.lit(None).cast(ALIGNMENT[n].dataType)
    matches = F.coalesce(col("matches"), span - col("diffs"), F.lit(0))
    name = lambda n: F.substring_index(F.col(n), " ", 1)
    rows = raw.withColumn("matches", matches.cast("long")).withColumns({"query": name("query"), "target": name("target")})
    return rows.withColumn("block_length", span + F.col("target_end") - F.col("target_start")).withColumn("identity", F.when(span > 0, F.col("matches") / span).otherwise(F.lit(0.0)))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence): one row per record; the name ends at the first blank. A record begins at a ``>`` that begins a line."""
    rows = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("value")).filter(F.trim("value") != "")
    name = F.regexp_extract("value", r"^([^\s]*)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return rows.select(name.alias("name"), body.alias("sequence"))


def sequence_lengths(sequences: DataFrame) -> DataFrame:
    return sequences.select("name", F.length("sequence").cast("long").alias("length"))


def genome_sizes(lengths: DataFrame) -> DataFrame:
    """(prefix, total_bp, sequences) of genomes, from (name, length)."""
    return lengths.groupBy(prefix_two(F.col("name"), "hash").alias("prefix")).agg(F.sum("length").alias("total_bp"), F.count("*").alias("sequences"))


def genomes(names: DataFrame) -> DataFrame:
    return names.select(prefix_last(F.col("name")).alias("genome")).distinct()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A sequence index: name, length, offset, line_bases, line_width."""
    return spark.read.csv(path, sep="\t", schema="name string, length long, offset long, line_bases int, line_width int", quote="")


def mean_length(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.expr("coalesce(sum(length) div nullif(count(*), 0), 0)").alias("mean"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(query, target) of a tab-separated list; blank lines and ``#`` lines are skipped."""
    f = F.split("value", "\t")
    return spark.read.text(path).filter((F.trim("value") != "") & ~F.startswith("value", F.lit("#"))).select(F.trim(F.get(f, 0)).alias("query"), F.trim(F.get(f, 1)).alias("target")).filter("target is not null")


def read_archive(spark: SparkSession, path: str, samples: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """(sample, contig, sequence) of an archive kept as Parquet, by sample names or their prefix; both filters reach the scan."""
    rows = spark.read.parquet(path)
    if samples is not None:
        rows = rows.filter(F.col("sample").isin(samples))
    return rows if prefix is None else rows.filter(F.col("sample").startswith(prefix))


def archive_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sample").agg(F.sum(F.length("sequence")).alias("total_bp"), F.count("*").alias("contigs"))


def kind_of(path: str, first: list[str]) -> str:
    """``archive``, ``alignments``, ``fasta`` or ``mappings``, by extension or else the first line that isn't blank or a comment."""
    low = path.lower()
    if low.endswith(".agc"):
        return "archive"
    if low.endswith((".1aln", ".parquet")):
        return "alignments"
    line = next((x for x in first if x.strip() and not x.startswith("#")), "")
    if line.startswith(">"):
        return "fasta"
    f = line.split("\t")
    if len(f) >= 12 and all(re.fullmatch(r"\d+", f[k]) for k in (1, 2, 3, 6, 9, 10)):
        return "mappings"
    raise ValueError(f"neither sequences nor mappings: {path}")


def sniff(spark: SparkSession, path: str) -> str:
    low = path.lower()
    if low.endswith((".agc", ".1aln", ".parquet")):
        return kind_of(path, [])
    line = F.col("line") if low.endswith((".bgz", ".bgzf")) else F.col("value")
    lines = numbered_lines(spark, path) if low.endswith((".bgz", ".bgzf")) else spark.read.text(path)
    return kind_of(path, [r[0] for r in lines.filter((F.trim(line) != "") & ~F.startswith(line, F.lit("#"))).select(line).take(1)])


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Mappings of either format."""
    kind = sniff(spark, path)
    if kind == "mappings":
        return read_mappings(spark, path)
    if kind == "alignments":
        return read_alignments(spark, path)
    raise ValueError(f"{path} holds no mappings but {kind}")
