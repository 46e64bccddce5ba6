"""Sinks: annotated mapping text, alignment tables, sequences, pair lists, command lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import file_name, prefix_two


def annotated(lines: DataFrame, kept: DataFrame) -> DataFrame:
    """(rank, line) of the lines whose rank was kept, with ``ch:Z:`` (if there is a chain) and ``st:Z:`` tags."""
    tags = kept.select("rank", F.when(F.col("chain_id").isNotNull(), F.concat(F.lit("ch:Z:"), "chain_id")).alias("_c"), F.concat(F.lit("st:Z:"), "chain_status").alias("_s"))
    return lines.join(tags, "rank").select("rank", F.concat_ws("\t", "line", "_c", "_s").alias("line"))


def write_annotated(lines: DataFrame, kept: DataFrame, path: str) -> None:
    """The annotated lines in input order, by ranges of ranks: part files in order make the whole file."""
    annotated(lines, kept).orderBy("rank").select("line").write.text(path)


def mapping_line(identity_tag: str = "id:f:", mapq: int = 60, digits: int = 6) -> Column:
    """A text record of a mapping: 12 columns and one identity tag (``id:f:`` identity, ``dv:f:`` divergence)."""
    value = F.col("identity") if identity_tag.startswith("id") else 1 - F.col("identity")
    cols = ["query", "query_len", "query_start", "query_end", "strand", "target", "target_len", "target_start", "target_end", "matches", "block_length"]
    return F.concat_ws("\t", *(F.col(c).cast("string") for c in cols), F.lit(str(mapq)), F.concat(F.lit(identity_tag), F.format_string(f"%.{digits}f", value)))


def record_line() -> Column:
    """A text record of a strict row, with cg and the other tags in order of name, each with its type."""
    cols = ["query", "query_len", "query_start", "query_end", "strand", "target", "target_len", "target_start", "target_end", "matches", "block_length", "mapq"]
    rest = F.transform(F.array_sort(F.map_entries(F.map_filter("tags", lambda k, _: k != "cg"))), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(F.col("tag_types")[e["key"]], F.lit("Z")), F.lit(":"), e["value"]))
    return F.concat_ws("\t", *(F.col(c).cast("string") for c in cols), F.when(F.col("cigar").isNotNull(), F.concat(F.lit("cg:Z:"), "cigar")), rest)


def write_mappings(df: DataFrame, path: str, identity_tag: str = "id:f:") -> None:
    df.select(mapping_line(identity_tag).alias("value")).write.text(path)


def write_alignments(df: DataFrame, kept: DataFrame, path: str) -> None:
    """The alignments whose rank was kept, as Parquet."""
    df.join(kept.select("rank"), "rank", "left_semi").write.parquet(path)


def fasta_line(width: int = 80) -> Column:
    body = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), "name", F.lit("\n"), body)


def write_genomes(sequences: DataFrame, path: str, prefixes: list[str] | None = None) -> None:
    """Sequences as FASTA, a folder per genome; only those of ``prefixes`` if given."""
    rows = sequences.withColumn("genome", prefix_two(F.col("name"), "hash"))
    if prefixes is not None:
        rows = rows.filter(F.col("genome").isin(prefixes))
    rows.select(fasta_line().alias("value"), file_name(F.col("genome")).alias("genome")).write.partitionBy("genome").text(path)


def write_batches(sequences: DataFrame, batches: DataFrame, path: str) -> None:
    """Sequences as FASTA, a folder per batch of (prefix, batch_id)."""
    rows = sequences.withColumn("prefix", prefix_two(F.col("name"), "hash")).join(batches.select("prefix", "batch_id"), "prefix")
    rows.select(fasta_line().alias("value"), "batch_id").write.partitionBy("batch_id").text(path)


def write_pairs(pairs: DataFrame, path: str, append: bool = False) -> None:
    pairs.select("query", "target").write.mode("append" if append else "errorifexists").csv(path, sep="\t", quote="")


def pair_commands(pairs: DataFrame, template: str = "align {query}.fa {target}.fa > {out}.paf") -> DataFrame:
    """One command line for each pair; names in file names keep letters, digits, dot, dash and underscore."""
    out = F.lit(template)
    names = {"{query}": file_name(F.col("query")), "{target}": file_name(F.col("target")), "{out}": F.concat_ws("_vs_", file_name(F.col("query")), file_name(F.col("target")))}
    for k, v in names.items():
        out = F.replace(out, F.lit(k), v)
    return pairs.select("query", "target", out.alias("command"))


def group_commands(groups: DataFrame, template: str = "align all.fa --query {query} --target {target} > {out}.paf") -> DataFrame:
    """One command line for each pair (a, b) of name prefixes in one file."""
    return pair_commands(groups.select(F.col("a").alias("query"), F.col("b").alias("target")), template)
