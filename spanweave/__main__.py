"""Command line: ``python -m spanweave filter IN OUT``, ``stats FILE [FILE2]``, ``pairs FASTA OUT``, ``jobs FASTA OUT`` and ``batches FASTA OUT``; see ``--help`` of each."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, functions as F

from .functions.grammar import ani_method, batch_bases, identity_threshold, metric_number, selection
from .operators import stats
from .operators.pairs import batches_by_bases, joblist
from .plans import filtering
from .plans.align import config_from_options, haplotype_pairs, pair_list, pairs_for
from .schema import Scoring
from .session import ship
from .sources.readers import genome_sizes, mean_length, numbered_lines, parse_lenient, read_any, read_fasta, read_pairs, sequence_lengths
from .sources.writers import group_commands, write_annotated, write_batches, write_pairs


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanweave")
    sub = top.add_subparsers(dest="command", required=True)
    f = sub.add_parser("filter", help="filter a mapping file into annotated lines")
    f.add_argument("source")
    f.add_argument("target")
    f.add_argument("--num-mappings", default="many:many")
    f.add_argument("--overlap", type=float, default=0.95)
    f.add_argument("--scoring", choices=[s.value for s in Scoring], default=Scoring.LOG_LENGTH_IDENTITY.value)
    f.add_argument("--min-block-length", type=metric_number, default=0)
    f.add_argument("--min-identity", default="0", help="fraction, percentage, or ani50 with an offset such as ani50-2")
    f.add_argument("--ani-method", default="n100")
    f.add_argument("--keep-self", action="store_true")
    f.add_argument("--scaffold-jump", type=metric_number, default=50_000)
    f.add_argument("--scaffold-mass", type=metric_number, default=10_000)
    f.add_argument("--scaffold-filter", default="many:many")
    f.add_argument("--scaffold-overlap", type=float, default=0.5)
    f.add_argument("--scaffold-dist", type=metric_number, default=0)
    f.add_argument("--min-scaffold-identity", default="0", help="'' takes --min-identity")
    f.add_argument("--scaffolds-only", action="store_true")
    f.add_argument("--adaptive", action="store_true", help="clamp scaffold options to the mean sequence length")
    f.add_argument("--sparsify", default="none", help="none, or tree:near[:far[:random]] over genome pairs, or giant:p")
    f.add_argument("--no-filter", action="store_true")
    s = sub.add_parser("stats", help="statistics of a mapping file, or a comparison of two")
    s.add_argument("file")
    s.add_argument("other", nargs="?")
    s.add_argument("-d", "--detailed", action="store_true")
    p = sub.add_parser("pairs", help="pairs of sequences to align, as a tab-separated list")
    p.add_argument("fasta")
    p.add_argument("target")
    p.add_argument("--sparsify", default="none")
    p.add_argument("--list", help="read these pairs instead of choosing some")
    p.add_argument("--haplotypes", action="store_true", help="choose pairs of haplotypes, then all pairs of their contigs")
    p.add_argument("--shuffle-seed", type=int)
    p.add_argument("--start", type=int, default=0)
    p.add_argument("--max", type=int)
    p.add_argument("--done", help="a list of pairs to leave out")
    p.add_argument("--append", action="store_true")
    j = sub.add_parser("jobs", help="command lines, one for each pair of haplotypes")
    j.add_argument("fasta")
    j.add_argument("target")
    j.add_argument("--sparsify", default="none")
    j.add_argument("--template", default="align {query}.fa {target}.fa > {out}.paf")
    b = sub.add_parser("batches", help="genomes in batches of a size or a disk budget, as FASTA folders")
    b.add_argument("fasta")
    b.add_argument("target")
    b.add_argument("--bases", type=metric_number)
    b.add_argument("--disk", type=metric_number, help="bytes that the files of a batch may take")
    return top


def _pairs(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.list:
        found = read_pairs(spark, a.list)
    else:
        chosen = (haplotype_pairs if a.haplotypes else pairs_for)(read_fasta(spark, a.fasta), a.sparsify)
        found = chosen.select(F.col("i").alias("query"), F.col("j").alias("target"))
    write_pairs(pair_list(found, a.shuffle_seed, a.start, a.max, read_pairs(spark, a.done) if a.done else None), a.target, a.append)


def _jobs(spark: SparkSession, a: argparse.Namespace) -> None:
    sequences = read_fasta(spark, a.fasta)
    group_commands(joblist(sequences.select("name"), pairs_for(sequences, a.sparsify)), a.template).orderBy("query", "target").select(F.col("command").alias("value")).write.text(a.target)


def _batches(spark: SparkSession, a: argparse.Namespace) -> None:
    if (a.bases is None) == (a.disk is None):
        raise SystemExit("give --bases or --disk")
    sequences = read_fasta(spark, a.fasta)
    write_batches(sequences, batches_by_bases(genome_sizes(sequence_lengths(sequences)), a.bases or batch_bases(a.disk)), a.target)


def _filter(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.no_filter:
        filtering.filter_text(spark, a.source, a.target, passthrough=True)
        return
    lines = numbered_lines(spark, a.source)
    rows = parse_lenient(lines).drop("line")
    how = selection(a.sparsify)
    if how.kind not in ("none", "tree", "giant"):
        raise SystemExit("mappings are thinned by none, tree or giant only")
    ani = None
    if "ani" in (a.min_identity + a.min_scaffold_identity).lower():
        m = ani_method(a.ani_method)
        if m is None:
            raise SystemExit(f"no such --ani-method: {a.ani_method}")
        ani = filtering.survey(rows, m.kind, m.percent, m.order).first()["ani"]
    mean = mean_length(stats.sequence_sizes(rows)).first()["mean"] if a.adaptive else None
    cfg = config_from_options(a.num_mappings, a.scaffold_filter, a.min_identity, a.min_scaffold_identity, a.scoring, a.scaffold_jump, a.scaffold_mass, a.overlap, a.scaffold_overlap, a.scaffold_dist, a.keep_self, a.min_block_length, ani, mean, a.adaptive, a.scaffolds_only)
    if how.kind == "tree":
        rows = filtering.tree_filter(rows, how.near, how.far, how.fraction or 0.0)
    elif how.kind == "giant":
        rows = filtering.giant_filter(rows, how.fraction)
    write_annotated(lines, filtering.filter_mappings(rows, cfg), a.target)


def _stats(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = read_any(spark, a.file)
    if a.other:
        stats.compare(rows, read_any(spark, a.other)).orderBy("measure").show(truncate=False)
        return
    stats.totals(rows).show(truncate=False, vertical=True)
    coverage = stats.genome_coverage(rows)
    stats.coverage_summary(coverage).show(truncate=False, vertical=True)
    if a.detailed:
        coverage.orderBy(F.col("coverage").desc(), "query_genome", "target_genome").show(1000, truncate=False)


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    for value in (getattr(a, "min_identity", "0"),):
        if not value.lower().startswith("ani"):
            identity_threshold(value)
    spark = ship(SparkSession.builder.appName("spanweave").getOrCreate())
    {"filter": _filter, "stats": _stats, "pairs": _pairs, "jobs": _jobs, "batches": _batches}[a.command](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
