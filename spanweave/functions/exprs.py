"""Scalar functions as column expressions: names, tags, identities, scores, overlaps, k-mers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schema import Scoring


def prefix_last(name: Column) -> Column:
    """Up to and with the last ``#``; the whole name without one."""
    return F.when(F.contains(name, F.lit("#")), F.regexp_extract(name, "(?s)^(.*#)", 1)).otherwise(name)


def prefix_two(name: Column, whole: str = "name") -> Column:
    """The first two ``#`` parts with a ``#`` after; without two parts the name, or the name and ``#`` (``whole='hash'``), or null (``'null'``)."""
    two = F.concat(F.substring_index(name, "#", 2), F.lit("#"))
    other = {"name": name, "hash": F.concat(name, F.lit("#")), "null": F.lit(None).cast("string")}[whole]
    return F.when(F.contains(name, F.lit("#")), two).otherwise(other)


def prefix_first(name: Column) -> Column:
    return F.substring_index(name, "#", 1)


def pansn_key(name: Column, level: str = "haplotype") -> Column:
    """The sample, haplotype or sequence a ``sample#haplotype#contig`` name belongs to; null if there is none.

    Leading ``>``, all after the first blank and all after the first ``:`` are dropped.
    """
    base = F.regexp_extract(F.regexp_replace(name, r"^>+", ""), r"^\s*([^\s:]*)", 1)
    sample = F.substring_index(base, "#", 1)
    hap = F.get(F.split(base, "#"), 1)
    key = {"sequence": base, "sample": sample, "haplotype": F.when((sample != "") & (hap != ""), F.concat_ws("#", sample, hap)).otherwise(sample)}[level]
    return F.when(key != "", key)


def cigar_sum(cigar: Column, op: str) -> Column:
    return F.aggregate(F.transform(F.regexp_extract_all(cigar, F.lit(rf"(\d+){op}"), F.lit(1)), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def cigar_counts(cigar: Column) -> Column:
    """Sums of the operations =, X, I and D as a struct; null if the string isn't a CIGAR."""
    good = F.rlike(cigar, F.lit(r"^(\d+[=XIDMNSHP])*$"))
    return F.when(good, F.struct(cigar_sum(cigar, "=").alias("matches"), cigar_sum(cigar, "X").alias("mismatches"), cigar_sum(cigar, "I").alias("insertions"), cigar_sum(cigar, "D").alias("deletions")))


def cigar_identity(cigar: Column) -> Column:
    """Gapped identity in which M counts as a match; null without any column."""
    same = cigar_sum(cigar, "=") + cigar_sum(cigar, "M")
    every = same + cigar_sum(cigar, "X") + cigar_sum(cigar, "I") + cigar_sum(cigar, "D")
    return F.when(every > 0, same / every)


def tags_map(fields: Column, part: str = "value") -> Column:
    """``tag:type:value`` strings as a map of tag to value (or ``type``); the last of a tag holds."""
    good = F.filter(fields, lambda x: F.rlike(x, F.lit("^[^:]*:[^:]*:")))
    of = r"(?s)^[^:]*:[^:]*:(.*)$" if part == "value" else r"^[^:]*:([^:]*):"
    pairs = F.transform(good, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.regexp_extract(x, of, 1).alias("v")))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))


def resolve_identity(matches: Column, block: Column, fields: Column) -> Column:
    """(identity, matches) of a row by its tags in order: ``dv:f:`` sets identity, ``cg:Z:`` with ``=`` operations both; the last wins.

    Without either, identity is matches / block length. M operations say nothing.
    """
    width = F.greatest(block, F.lit(1))
    start = F.struct((matches / width).alias("identity"), matches.alias("matches"))

    def step(acc: Column, tag: Column) -> Column:
        value = F.substring(tag, 6, 1 << 30)
        dv = F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double")
        equal = cigar_counts(value)["matches"]
        return (
            F.when(F.startswith(tag, F.lit("dv:f:")) & dv.isNotNull(), F.struct((1 - dv).alias("identity"), acc["matches"].alias("matches")))
            .when(F.startswith(tag, F.lit("cg:Z:")) & (equal > 0), F.struct((equal / width).alias("identity"), equal.alias("matches")))
            .otherwise(acc)
        )

    return F.aggregate(fields, start, step)


def score(kind: Scoring | str = Scoring.LOG_LENGTH_IDENTITY, length: Column | None = None, identity: Column | None = None) -> Column:
    """The score by which mappings compete, on either axis by their query length; minus infinity without length or identity.

    Rounded to nine places, so that the last bit of a logarithm can't turn a tie.
    """
    n = F.col("query_end") - F.col("query_start") if length is None else length
    i = F.col("identity") if identity is None else identity
    of = {
        Scoring.IDENTITY: i, Scoring.LENGTH: n.cast("double"), Scoring.LENGTH_IDENTITY: n * i,
        Scoring.LOG_LENGTH_IDENTITY: i * F.log(F.greatest(n, F.lit(1))), Scoring.MATCHES: n * i,
    }[Scoring(kind)]
    return F.when((n > 0) & (i > 0), F.round(of, 9)).otherwise(F.lit(float("-inf")))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The common part of two intervals over the shorter one; 0 if that is empty."""
    least = F.least(e1 - s1, e2 - s2)
    return F.when(least > 0, F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2)) / least).otherwise(F.lit(0.0))


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def reverse_complement(kmer: Column) -> Column:
    return F.reverse(F.translate(kmer, "ACGT", "TGCA"))


def kmer_hash(kmer: Column) -> Column:
    """One hash for a k-mer and its reverse complement, bases in upper case."""
    up = F.upper(kmer)
    return F.least(F.xxhash64(up), F.xxhash64(reverse_complement(up)))


def jaccard(a: Column, b: Column) -> Column:
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(F.lit(0.0))


def mash_distance(j: Column, k: int) -> Column:
    """-ln(2 j / (1 + j)) / k, within 0 and 1; 1 for disjoint sketches."""
    return F.when(j <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), -F.log(2 * j / (1 + j)) / k)))


def round_nice(v: Column) -> Column:
    step = F.when(v <= 500, 50).when(v <= 1000, 100).when(v <= 3000, 200).otherwise(500)
    return F.when(v == 0, F.lit(0)).otherwise(F.greatest(step, F.floor((v + F.floor(step / 2)) / step) * step)).cast("long")


def file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def x_identity(x_values: Column, query_span: Column, target_span: Column) -> Column:
    """Identity from per-segment difference counts: 1 - ((sum - (target span - query span)) / query span) / 2, within 0 and 1."""
    total = F.aggregate(x_values, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ((total - (target_span - query_span)) / query_span) / 2))


def end_from_block(start: Column, block: Column) -> Column:
    """The end of a mapping that is kept as start and block length."""
    return start + block


def scaled_identity(identity: Column, steps: int = 10_000) -> Column:
    """Identity in whole steps, as packed tables keep it."""
    return F.greatest(F.lit(0), F.least(F.lit(steps), F.round(identity * steps))).cast("int")
