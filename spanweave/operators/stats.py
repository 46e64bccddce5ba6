"""Identity and coverage statistics of mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.exprs import prefix_last


def genome_identities(df: DataFrame, key=prefix_last) -> DataFrame:
    """(a, b, matches, block_length, identity) for pairs a < b of genomes; rows within a genome don't count.

    Rows that were read from a file count the matches of its own column, or what a divergence tag says (``survey_matches``).
    """
    matches = F.col("survey_matches" if "survey_matches" in df.columns else "matches")
    rows = df.select(key(F.col("query")).alias("g"), key(F.col("target")).alias("h"), matches.alias("matches"), "block_length").filter("g <> h")
    sums = rows.groupBy(F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b")).agg(F.sum("matches").alias("matches"), F.sum("block_length").alias("block_length"))
    return sums.withColumn("identity", F.when(F.col("block_length") > 0, F.col("matches") / F.col("block_length")).otherwise(F.lit(0.0)))


def median_identity(pairs: DataFrame) -> DataFrame:
    """One row: the median of the pairs' identities, 0 without any."""
    return pairs.agg(F.coalesce(F.median("identity"), F.lit(0.0)).alias("ani"), F.count("*").alias("pairs"))


def ani_all(df: DataFrame) -> DataFrame:
    return median_identity(genome_identities(df))


def sequence_sizes(df: DataFrame) -> DataFrame:
    """(name, length) of every sequence, by its first mention."""
    both = df.select(F.col("query").alias("name"), F.col("query_len").alias("length"), (F.col("rank") * 2).alias("at")).unionByName(df.select(F.col("target").alias("name"), F.col("target_len").alias("length"), (F.col("rank") * 2 + 1).alias("at")))
    return both.groupBy("name").agg(F.min_by("length", "at").alias("length"))


def best_until_covered(df: DataFrame, percent: float, order: str = "identity") -> DataFrame:
    """The best mappings between genomes, by length, identity or score, until their block lengths reach ``percent`` of all sequence lengths.

    The mapping that reaches it is the last. The order's running sum is made in two levels: sums of ranges of the sort
    key, then within ranges, so no task sorts all mappings.
    """
    rows = df.filter(prefix_last(F.col("query")) != prefix_last(F.col("target")))
    key = {"length": F.col("block_length").cast("double"), "identity": F.col("identity"), "score": F.col("identity") * F.log(F.greatest(F.col("block_length"), F.lit(1)))}[order]
    rows = rows.withColumn("_key", F.round(key, 9)).withColumn("_range", F.floor(F.when(F.lit(order == "length"), F.log2(F.greatest(F.col("_key"), F.lit(1.0))) * 64).otherwise(F.col("_key") * 1024)))
    ranges = rows.groupBy("_range").agg(F.sum("block_length").alias("_sum"))
    ranges = ranges.select("_range", (F.sum("_sum").over(W.partitionBy(F.lit(0)).orderBy(F.col("_range").desc())) - F.col("_sum")).alias("_before"))
    want = (sequence_sizes(df).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("t")).first()["t"]) * percent / 100
    rows = rows.join(ranges, "_range").filter(F.col("_before") < want)
    running = F.sum("block_length").over(W.partitionBy("_range").orderBy(F.col("_key").desc(), "rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("_upto", F.col("_before") + running).filter(F.col("_upto") - F.col("block_length") < want).select(*df.columns)


def ani_percentile(df: DataFrame, percent: float, order: str = "identity") -> DataFrame:
    return ani_all(best_until_covered(df, percent, order))


def totals(df: DataFrame) -> DataFrame:
    """One row of counts and sums over all mappings; matches are those of the file's own column where there is one."""
    matches = F.col("raw_matches" if "raw_matches" in df.columns else "matches")
    span = F.col("query_end") - F.col("query_start")
    same = F.col("query") == F.col("target")
    genome = prefix_last(F.col("query")) == prefix_last(F.col("target"))
    return df.agg(
        F.count("*").alias("mappings"), F.coalesce(F.sum(span), F.lit(0)).alias("bases"), F.coalesce(F.sum(matches), F.lit(0)).alias("matches"),
        F.count_if(same).alias("self_mappings"), F.count_if(~same & genome).alias("between_chromosomes"), F.count_if(~genome & ~same).alias("between_genomes"),
        F.count_distinct(F.struct("query", "target")).alias("chromosome_pairs"),
        F.coalesce(F.sum(matches) / F.nullif(F.sum(span), F.lit(0)), F.lit(0.0)).alias("identity"))


def genome_coverage(df: DataFrame, key=prefix_last) -> DataFrame:
    """(query_genome, target_genome, bases, coverage %) of directed genome pairs: mapped query bases over the query genome's length."""
    rows = df.select(key(F.col("query")).alias("query_genome"), key(F.col("target")).alias("target_genome"), (F.col("query_end") - F.col("query_start")).alias("n")).filter("query_genome <> target_genome")
    bases = rows.groupBy("query_genome", "target_genome").agg(F.sum("n").alias("bases"))
    sizes = sequence_sizes(df).groupBy(key(F.col("name")).alias("query_genome")).agg(F.sum("length").alias("size"))
    return bases.join(sizes, "query_genome").select("query_genome", "target_genome", "bases", (100.0 * F.col("bases") / F.col("size")).alias("coverage"))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """Average coverage, pairs, and pairs over 90, 95 and 99 %."""
    return coverage.agg(F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("average"), F.count("*").alias("pairs"), *(F.count_if(F.col("coverage") > x).alias(f"over_{x}") for x in (90, 95, 99)))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per total: before, after, difference and change in percent."""
    names = ["mappings", "bases", "matches", "self_mappings", "between_chromosomes", "between_genomes", "chromosome_pairs", "identity"]
    long = lambda d, side: totals(d).select(F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias(side)) for n in names))).alias("x")).select("x.*")
    both = long(before, "before").join(long(after, "after"), "measure")
    change = F.col("after") - F.col("before")
    return both.select("measure", "before", "after", change.alias("difference"), F.when(F.col("before") != 0, 100 * change / F.col("before")).otherwise(F.lit(0.0)).alias("percent"))


def filter_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Kept rows and their share, kept megabases and plain mean identity."""
    n = before.agg(F.count("*").alias("rows"), F.lit(1).alias("k"))
    m = after.agg(F.count("*").alias("kept"), (F.coalesce(F.sum("block_length"), F.lit(0)) / 1e6).alias("megabases"), F.coalesce(F.avg("identity"), F.lit(0.0)).alias("identity"), F.lit(1).alias("k"))
    return n.join(m, "k").select("rows", "kept", F.when(F.col("rows") > 0, 100.0 * F.col("kept") / F.col("rows")).otherwise(F.lit(0.0)).alias("percent"), "megabases", "identity")


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


#: Upper edges of coverage bins in percent (fixed values).
BINS = (10, 50, 80, 90, 95, 100)


def chromosome_coverage(df: DataFrame) -> DataFrame:
    """(query, target, coverage %, bin) of chromosome pairs between genomes; ``bin`` is the upper edge of its bin."""
    rows = df.filter(prefix_last(F.col("query")) != prefix_last(F.col("target")))
    sums = rows.groupBy("query", "target").agg((100.0 * F.sum(F.col("query_end") - F.col("query_start")) / F.max("query_len")).alias("coverage"))
    edge = F.lit(None).cast("int")
    for b in reversed(BINS):
        edge = F.when(F.col("coverage") <= b, b).otherwise(edge)
    return sums.withColumn("bin", F.coalesce(edge, F.lit(BINS[-1] + 1)))


def coverage_bins(df: DataFrame) -> DataFrame:
    return chromosome_coverage(df).groupBy("bin").agg(F.count("*").alias("pairs"))


def missing_homologs(df: DataFrame) -> DataFrame:
    """(genome_a, genome_b, chromosome): pairs of genomes that both have a chromosome of one name, without a mapping between the two."""
    chrom = lambda n: F.substring_index(n, "#", -1)
    names = sequence_sizes(df).select(prefix_last(F.col("name")).alias("g"), chrom(F.col("name")).alias("chromosome")).distinct()
    both = names.withColumnRenamed("g", "genome_a").join(names.withColumnRenamed("g", "genome_b"), "chromosome").filter("genome_a <> genome_b")
    have = df.filter(chrom(F.col("query")) == chrom(F.col("target"))).select(prefix_last(F.col("query")).alias("genome_a"), prefix_last(F.col("target")).alias("genome_b"), chrom(F.col("query")).alias("chromosome")).distinct()
    cols = ["genome_a", "genome_b", "chromosome"]
    return both.select(*cols).join(have, cols, "left_anti")
