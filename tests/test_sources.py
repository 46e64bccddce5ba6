import gzip

import pytest

from spanweave.functions import exprs as X
from spanweave.operators import joins, pairs, sets, stats
from spanweave.sources import readers, writers
from pyspark.sql import functions as F

from .helpers import line, mappings, ranks


def put(tmp_path, text, name="x.paf"):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_lenient_and_broken_lines(spark, tmp_path):
    bad = "q\tNOT_A_NUMBER\t5\t10\t?\tt\t9\t-1\t99999999999999999999999\t7\tx"
    text = "\n".join([line("a", 0, 10, "b", 0, 10, 9, 10), "three\tfields\tonly", bad, line("c", 9, 3, "d", 0, 10, 5, 10)]) + "\n"
    got = {r["rank"]: r for r in readers.read_mappings(spark, put(tmp_path, text)).collect()}
    assert sorted(got) == [0, 2, 3]
    assert (got[2]["query_len"], got[2]["strand"], got[2]["target_start"], got[2]["target_end"], got[2]["block_length"], got[2]["identity"]) == (0, "-", -1, 0, 1, 7.0)
    assert readers.read_mappings(spark, put(tmp_path, "", "e.paf")).count() == 0


@pytest.mark.parametrize(("tags", "want"), [("", (0.9, 9)), ("dv:f:0.25", (0.75, 9)), ("cg:Z:8=2X", (0.8, 8)), ("cg:Z:800M", (0.9, 9)), ("dv:f:0.25\tcg:Z:8=2X", (0.8, 8)), ("cg:Z:8=2X\tdv:f:0.25", (0.75, 8)), ("dv:f:bad", (0.9, 9)), ("cg:Z:8=zz", (0.9, 9))])
def test_identity_by_the_last_tag(spark, tmp_path, tags, want):
    r = readers.read_mappings(spark, put(tmp_path, line("a", 0, 10, "b", 0, 10, 9, 10, tags) + "\n")).first()
    assert (pytest.approx(r["identity"]), r["matches"]) == want


def test_strict(spark, tmp_path):
    r = readers.read_mappings(spark, put(tmp_path, line("a", 0, 10, "b", 0, 10, 9, 10, "cg:Z:10M\tNM:i:1\tx:Z:a:b") + "\n"), strict=True).first()
    assert r["cigar"] == "10M" and r["tags"]["NM"] == "1" and r["tags"]["x"] == "a:b" and r["mapq"] == 60
    with pytest.raises(Exception):
        readers.read_mappings(spark, put(tmp_path, "a\tb\n", "y.paf"), strict=True).collect()
    with pytest.raises(Exception):
        readers.read_mappings(spark, put(tmp_path, line("a", "x", 10, "b", 0, 10, 9, 10) + "\n", "z.paf"), strict=True).collect()


def test_gzip_fasta_index_pairs(spark, tmp_path):
    with gzip.open(tmp_path / "a.paf.gz", "wt") as f:
        f.write(line("a", 0, 10, "b", 0, 10, 9, 10) + "\n")
    assert readers.read_mappings(spark, str(tmp_path / "a.paf.gz")).count() == 1
    fa = put(tmp_path, ">A#1#x some text\nACGT\nACG\n>A#1#y\nTT\n>B#1#x\nG\n", "a.fa")
    seqs = readers.read_fasta(spark, fa)
    assert {(r["name"], r["sequence"]) for r in seqs.collect()} == {("A#1#x", "ACGTACG"), ("A#1#y", "TT"), ("B#1#x", "G")}
    sizes = readers.genome_sizes(readers.sequence_lengths(seqs))
    assert {(r["prefix"], r["total_bp"]) for r in sizes.collect()} == {("A#1#", 9), ("B#1#", 1)}
    assert readers.genomes(seqs).count() == 2
    fai = readers.read_index(spark, put(tmp_path, "a\t10\t0\t60\t61\nb\t5\t70\t60\t61\n", "a.fai"))
    assert readers.mean_length(fai).first()["mean"] == 7
    ps = readers.read_pairs(spark, put(tmp_path, "# c\n\na\tb\nc\td\n", "p.tsv"))
    assert {tuple(r) for r in ps.collect()} == {("a", "b"), ("c", "d")}
    assert readers.sniff(spark, fa) == "fasta" and readers.sniff(spark, str(tmp_path / "a.paf.gz")) == "mappings" and readers.sniff(spark, "x.agc") == "archive"
    with pytest.raises(ValueError):
        readers.sniff(spark, put(tmp_path, "hello\n", "h.txt"))
    writers.write_genomes(seqs, str(tmp_path / "genomes"), ["A#1#"])
    assert spark.read.text(str(tmp_path / "genomes")).count() == 4
    writers.write_pairs(ps.select("query", "target"), str(tmp_path / "done"))
    writers.write_pairs(ps.limit(1), str(tmp_path / "done"), append=True)
    assert readers.read_pairs(spark, str(tmp_path / "done")).count() == 3
    assert joins.remaining(ps, readers.read_pairs(spark, str(tmp_path / "done"))).count() == 0


def test_alignment_tables(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a extra", 100, 0, 50, "+", "b", 100, 10, 60, 5)], "rank long, query string, query_len long, query_start long, query_end long, strand string, target string, target_len long, target_start long, target_end long, diffs long")
    rows.write.parquet(str(tmp_path / "t.parquet"))
    r = readers.read_any(spark, str(tmp_path / "t.parquet")).first()
    assert (r["query"], r["matches"], r["block_length"], r["identity"]) == ("a", 45, 100, 0.9)


def test_archive(spark, tmp_path):
    spark.createDataFrame([("HG1", "c1", "ACGT"), ("HG1", "c2", "AC"), ("NA2", "c1", "A")], "sample string, contig string, sequence string").write.parquet(str(tmp_path / "arc"))
    assert readers.archive_sizes(readers.read_archive(spark, str(tmp_path / "arc"), prefix="HG")).first()["total_bp"] == 6
    assert readers.read_archive(spark, str(tmp_path / "arc"), ["NA2"]).count() == 1


@pytest.mark.parametrize(("name", "level", "want"), [("HG#1#c", "sample", "HG"), ("HG#1#c", "haplotype", "HG#1"), ("HG#1#c:10-20 x", "sequence", "HG#1#c"), (">HG##c", "haplotype", "HG"), ("plain", "haplotype", "plain"), ("", "sample", None), ("#1", "sample", None), (" > x", "sequence", ">")])
def test_name_keys(spark, name, level, want):
    assert spark.createDataFrame([(name,)], "n string").select(X.pansn_key(F.col("n"), level)).first()[0] == want


def test_prefixes(spark):
    df = spark.createDataFrame([("a#1#c",), ("plain",)], "n string")
    n = F.col("n")
    assert [tuple(r) for r in df.select(X.prefix_last(n), X.prefix_two(n), X.prefix_two(n, "hash"), X.prefix_two(n, "null"), X.prefix_first(n)).collect()] == [("a#1#",) * 4 + ("a",), ("plain", "plain", "plain#", None, "plain")]


def test_kmers_and_distances(spark):
    df = spark.createDataFrame([("a", "ACGTTGCAACGGTT"), ("b", "AACCGTTGCAACGT"), ("c", "GGGG")], "name string, sequence string")
    s = {r["name"]: r["sketch"] for r in pairs.sketches(df, 4, 100).collect()}
    assert s["a"] == s["b"] and len(s["c"]) == 1  # b is the reverse complement of a
    d = {(r["i"], r["j"]): r["distance"] for r in pairs.sketch_distances(pairs.sketches(df, 4, 100), 4).collect()}
    assert d == {("a", "b"): 0.0, ("a", "c"): 1.0, ("b", "c"): 1.0}
    m = pairs.merged_sketches(pairs.sketches(df, 4, 3), F.lit("all"), 3).first()["sketch"]
    assert m == sorted(m) and len(m) == 3


def test_selection_sizes(spark):
    from spanweave.functions.grammar import selection

    names = spark.createDataFrame([(f"n{k}",) for k in range(4)], "name string")
    assert pairs.select_pairs(names, selection("none")).count() == 6
    assert pairs.select_pairs(names, selection("auto")).count() == 6
    g = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (1, 3), (1, 4)], "g int, i int")
    assert joins.expand_haplotypes(spark.createDataFrame([(0, 1)], "a int, b int"), g).count() == 10
    every = pairs.select_pairs(spark.range(60).selectExpr("cast(id as string) name"), selection("random:0.3"))
    assert every.count() == pairs.select_pairs(spark.range(60).selectExpr("cast(id as string) name"), selection("0.3")).count()
    assert 350 < every.count() < 720
    p = every.selectExpr("i query", "j target")
    a, b = pairs.shuffled_slice(p, 5, 0, 20).collect(), pairs.shuffled_slice(p, 5, 20, 20).collect()
    assert len({*a, *b}) == 40


def test_batches(spark):
    g = spark.createDataFrame([("a", 5), ("b", 6), ("c", 20), ("d", 1), ("e", 2)], "prefix string, total_bp long")
    assert [(r["prefix"], r["batch_id"]) for r in pairs.batches_by_bases(g, 10).orderBy("prefix").collect()] == [("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 3)]
    assert [r["batch_id"] for r in pairs.batches_by_count(g, 2).orderBy("prefix").collect()] == [0, 0, 1, 1, 2]


def test_sets_commands_and_coverage(spark):
    a = mappings(spark, [("A#1#x", 0, 10, "B#1#x", 0, 10, 0.9), ("A#1#x", 5, 10, "B#1#x", 0, 10, 0.9)])
    assert sets.union_distinct([a, a]).count() == 2 and sets.concatenate([a, a]).count() == 4
    assert ranks(sets.only(a, a.filter("rank = 0"))) == [1]
    cmd = writers.pair_commands(spark.createDataFrame([("a b", "c/d")], "query string, target string")).first()["command"]
    assert cmd == "align a_b.fa c_d.fa > a_b_vs_c_d.paf"
    assert stats.genome_coverage(a).first()["coverage"] == pytest.approx(100 * 15 / 10**6)
    assert stats.missing_homologs(a).count() == 1


def test_surveys_read_the_files_own_matches(spark, tmp_path):
    text = "\n".join([line("A#1#x", 0, 100, "B#1#x", 0, 100, 90, 100, "dv:f:0.5"), line("A#1#y", 0, 100, "C#1#x", 0, 100, 90, 100, "cg:Z:50=50X"), line("B#1#y", 0, 100, "C#1#y", 0, 100, 80, 100, "dv:f:bad\tdv:f:0.25\tdv:f:0.9")]) + "\n"
    df = readers.read_mappings(spark, put(tmp_path, text))
    assert {(r["a"], r["b"]): round(r["identity"], 6) for r in stats.genome_identities(df).collect()} == {("A#1#", "B#1#"): 0.5, ("A#1#", "C#1#"): 0.9, ("B#1#", "C#1#"): 0.75}
    assert stats.totals(df).first()["matches"] == 260


def test_block_gzip(spark, tmp_path):
    rows = [line("a", k, k + 10, "b", 0, 10, 9, 10) + "\n" for k in range(50)]
    with open(tmp_path / "x.paf.bgz", "wb") as f:
        for k in range(0, 50, 7):  # a row of gzip members
            f.write(gzip.compress("".join(rows[k : k + 7]).encode()))
    got = readers.read_any(spark, str(tmp_path / "x.paf.bgz")).orderBy("rank").collect()
    assert [(r["rank"], r["query_start"]) for r in got] == [(k, k) for k in range(50)]


def test_lines_are_numbered_in_order_of_files_and_blocks(spark, tmp_path):
    for name, n in (("b.txt", 3000), ("a.txt", 700), ("c.txt", 1)):
        put(tmp_path, "".join(f"{name} {k} {'x' * (k % 50)}\n" for k in range(n)), name)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        got = readers.numbered_lines(spark, str(tmp_path)).orderBy("rank").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r["rank"] for r in got] == list(range(3701))
    assert [r["line"].rsplit(" ", 1)[0] for r in got] == [f"{f} {k}" for f, n in (("a.txt", 700), ("b.txt", 3000), ("c.txt", 1)) for k in range(n)]


def test_records_keep_tag_types(spark, tmp_path):
    text = line("a", 0, 10, "b", 0, 10, 9, 10, "NM:i:1\tcg:Z:10M\tx:f:0.5")
    r = readers.read_mappings(spark, put(tmp_path, text + "\n"), strict=True).select(writers.record_line().alias("l")).first()["l"]
    assert r.split("\t")[12:] == ["cg:Z:10M", "NM:i:1", "x:f:0.5"]


def test_sniffing_and_headers(spark, tmp_path):
    assert readers.sniff(spark, put(tmp_path, "# c\n" * 80 + "\n" + line("a", 0, 10, "b", 0, 10, 9, 10) + "\n", "long.txt")) == "mappings"
    fa = readers.read_fasta(spark, put(tmp_path, ">A a > b\nAC\nGT\n>B x>y\nG\n", "h.fa"))
    assert {(r["name"], r["sequence"]) for r in fa.collect()} == {("A", "ACGT"), ("B", "G")}


def plain_sketch(text, k, size):
    """Hashes of k-mers one by one, by the same column function over a table of k-mers."""
    text = text.upper()
    return [text[i : i + k] for i in range(len(text) - k + 1) if set(text[i : i + k]) <= set("ACGT")]


@pytest.mark.parametrize("chunk", [5, 64, 1 << 16])
def test_sketches_match_plain_kmers(spark, chunk):
    import random

    g = random.Random(chunk)
    texts = {f"s{n}": "".join(g.choice("ACGTACGTACGTNacgt") for _ in range(n)) for n in (0, 3, 4, 5, 6, 63, 64, 65, 400)}
    df = spark.createDataFrame(list(texts.items()), "name string, sequence string")
    got = {r["name"]: r["sketch"] for r in pairs.sketches(df, 4, 40, chunk).collect()}
    kmers = [(n, x) for n, t in texts.items() for x in plain_sketch(t, 4, 40)]
    want = {n: [] for n in texts}
    for r in spark.createDataFrame(kmers, "n string, x string").select("n", X.kmer_hash(F.col("x")).alias("h")).collect():
        want[r["n"]].append(r["h"])
    assert got == {n: sorted(h)[:40] for n, h in want.items()}


def test_commands(spark, tmp_path):
    from spanweave.__main__ import main

    names = [f"{g}#1#c{k}" for g in "ABC" for k in (1, 2)]
    fa = put(tmp_path, "".join(f">{n}\n{'ACGTTGCA' * 5}{'AC' * k}\n" for k, n in enumerate(names)), "all.fa")
    main(["pairs", fa, str(tmp_path / "all")])
    every = {tuple(r) for r in readers.read_pairs(spark, str(tmp_path / "all")).collect()}
    assert len(every) == 15
    parts = []
    for k in range(3):
        main(["pairs", fa, str(tmp_path / "part"), "--shuffle-seed", "7", "--start", str(5 * k), "--max", "5", "--append"])
        parts.append(readers.read_pairs(spark, str(tmp_path / "part")).count())
    assert parts == [5, 10, 15] and {tuple(r) for r in readers.read_pairs(spark, str(tmp_path / "part")).collect()} == every
    main(["pairs", fa, str(tmp_path / "rest"), "--done", str(tmp_path / "part")])
    assert readers.read_pairs(spark, str(tmp_path / "rest")).count() == 0
    main(["jobs", fa, str(tmp_path / "jobs")])
    assert spark.read.text(str(tmp_path / "jobs")).count() == 6
    main(["batches", fa, str(tmp_path / "batches"), "--bases", "200"])
    assert {r["batch_id"] for r in spark.read.text(str(tmp_path / "batches")).collect()} == {0, 1}
