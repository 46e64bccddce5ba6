import pytest

from spanweave.operators import stats
from spanweave.plans import filtering
from spanweave.plans.align import align_and_filter, config_from_options, haplotype_pairs, pairs_for
from spanweave.schema import FilterConfig
from spanweave.sources import readers, writers

from .helpers import line, mappings, ranks


def parsed(spark, tmp_path, lines):
    p = tmp_path / "in.paf"
    p.write_text("\n".join(lines) + "\n")
    return readers.read_mappings(spark, str(p)).drop("line")


def mapping_level(**kw):
    return config_from_options(gap=0, **kw)


def test_default_sweep(spark, tmp_path):
    rows = [line("query1", a, b, "target1", a, b, b - a, b - a, f"cg:Z:{b - a}M") for a, b in ((100, 900), (150, 850), (200, 600))] + [line("query2", a, b, "target2", a, b, b - a, b - a) for a, b in ((100, 1400), (200, 1200))]
    df = parsed(spark, tmp_path, rows)
    assert ranks(filtering.filter_mappings(df, mapping_level(num_mappings="1:1"))) == [0, 3]
    assert ranks(filtering.filter_mappings(df, mapping_level())) == [0, 1, 2, 3, 4]


def test_secondaries(spark, tmp_path):
    rows = [line("chr1", 1000, 2000, "chr1_ref", t, t + 1000, 1000, 1000) for t in (1000, 3000, 5000, 7000, 9000)]
    assert ranks(filtering.filter_mappings(parsed(spark, tmp_path, rows), mapping_level(num_mappings="3"))) == [0, 1, 2]


def test_genome_pairs(spark, tmp_path):
    apart = [line("A#1#chr1", 0, 500, f"{g}#1#chr1", 0, 500, m, 500) for g, m in (("B", 450), ("C", 400), ("D", 350))]
    assert ranks(filtering.filter_mappings(parsed(spark, tmp_path, apart), mapping_level(num_mappings="1:1"))) == [0, 1, 2]
    within = [line("A#1#chr1", 0, 500, "B#1#chr1", 0, 500, 450, 500), line("A#1#chr1", 0, 500, "B#1#chr2", 0, 500, 400, 500), line("A#1#chr2", 0, 500, "B#1#chr1", 0, 500, 350, 500)]
    assert ranks(filtering.filter_mappings(parsed(spark, tmp_path, within), mapping_level(num_mappings="1:1"))) == [0]


def test_across_targets_and_target_axis(spark, tmp_path):
    rows = [line("genome1#chrA", 10000, 20000, "genome2#chrA", 10000, 20000, 9500, 10000), line("genome1#chrA", 12000, 18000, "genome2#chrB", 12000, 18000, 5400, 6000)]
    assert ranks(filtering.filter_mappings(parsed(spark, tmp_path, rows), mapping_level(num_mappings="1:1", overlap=0.5))) == [0]
    rows = [line("genome1#chrA", 10000, 20000, "genome2#chrX", 10000, 20000, 9500, 10000), line("genome1#chrB", 10000, 20000, "genome2#chrX", 12000, 22000, 9800, 10000)]
    assert ranks(filtering.filter_mappings(parsed(spark, tmp_path, rows), mapping_level(num_mappings="1:1", overlap=0.5))) == [1]


SCAFFOLD = {"gap": 10_000, "length": 1000, "scaffold_filter": "1:1"}


def cg(m, n):
    return f"cg:Z:{m}={n - m}X"


def test_scaffolds_of_one_pair(spark, tmp_path):
    rows = [line("chr1", 10000, 15000, "t1", 10000, 15000, 4750, 5000, cg(4750, 5000)), line("chr1", 15000, 20000, "t1", 15000, 20000, 4750, 5000, cg(4750, 5000)),
            line("chr1", 12000, 17000, "t1", 30000, 35000, 4900, 5000, cg(4900, 5000)), line("chr1", 17000, 22000, "t1", 35000, 40000, 4900, 5000, cg(4900, 5000))]
    df = parsed(spark, tmp_path, rows)
    out = filtering.filter_mappings(df, config_from_options(**SCAFFOLD))
    assert ranks(out) == [2, 3] and {r["chain_status"] for r in out.collect()} == {"scaffold"}
    rows[2:] = [r.replace("\tt1\t", "\tt2\t") for r in rows[2:]]
    assert ranks(filtering.filter_mappings(parsed(spark, tmp_path, rows), config_from_options(**SCAFFOLD))) == [0, 1, 2, 3]


def test_least_length_is_a_span(spark, tmp_path):
    rows = [line("query1", k * 1100, k * 1100 + 1000, "t", k * 1100, k * 1100 + 1000, 1000, 1000) for k in range(10)] + [line("query2", k * 1100, k * 1100 + 1000, "t2", k * 1100, k * 1100 + 1000, 1000, 1000) for k in range(5)]
    out = filtering.filter_mappings(parsed(spark, tmp_path, rows), config_from_options(gap=10_000, length=10_000))
    assert ranks(out) == list(range(10))
    far = [line("q", a, a + 1000, "t", a, a + 1000, 1000, 1000) for a in (0, 99_000)]
    assert ranks(filtering.filter_mappings(parsed(spark, tmp_path, far), config_from_options(gap=100_000, length=50_000))) == [0, 1]


def test_reverse_can_win(spark, tmp_path):
    rows = [line("A#1#c", 10_000_000, 11_000_000, "B#1#c", 10_000_000, 11_000_000, 950_000, 1_000_000, n=10**8), line("A#1#c", 10_000_000, 12_000_000, "B#1#c", 20_000_000, 22_000_000, 1_900_000, 2_000_000, strand="-", n=10**8)]
    df = parsed(spark, tmp_path, rows)
    assert 1 in ranks(filtering.filter_mappings(df, config_from_options(gap=100_000, scaffold_filter="1:1")))
    assert ranks(filtering.filter_mappings(df, config_from_options(gap=100_000))) == [0, 1]


def test_inversion_and_rescue(spark):
    rows = [("q", 0, 20_000, "t", 0, 20_000, 1.0), ("q", 21_000, 40_000, "t", 21_000, 40_000, 1.0), ("q", 30_000, 30_500, "t", 30_200, 30_700, 0.9, "-"), ("q", 41_000, 41_100, "t", 60_000, 60_100, 0.9), ("q", 300_000, 300_100, "t", 300_000, 300_100, 0.9)]
    df = mappings(spark, rows)
    got = {r["rank"]: (r["chain_id"], r["chain_status"]) for r in filtering.filter_mappings(df, FilterConfig(scaffold_gap=5000, min_scaffold_length=10_000)).collect()}
    assert got == {k: ("chain_1", "scaffold") for k in (0, 1, 2)}
    got = {r["rank"]: r["chain_status"] for r in filtering.filter_mappings(df, FilterConfig(scaffold_gap=5000, min_scaffold_length=10_000, rescue_distance=40_000)).collect()}
    assert got == {0: "scaffold", 1: "scaffold", 2: "scaffold", 3: "rescued"}
    assert ranks(filtering.filter_mappings(df, FilterConfig(scaffold_gap=5000, min_scaffold_length=10_000, scaffolds_only=True))) == [0, 1]


def test_members_of_a_dropped_scaffold_are_not_rescued(spark):
    rows = [("q", 0, 10_000, "t", 0, 10_000, 1.0), ("q", 0, 9_000, "t", 12_000, 21_000, 0.9)]
    out = filtering.filter_mappings(mappings(spark, rows), FilterConfig(scaffold_gap=1000, min_scaffold_length=1000, scaffold_query_limit=1, scaffold_target_limit=1, rescue_distance=50_000))
    assert ranks(out) == [0]


def test_text_to_text(spark, tmp_path):
    p = tmp_path / "a.paf"
    p.write_text("\n".join(["short\tline", line("q", 0, 20000, "t", 0, 20000, 19000, 20000), line("q", 100, 100, "t", 5, 5, 1, 1), line("s", 0, 10, "s", 0, 10, 10, 10)]) + "\n")
    filtering.filter_text(spark, str(p), str(tmp_path / "out"), FilterConfig(min_scaffold_length=1000))
    got = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(got) == 1 and got[0].endswith("\tch:Z:chain_1\tst:Z:scaffold") and got[0].startswith("q\t")
    filtering.filter_text(spark, str(p), str(tmp_path / "all"), passthrough=True)
    assert spark.read.text(str(tmp_path / "all")).count() == 4


def test_surveys(spark):
    rows = [("A#1#x", 0, 2000, "B#1#x", 0, 2000, 0.9), ("A#1#x", 0, 2000, "C#1#x", 0, 2000, 0.8), ("B#1#x", 0, 2000, "C#1#x", 0, 2000, 0.7), ("A#1#x", 0, 2000, "A#1#y", 0, 2000, 0.1)]
    df = mappings(spark, rows)
    assert filtering.survey(df).first()["ani"] == pytest.approx(0.8)
    assert filtering.survey(df, "orthogonal").first()["pairs"] == 3
    assert filtering.survey(df, "percentile", 0.03).first()["ani"] == pytest.approx(0.9)
    assert stats.ani_all(df.limit(0)).first()["ani"] == 0.0
    assert ranks(filtering.tree_filter(df, 1)) == [0, 1]


def test_align_with_own_aligner(spark):
    seqs = spark.createDataFrame([("A#1#x", "ACGT" * 50), ("B#1#x", "ACGT" * 50), ("C#1#x", "TTGA" * 50)], "name string, sequence string")

    def aligner(q, t):
        n = min(len(q), len(t))
        same = sum(a == b for a, b in zip(q, t))
        yield {"query_start": 0, "query_end": n, "strand": "+", "target_start": 0, "target_end": n, "matches": same, "block_length": n, "identity": same / n}

    out = align_and_filter(seqs, aligner, "none", FilterConfig(scaffold_gap=0, min_identity=0.9))
    assert {(r["query"], r["target"]) for r in out.collect()} == {("A#1#x", "B#1#x"), ("B#1#x", "A#1#x")}
    assert pairs_for(seqs, "tree:1").count() >= 2 and haplotype_pairs(seqs, "none").count() == 3


def test_config_rejects_nonsense():
    with pytest.raises(ValueError):
        FilterConfig(query_limit=0)
    with pytest.raises(ValueError):
        FilterConfig(scaffold_gap=-1)


def test_lines_out(spark):
    df = mappings(spark, [("q", 0, 10, "t", 5, 15, 0.5)])
    assert df.select(writers.mapping_line("dv:f:")).first()[0].endswith("\t60\tdv:f:0.500000")


def test_command_line(spark, tmp_path):
    from spanweave.__main__ import main

    p = tmp_path / "a.paf"
    p.write_text("\n".join([line("A#1#x", 0, 20000, "B#1#x", 0, 20000, 19000, 20000), line("A#1#x", 100, 5000, "C#1#x", 5, 4905, 4000, 4900)]) + "\n")
    assert main(["filter", str(p), str(tmp_path / "o1"), "--num-mappings", "1:1", "--min-identity", "ani50-5", "--ani-method", "all", "--scaffold-mass", "1k"]) == 0
    assert spark.read.text(str(tmp_path / "o1")).count() == 1
    for k, extra in enumerate((["--no-filter"], ["--sparsify", "tree:1"], ["--sparsify", "giant:0.9", "--scaffold-jump", "0"])):
        assert main(["filter", str(p), str(tmp_path / f"p{k}"), *extra]) == 0
    assert main(["stats", str(p), "-d"]) == 0 and main(["stats", str(p), str(p)]) == 0
    with pytest.raises(SystemExit):
        main(["filter", str(p), str(tmp_path / "x"), "--sparsify", "auto"])


def test_giant_filter(spark):
    rows = [("A#1#x", 0, 2000, "B#1#x", 0, 2000, 0.9), ("A#1#x", 0, 2000, "A#1#y", 0, 2000, 0.1)]
    assert ranks(filtering.giant_filter(mappings(spark, rows))) == [0]


def test_contained_with_rescue(spark):
    df = mappings(spark, [("q", 10, 20, "t", 10, 20, 1.0), ("q", 90, 130, "t", 90, 130, 1.0), ("q", 5000, 5010, "t", 5000, 5010, 1.0)])
    boxes = mappings(spark, [("q", 0, 100, "t", 0, 100, 1.0)])
    assert {r["rank"]: r["chain_status"] for r in filtering.contained_with_rescue(df, boxes, 200).collect()} == {0: "scaffold", 1: "rescued"}
