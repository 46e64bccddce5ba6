import pytest

from spanweave.functions import grammar as G


@pytest.mark.parametrize(("text", "want"), [("10", 10), ("10k", 10_000), ("1.5M", 1_500_000), ("2g", 2 * 10**9)])
def test_metric(text, want):
    assert G.metric_number(text) == want


@pytest.mark.parametrize("text", ["", "k", "10x", "ten"])
def test_metric_bad(text):
    with pytest.raises(ValueError):
        G.metric_number(text)


def test_identity():
    assert G.identity_threshold("0.9") == 0.9 and G.identity_threshold("90") == 0.9
    assert G.identity_threshold("ani50-2", 0.95) == pytest.approx(0.93) and G.identity_threshold("ani+10", 0.95) == 1.0 and G.identity_threshold("ani", 0.5) == 0.5
    for bad in ("ani50", "x"):
        with pytest.raises(ValueError):
            G.identity_threshold(bad)


@pytest.mark.parametrize(("text", "cli", "library"), [("1:1", (1, 1), (1, 1)), ("1", (1, None), (1, 1)), ("1:many", (1, None), (1, None)), ("many:1", (None, 1), (1, 1)), ("many:many", (None, None), (None, None)), ("10:5", (10, 5), (10, 5)), ("∞:1", (None, 1), (1, 1)), ("3", (3, None), (1, 1)), ("junk", (1, 1), (1, 1)), ("0:2", (None, 2), (0, 2)), ("-1", (None, None), (1, 1)), ("n:n", (None, None), (None, None)), ("1:2:3", (1, 1), (1, 1))])
def test_modes(text, cli, library):
    assert G.filter_mode(text) == cli and G.filter_mode(text, "library") == library


def test_mode_zero_and_spec():
    with pytest.raises(ValueError):
        G.filter_mode("0")
    assert G.filter_mode("N", "spec") == (None, None) and G.filter_mode("3:N", "spec") == (3, None) and G.filter_mode("2", "spec") == (2, None)


def test_surveys():
    assert G.ani_method("all").kind == "all" and G.ani_method("1:1").kind == "orthogonal"
    assert G.ani_method("n50") == G.Survey("percentile", 50, "identity") and G.ani_method("n90-length").order == "length"
    assert G.ani_method("n0") is None and G.ani_method("n50-size") is None and G.ani_method("x") is None


@pytest.mark.parametrize(("text", "want"), [("none", "none"), ("all", "none"), ("auto", "auto"), ("0.3", "random:0.3"), ("random:0.5", "random:0.5"), ("giant:0.99", "giant:0.99"), ("connectivity:0.95", "giant:0.95"), ("tree:5:2:0.1", "tree:5:2:0.1"), ("knn:3:1:0.1", "tree:3:1:0.1"), ("tree:4", "tree:4:0:0"), ("density:auto", "density:auto"), ("density:0.3", "density:0.3")])
def test_selections(text, want):
    assert str(G.selection(text)) == want and G.selection(text).description


@pytest.mark.parametrize("text", ["random:1.5", "random:-0.1", "density:0.0", "invalid", "1.5", "giant:1", "tree:0:0", "tree:1:2:3:4", "tree:x"])
def test_selections_bad(text):
    with pytest.raises(ValueError):
        G.selection(text)


def test_arithmetic(tmp_path):
    assert [G.round_nice(v) for v in (0, 7, 120, 730, 1250, 4800)] == [0, 50, 100, 700, 1200, 5000]
    assert G.clamp_scaffolds(50_000, 10_000, 1500) == (15_000, 900) and G.clamp_scaffolds(5, 6, None) == (5, 6) and G.clamp_scaffolds(5, 6, 9, False) == (5, 6)
    assert [G.tree_pair_estimate(*a) for a in ((4, 1, 0, 0), (4, 1, 1, 0), (10, 0, 0, 0.5))] == [4, 6, 23]
    assert G.connectivity_probability(1, 0.9) == 1 and G.connectivity_probability(7, 0.9) == 0.5 and 0.05 < G.connectivity_probability(100, 0.99) < 0.15
    assert G.auto_density(1) is None and G.auto_density(10) is None and 0 < G.auto_density(1000) < 0.1
    assert G.kmer_frequency(None, 0, 8) == 8 and G.kmer_frequency(3, 2, 8) == 3
    assert G.bytes_text(1536, 1024) == "1.50 KB" and G.count_text(12345) == "12,345" and G.signed_text(5) == "+5"
    assert G.peak_disk(G.batch_bases(10**9)) == 10**9
    (tmp_path / "n").write_text("a\n# x\n\nb\n")
    assert G.names_list(f"@{tmp_path / 'n'}") == ["a", "b"] and G.names_list("a, b,") == ["a", "b"]
