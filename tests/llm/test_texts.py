"""Fingerprints, packing, extraction, classifiers."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from spanweave.llm import extract, fingerprint, labelled, packing, quality, toxicity
from spanweave.llm.common import table
from spanweave.llm.tokenize import Words, vocabulary

from .conftest import ODD, untouched

SF = "/root/testdata/sf0.001"


def plain_anchors(text):
    """Closed syncmers k-mer by k-mer, from the same substring hashes."""
    n = len(text)
    if n < fingerprint.K:
        return None
    out = []
    for i in range(n - fingerprint.K + 1):
        word = text[i : i + fingerprint.K]
        inner = [word[j : j + fingerprint.S] for j in range(fingerprint.K - fingerprint.S + 1)]
        h = [inner_hash(x) for x in inner]
        if min(h) in (h[0], h[-1]):
            out.append(i)
    return out


def inner_hash(s, cache={}):  # noqa: B006
    if s not in cache:
        c = np.frombuffer((s + "\0" * fingerprint.K).encode("utf-32-le"), np.uint32)
        with np.errstate(over="ignore"):
            h1 = fingerprint._mix(c.astype(np.uint64) + np.uint64(1))
            h2 = fingerprint._join(h1, h1, 1, 0)
            h4 = fingerprint._join(h2, h2, 2, 1)
            h8 = fingerprint._join(h4, h4, 4, 2)
            cache[s] = int(fingerprint._mix(fingerprint._join(h8, h2, 8, 3))[0])
    return cache[s]


def test_anchors_are_closed_syncmers():
    g = random.Random(2)
    text = "".join(g.choice("abcd é😀") for _ in range(400))
    at, _ = fingerprint.anchors(text)
    assert at.tolist() == plain_anchors(text)
    assert max(np.diff(at)) <= fingerprint.K - fingerprint.S


def test_blocks_and_round_trip(monkeypatch):
    g = random.Random(3)
    text = "".join(g.choice("abcdefgh ") for _ in range(5000))
    whole = fingerprint.anchors(text)
    monkeypatch.setattr(fingerprint, "BLOCK", 300)
    parts = fingerprint.anchors(text)
    again = fingerprint.unpack(fingerprint.pack(whole))
    for a, b, c in zip(whole, parts, again):
        assert a.tolist() == b.tolist() == c.tolist()


def test_likeness():
    g = random.Random(4)
    t = lambda n: "".join(g.choice("abcdefghij ") for _ in range(n))
    a, b = t(3000), t(3000)
    f = fingerprint.anchors
    assert fingerprint.likeness(f(a), f(a)) == 1 and fingerprint.likeness(f(a), f(b)) < 0.01 and fingerprint.likeness(f(""), f("")) == 1 and fingerprint.likeness(f("x"), f("")) == 0
    assert 0.4 < fingerprint.likeness(f(a), f(a[:1500] + b[:1500])) < 0.6
    assert fingerprint.likeness(f(a[1500:] + a[:1500]), f(a)) < 0.6  # order counts


def test_short_texts_have_anchors():
    g = random.Random(6)
    words = ["".join(g.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(g.randint(2, 9))) for _ in range(200)]
    t = lambda n: " ".join(g.choice(words) for _ in range(n))[:n]
    for n in range(1, 90):
        for _ in range(10):
            a, b = t(n), t(n)
            f, h = fingerprint.anchors(a), fingerprint.anchors(b)
            assert len(f[0]) and fingerprint.likeness(f, f) == 1 and fingerprint.likeness(f, fingerprint.anchors("")) == 0
            assert [x.tolist() for x in fingerprint.unpack(fingerprint.pack(f))] == [x.tolist() for x in f]
            assert a == b or fingerprint.likeness(f, h) < 1


def test_short_texts_are_compared_by_position():
    g = random.Random(7)
    t = lambda n: "".join(g.choice("abcdefghij ") for _ in range(n))
    near = [fingerprint.likeness(fingerprint.anchors(a), fingerprint.anchors(fingerprint.edited(a, t(60)))) for a in (t(60) for _ in range(200))]
    assert max(near) < 1 and sum(x > 0 for x in near) > 190 and 0.2 < sum(near) / len(near) < 0.6


def test_next_document(spark):
    docs = table(spark, SF, "documents")
    want = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs.repartition(5)).collect()}
    assert len(got) == len(want)
    for k, (i, t) in enumerate(want):
        n = want[(k + 1) % len(want)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint.pack(fingerprint.anchors(t)) and r["edited_fingerprint"] == fingerprint.pack(fingerprint.anchors(e))
        assert r["near_next"] == pytest.approx(fingerprint.likeness(fingerprint.anchors(t), fingerprint.anchors(n)))


def test_fingerprints_odd(spark, odd, none):
    rows = fingerprint.fingerprints(odd).collect()
    assert len(rows) == len(ODD)
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (0, 4)}
    assert len(same) == 1 and {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)} == {""}
    assert fingerprint.fingerprints(none).count() == 0
    one = fingerprint.fingerprints(odd.filter("doc_id = 0")).first()
    assert one["near_next"] == 1.0


def pieces_hold(rows, ids):
    """rows of packing against {doc: ids}: each id once, sequences gapless."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    assert docs.keys() == ids.keys()
    for i, ps in docs.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[i])
            assert zlib.crc32(np.array(ids[i][at : at + p["length"]], "<u4").tobytes()) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids[i])
    waste = total = 0
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        total, waste = total + at, waste + (0 if at & (at - 1) == 0 else 2048 - at)
    return waste / total


def test_packing(spark):
    docs = table(spark, SF, "documents")
    coder = Words(vocabulary()).tokenizer
    ids = {r["doc_id"]: [*coder.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = packing.pack_documents(docs).collect()
    assert pieces_hold(rows, ids) < 0.02
    assert {tuple(r) for r in packing.pack_documents(docs.repartition(3)).collect()} == {tuple(r) for r in rows}


def test_packing_odd(odd, none):
    rows = packing.pack_documents(odd).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in ODD} and [r["doc_tokens"] for r in rows if r["doc_id"] == 2] == [1]
    assert sum(r["doc_id"] == 5 and r["start"] == 0 for r in rows) == 2
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_pack_loses_nothing(seed):
    g = random.Random(seed)
    lengths = [g.choice([1, 5, 100, 256, 300, 1000, 2048, 2049, 5000]) for _ in range(g.randint(0, 60))]
    made, seen = packing.pack(lengths), {}
    for tier, ps in made:
        assert sum(p[2] for p in ps) <= tier
        for d, s, n in ps:
            for k in range(s, s + n):
                assert (d, k) not in seen
                seen[d, k] = 1
    assert len(seen) == sum(lengths)
    assert sum(sum(p[2] for p in ps) < tier for tier, ps in made) <= 1
    if made:
        steps = packing.step_groups(made, 4096)
        assert set(steps) == set(range(max(steps) + 1)) or len(made) < max(steps) + 1


def test_words_are_the_tokenizers(spark):
    w = Words(vocabulary())
    texts = [r["text"] or "" for r in table(spark, SF, "documents").collect()] + ["", " ", "It's  they'RE  100% naïve Café́ é", "ΑΣ ΟΔΟΣ.", "a\x1cb \x85 c d e", "x <|endoftext|> y <|ENDOFTEXT|>", "İstanbul ﬁne ½ ² x²", "漢字 かな 1２3", "!?'s 's'll ''", "😀😀 a​b ﻿"]
    want = [e.ids for e in w.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in w.encode(texts)] == want
    assert [x.tolist() for x in w.encode(texts[::-1])] == want[::-1]


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, ok?</div><div id="wrap"><div class="sidebar"><p>Side, text. Long enough.</p></div>{body}</div><section id="comments"><p>Great, really. So good.</p></section>
<form><label>mail</label><input></form><!-- <p>no</p> --><script>var t="</p>";</script><footer>&copy; Foot</footer></body></html>"""
INNER = "<h2>Title  &amp; more</h2><p><b>First, with some text; and\n more of it.<br><p>Second. Also long, with commas, and points.</p><p>Short.</p><ul><li>a, b<li>c &lt;d&gt;</ul>"
WANT = "Title & more\nFirst, with some text; and more of it.\nSecond. Also long, with commas, and points.\nShort.\na, b\nc <d>"


@pytest.mark.parametrize("box", ["article", "main", 'div class="post"', "section"])
def test_main_text(box):
    page = PAGE.replace("{body}", f"<{box}>{INNER}</{box.split()[0]}>")
    assert extract.main_text(page) == WANT


@pytest.mark.parametrize("box", ['article class="post category-reviews hentry"', 'div class="entry tag-discussion"', 'form action="/"', 'main id="comment-status"'])
def test_names_do_not_drop_the_article(box):
    page = PAGE.replace("{body}", f"<{box}>{INNER}<div class='share'>Share, now.</div></{box.split()[0]}>")
    assert extract.main_text(page) == WANT


@pytest.mark.parametrize("lengths", [[3] * 12, [40] + [2] * 3, [3] * 30])
def test_sibling_articles(lengths):
    texts = [f"Part {i}, with some words; and then more of them. " * n for i, n in enumerate(lengths)]
    page = PAGE.replace("{body}", "<div>" + "".join(f"<article><p>{t}</p></article>" for t in texts) + "</div>")
    assert extract.main_text(page) == "\n".join(t.strip() for t in texts)


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("<div", ""), ("<p>x &amp;lt; <b>y</b>z</p>", "x &lt; yz"), ("<script>x", ""), ('<p title="a>b">c</p>', "c"), ("<nav>only</nav>", ""), ("a < b", "a < b")])
def test_main_text_odd(page, want):
    assert extract.main_text(page) == want


def test_pages(spark):
    rows = extract.query(spark, SF).collect()
    assert len(rows) == table(spark, SF, "pages").count() and all(r["n_chars"] == len(r["text"]) > 0 and "&copy;" not in r["text"] for r in rows)
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2)], "page_id long, url string, html string, text int")
    assert [r["text"] for r in extract.extract(odd).collect()] == ["", "", ""] and extract.extract(odd.limit(0)).count() == 0


def fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"))
    y = np.array(y, bool)
    return (order[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum())


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.7), (quality, "quality", 0.85)])
def test_held_out_accuracy(spark, module, label, least):
    sf = "/root/testdata/sf0.01"
    y = {r["doc_id"]: r[label] for r in table(spark, sf, "labels").collect()}
    rows = module.query(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    assert all(r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= (0.5 if label == "toxic" else 0.3)) for r in rows)
    held = [(y[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in y]
    assert auc([a for a, _ in held], [b for _, b in held]) > least


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_odd(spark, odd, none, module):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, None, None), (4, 0, 1), (5, 1, 0), (None, 1, 1), (5, 0, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    label = "toxic" if module is toxicity else "quality"
    sample = labelled.sample(odd, labels, label, module.MOST, module.MAX_CHARS)
    assert len(sample.texts) == len(sample.y) <= 5
    model = module.train(sample)
    rows = module.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert module.score(none, model).count() == 0
    if module is quality:
        kept = quality.keep(odd, model, 0.0)
        assert kept.columns == odd.columns and kept.count() == len(ODD) and untouched(kept.collect())
    blank = module.train(labelled.sample(none, labels.limit(0), label, module.MOST, module.MAX_CHARS))
    assert all(0 <= r["score"] <= 1 for r in module.score(odd, blank).collect())


def test_sample_is_drawn_among_texts_that_fit(spark):
    docs = spark.createDataFrame([(i, "x" * (50 if i % 2 else 5)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(200)], "doc_id long, quality boolean")
    fits = [i for i in range(0, 200, 2) if not fold(i)]
    s = labelled.sample(docs, labels, "quality", (10, 1000), 20)
    assert s.counts == (sum(i % 3 != 0 for i in fits), sum(i % 3 == 0 for i in fits)) and s.y.count(0) == 10 and s.y.count(1) == s.counts[1] and set(s.texts) == {"xxxxx"}


def plain_toxicity(model, text):
    """The score n-gram by n-gram, each place of the table once, from the model's weights and the hash of the n-gram alone."""
    t = " " + " ".join(text.lower().split()) + " "
    places = {one_gram(g) for n in toxicity.SIZES for g in (t[i : i + n] for i in range(len(t) - n + 1))}
    z = sum(float(model.weight[p]) for p in places) + model.bias
    return 1 / (1 + np.exp(-z))


def one_gram(g):
    """The table place of one n-gram, character by character."""
    mask, h = (1 << 64) - 1, 0
    for k, ch in enumerate(g):
        c = ord(ch) * int(toxicity._M1) & mask
        c ^= c >> 29
        h = c if not k else (h * int(toxicity._STEP) + c) & mask
    return ((h ^ (h >> 31)) * int(toxicity._M2) & mask) >> (64 - toxicity.BITS)


def test_toxicity_matches_plain_scores(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.train(labelled.sample(docs, labels, "toxic", toxicity.MOST, toxicity.MAX_CHARS))
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    some = [r for r in toxicity.score(docs, model).collect() if len(text[r["doc_id"]]) < 3000][:40]
    assert some and all(r["score"] == pytest.approx(plain_toxicity(model, text[r["doc_id"]]), abs=1e-5) for r in some)


def plain_quality(model, text):
    """The network's answer for one text, chunk by chunk and place by place."""
    raw = text.encode()
    tops = []
    for j in range(1 + max(0, -(-(len(raw) - quality.CHUNK) // quality.HOP))):
        part = list(raw[j * quality.HOP : j * quality.HOP + quality.CHUNK])
        e = model.embed[np.array(part + [quality.PAD] * (quality.CHUNK - len(part)))]
        h1 = [np.maximum(e[i : i + quality.WIDTH1].ravel() @ model.w1 + model.b1, 0) for i in range(0, quality.CHUNK - quality.WIDTH1 + 1, quality.STRIDE1)]
        h2 = [np.concatenate(h1[i : i + quality.WIDTH2]) @ model.w2 + model.b2 for i in range(0, len(h1) - quality.WIDTH2 + 1, quality.STRIDE2)]
        tops.append(np.maximum(np.max(h2, 0), 0))
    z = np.concatenate((np.mean(tops, 0), np.max(tops, 0))) @ model.w3 + model.b3
    return 1 / (1 + np.exp(-float(z)))


def test_quality_matches_plain_scores(spark):
    docs = table(spark, SF, "documents")
    model = quality._start(0.4)
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    some = sorted(quality.score(docs, model).collect(), key=lambda r: r["doc_id"])[:25]
    assert all(r["score"] == pytest.approx(plain_quality(model, text[r["doc_id"]]), abs=1e-4) for r in some)


def test_chunks_cover_whole_texts():
    for n in (0, 1, 1023, 1024, 1025, 1920, 1921, 5000):
        x, counts = quality.chunks(["x" * n])
        assert counts[0] == len(x) and (x != quality.PAD).sum() >= n
        covered = {j * quality.HOP + k for j, row in enumerate(x) for k in np.flatnonzero(row != quality.PAD).tolist()}
        assert covered == set(range(n))


def test_gradients():
    g = np.random.default_rng(0)
    model = quality._start(0.5)
    texts, y, w = ["hello world " * 5, "ABC!! " * 200], np.array([0, 1], np.float32), np.array([1.0, 2.0])
    grads = quality._gradients(model, texts, y, w)

    def loss():
        p = model.probabilities(texts)
        return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * w).sum() / len(y))

    for name in ("embed", "w1", "w2", "w3"):
        a = getattr(model, name)
        at = np.unravel_index(np.argmax(np.abs(grads[name])), a.shape)
        eps, keep = np.float32(2e-3), a[at]
        a[at] = keep + eps
        up = loss()
        a[at] = keep - eps
        down = loss()
        a[at] = keep
        assert (up - down) / (2 * eps) == pytest.approx(float(grads[name][at]), rel=0.1, abs=1e-3), name
    assert g is not None


def test_grams_in_blocks(monkeypatch):
    text = "some words and More words " * 40
    whole = sorted(set(toxicity.grams(text).tolist()))
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    assert sorted(set(toxicity.grams(text).tolist())) == whole


PROSE = [f"Paragraph {k} tells, at some length, what there is to say; it goes on for a while, with commas, and then it ends. And so on." for k in range(5)]
NEUTRAL = """<html><body><div class="a1"><ul class="x"><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact us</a></li></ul></div>{box}
<div class="c3"><div class="d"><p>Great, thanks.</p></div><div class="d"><p>I agree.</p></div><div class="d"><p>No.</p></div></div><div class="e">Copyright 2020 Some Firm</div></body></html>"""


def test_neutral_pages_by_path_ratios():
    article = "<h1>A title</h1>" + "".join(f"<p>{x}</p>" for x in PROSE[:3]) + "<ul><li>one</li><li>two</li></ul>" + "".join(f"<p>{x}</p>" for x in PROSE[3:])
    want = "\n".join(["A title", *PROSE[:3], "one", "two", *PROSE[3:]])
    assert extract.main_text(NEUTRAL.replace("{box}", f'<div class="b2">{article}</div>')) == want
    flat = NEUTRAL.replace("{box}", "".join(f"<p>{x}</p>" for x in PROSE))
    assert extract.main_text(flat).startswith("\n".join(PROSE)) and "Home" not in extract.main_text(flat)


def test_names_inside_an_article_are_hints_only():
    inside = f"<p>{PROSE[0]}</p><p class='notice'>{PROSE[1]}</p><div class='social-history'>{PROSE[2]}</div><div class='ad'>Buy, now!</div><div class='share'>Share it.</div>"
    assert extract.main_text(f"<article><h1>T</h1>{inside}</article><div class='comments'><p>{PROSE[3]}</p></div>") == "\n".join(["T", *PROSE[:3]])


def test_scores_decide(spark, monkeypatch):
    pages = [r["html"] for r in table(spark, SF, "pages").collect()]
    before = [extract.main_text(x) for x in pages]
    monkeypatch.setattr(extract, "_scores", lambda page, units: {e.path: 1.0 for e, _, _ in units})
    assert sum(extract.main_text(x) != y for x, y in zip(pages, before)) > len(pages) / 2


def plain_scores(page, units):
    """The scores pair by pair of units, from whole paths."""
    def way(p):
        out = []
        while p > 0:
            out.append(p)
            p = page.above[p]
        return out[::-1]

    def far(a, b):
        a, b = way(a), way(b)
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        return len(a) + len(b) - 2 * same

    of = {}
    for e, n, m in units:
        of.setdefault(e.path, []).append((n, m))
    mean = {p: tuple(sum(x[k] for x in v) / len(v) for k in (0, 1)) for p, v in of.items()}
    got = {}
    for i, (e, _, _) in enumerate(units):
        w = [np.exp(-((i - j) ** 2) / 2 - far(e.path, u[0].path)) * (abs(i - j) <= extract.REACH and far(e.path, u[0].path) <= extract.STEPS) for j, u in enumerate(units)]
        x, y = (sum(a * mean[u[0].path][k] for a, u in zip(w, units)) / sum(w) for k in (0, 1))
        got.setdefault(e.path, []).append((x * e.hint, y))
    return {p: sum(x for x, _ in v) / len(v) * (1 + sum(y for _, y in v) / len(v)) for p, v in got.items()}


def test_scores_match_plain_version(spark, monkeypatch):
    seen = []
    inner = extract._scores
    monkeypatch.setattr(extract, "_scores", lambda page, units: seen.append((plain_scores(page, units), inner(page, units))) or seen[-1][1])
    for r in table(spark, SF, "pages").limit(25).collect():
        extract.main_text(r["html"])
    extract.main_text(NEUTRAL.replace("{box}", f"<section><div><blockquote><p>{PROSE[0]}</p></blockquote></div></section>"))
    assert len(seen) >= 20
    for want, got in seen:
        assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "x" + "</div>" * 60_000, "<b>" * 60_000 + "x", "<p><b>x" * 20_000, "<i><div>" * 20_000 + "</i>" * 20_000])
def test_deep_pages_take_linear_time(page):
    import time

    began = time.process_time()
    extract.main_text(page)
    assert time.process_time() - began < 10
