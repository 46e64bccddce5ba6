"""The pipeline against a plain version of each stage on that stage's own input."""

import corpus_pipeline
from spanweave.llm import quality
from spanweave.llm.common import table, written

from .test_native import counts, plain_verdicts
from .test_neardup import brute
from .test_texts import pieces_hold, plain_quality

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = written(stage(spark, docs, SF), "test-stage")
        if name == "packing":
            from spanweave.llm.tokenize import Words, vocabulary

            coder = Words(vocabulary()).tokenizer
            assert pieces_hold(out.collect(), {i: [*coder.encode(r["text"], add_special_tokens=False).ids, 1] for i, r in before.items()}) < 0.02
            continue
        after = {r["doc_id"]: r for r in out.collect()}
        assert out.columns == columns and len(after) == out.count() and all(before[i] == r for i, r in after.items()), name
        if name == "quality rules":
            want = plain_verdicts([(i, r["text"] or "", r["lang"], r["source"]) for i, r in before.items()])
            assert all(want[i] is None or want[i] == (i in after) for i in before)
        elif name == "quality classifier":
            model = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
            p = {i: plain_quality(model, r["text"]) for i, r in before.items() if len(r["text"]) < 20_000}
            assert len(p) > 0.9 * len(before) and all(abs(x - 0.3) < 1e-3 or (x >= 0.3) == (i in after) for i, x in p.items())
        elif name == "near-duplicates":
            from spanweave.llm.neardup import Rule

            assert after.keys() == {i for i, (_, c) in brute([(i, r["text"]) for i, r in before.items()], Rule()).items() if i == c}
        elif name == "mixture":
            n = {i: counts(r["text"])[0] for i, r in before.items()}
            # what a leaf leaves unspent is less than its next document
            most = {}
            for i, r in before.items():
                leaf = r["source"], r["lang"]
                most[leaf] = max(most.get(leaf, 0), n[i])
            taken, half = sum(n[i] for i in after), sum(n.values()) // 2
            assert half - sum(most.values()) <= taken <= half
        docs = out


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())
