"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from . import extract, fingerprint, mix, neardup, packing, quality, rules, shard, toxicity, urls

QUERIES = {
    "op1_mix": mix.query,
    "op2_syncmers": fingerprint.query,
    "op3_pack": packing.query,
    "op4_shard": shard.query,
    "op5_toxicity": toxicity.query,
    "op6_quality": quality.query,
    "op7_neardup": neardup.query,
    "op8_rules": rules.query,
    "op9_extract": extract.query,
    "op10_urls": urls.query,
}

ORACLES = {"op1_mix": mix.ORACLE, "op10_urls": urls.ORACLE}
