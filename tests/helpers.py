"""Small inputs: mappings from tuples, lines of alignment text."""

from spanweave.schema import MAPPING


def mappings(spark, rows):
    """rows: (query, query_start, query_end, target, target_start, target_end, identity[, strand])."""
    out = []
    for k, r in enumerate(rows):
        q, qs, qe, t, ts, te, i = r[:7]
        block = max(qe - qs, te - ts, 1)
        out.append((k, q, 10**6, qs, qe, r[7] if len(r) > 7 else "+", t, 10**6, ts, te, int(round(block * i)), block, float(i)))
    return spark.createDataFrame(out, MAPPING)


def line(q, qs, qe, t, ts, te, matches, block, tags="", strand="+", n=10**6):
    return "\t".join(map(str, [q, n, qs, qe, strand, t, n, ts, te, matches, block, 60])) + ("\t" + tags if tags else "")


def ranks(df):
    return sorted(r["rank"] for r in df.select("rank").collect())
