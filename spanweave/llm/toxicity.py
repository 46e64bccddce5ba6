"""Operator 5, toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import small_batches, table
from .labelled import Sample, held_out, sample

#: n-grams, and bits of the table into which they are hashed.
SIZES, BITS = (4, 5, 6), 20
#: Training rows: without and with the label at most, and code points of one at most.
MOST, MAX_CHARS = (6000, 4000), 20_000
#: Added to every count; features in fewer training rows, or with a smaller log ratio, have no weight.
ALPHA, LEAST_ROWS, LEAST_RATIO = 1.0, 3, 1.5
ROUNDS, RATE, RIDGE = 60, 0.1, 1e-3
BLOCK = 1 << 20
_M1, _M2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def grams(text: str) -> np.ndarray:
    """Table places of all n-grams of a whole text in lower case, white space as one blank, with a blank at each end; not unique."""
    text = " " + " ".join(text.lower().split()) + " "
    out = []
    for at in range(0, len(text), BLOCK):
        c = np.frombuffer(text[at : at + BLOCK + SIZES[-1] - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * _M1
        c ^= c >> np.uint64(29)
        h = c
        for n in range(2, SIZES[-1] + 1):
            if len(h) < 2:
                break
            h = h[:-1] * _STEP + c[n - 1 :]
            if n in SIZES:
                own = h[:BLOCK]
                out.append((((own ^ (own >> np.uint64(31))) * _M2) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _unique(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


@dataclass(frozen=True)
class Model:
    #: The product of log-count ratio and learned weight of each table place.
    weight: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        at = grams(text)
        at = _unique(at[self.weight[at] != 0])
        z = float(self.weight[at].sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(rows: Sample) -> Model:
    """Ratios of the shares of each class's training rows that hold a feature; then logistic regression on the scaled features.

    Without rows of both classes the score is the share of the label (0.5 if nothing is labelled).
    """
    total = max(1, sum(rows.counts))
    prior = np.log((rows.counts[1] + 0.5) / (rows.counts[0] + 0.5))
    y = np.array(rows.y, np.float64)
    size = 1 << BITS
    if len(set(rows.y)) < 2:
        return Model(np.zeros(size, np.float32), float(prior) if total > 1 else 0.0)
    seen = np.zeros((2, size))
    for t, label in zip(rows.texts, rows.y, strict=True):
        seen[label, _unique(grams(t))] += 1
    rows_of = np.bincount(y.astype(int), minlength=2)
    ratio = np.log((seen[1] + ALPHA) / (rows_of[1] + 2 * ALPHA)) - np.log((seen[0] + ALPHA) / (rows_of[0] + 2 * ALPHA))
    ratio[(seen.sum(0) < LEAST_ROWS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    cols, ends = [], []
    for t in rows.texts:
        at = _unique(grams(t))
        cols.append(at[ratio[at] != 0])
        ends.append(len(cols[-1]))
    col, row = np.concatenate(cols), np.repeat(np.arange(len(ends)), ends)
    used, col = np.unique(col, return_inverse=True)
    x = ratio[used]
    # the class weights of the sample are set to those of all labelled rows
    share = np.array([rows.counts[0] / max(1, (y == 0).sum()), rows.counts[1] / max(1, (y == 1).sum())])
    weight = share[y.astype(int)]
    weight /= weight.sum()
    w, b = np.zeros(len(used)), float(prior)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, ROUNDS + 1):
        z = np.bincount(row, (x * w)[col], minlength=len(y)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        g = np.bincount(col, d[row], minlength=len(used)) * x + RIDGE * w
        gb = d.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= RATE / 10 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        b -= RATE * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.999**k)) + 1e-9)
    out = np.zeros(size, np.float32)
    out[used] = x * w
    return Model(out, float(b))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. Null text counts as empty; a null id isn't held out. Other columns are ignored."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 4 MB at any input size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([shared.value.score(t) for t in b.column("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(sample(docs, table(spark, sf_dir, "labels"), "toxic", MOST, MAX_CHARS)))
