"""Operator 6, quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import renamed, small_batches, table
from .labelled import Sample, held_out, sample

#: Bytes of a chunk and from one chunk to the next: neighbours share more than a filter spans.
CHUNK, HOP = 1024, 896
EMBED, WIDTH1, STRIDE1, FILTERS1 = 8, 8, 4, 16
WIDTH2, STRIDE2, FILTERS2 = 6, 3, 24
PAD = 256
#: Training rows of class 0 and 1 at most, code points of one at most, passes, rows of a batch, rate.
MOST, MAX_CHARS = (2000, 3000), 20_000
EPOCHS, BATCH, RATE, SEED = 5, 24, 4e-3, 11
#: Chunks that are in memory at once.
AT_ONCE = 256


def chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of whole texts as rows of overlapping chunks, padded, and the number of chunks of each text (1 at least)."""
    raw = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    counts = np.array([1 + max(0, -(-(len(r) - CHUNK) // HOP)) for r in raw], np.int64)
    out = np.full((int(counts.sum()), CHUNK), PAD, np.uint16)
    k = 0
    for r, n in zip(raw, counts.tolist(), strict=True):
        for j in range(n):
            part = r[j * HOP : j * HOP + CHUNK]
            out[k + j, : len(part)] = part
        k += n
    return out, counts


def _windows(x: np.ndarray, width: int, stride: int) -> np.ndarray:
    """(rows, positions, width * depth) of (rows, length, depth)."""
    r, n, d = x.shape
    at = (n - width) // stride + 1
    s = x.strides
    view = np.lib.stride_tricks.as_strided(x, (r, at, width * d), (s[0], s[1] * stride, s[2]))
    return np.ascontiguousarray(view).reshape(r * at, width * d), at


@dataclass
class Model:
    embed: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    w3: np.ndarray
    b3: np.ndarray

    def features(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The largest answer of each second filter in each chunk."""
        e = self.embed[x]
        a, n1 = _windows(e, WIDTH1, STRIDE1)
        h1 = np.maximum(a @ self.w1 + self.b1, 0).reshape(len(x), n1, FILTERS1)
        c, n2 = _windows(h1, WIDTH2, STRIDE2)
        h2 = (c @ self.w2 + self.b2).reshape(len(x), n2, FILTERS2)
        top = h2.argmax(1) if keep is not None else None
        m = np.maximum(h2.max(1), 0)
        if keep is not None:
            keep.update(a=a, n1=n1, h1=h1, c=c, n2=n2, top=top, m=m)
        return m

    def probabilities(self, texts: list[str]) -> np.ndarray:
        x, counts = chunks(texts)
        m = np.concatenate([self.features(x[i : i + AT_ONCE]) for i in range(0, len(x), AT_ONCE)])
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        doc = np.concatenate((np.add.reduceat(m, first) / counts[:, None], np.maximum.reduceat(m, first)), 1)
        return 1 / (1 + np.exp(-np.clip((doc @ self.w3 + self.b3).astype(np.float64), -40, 40)))


def _start(share: float) -> Model:
    g = np.random.default_rng(SEED)
    f = lambda *s, by: (g.standard_normal(s) * by).astype(np.float32)
    embed = f(257, EMBED, by=0.5)
    embed[PAD] = 0
    return Model(embed, f(WIDTH1 * EMBED, FILTERS1, by=(2 / (WIDTH1 * EMBED)) ** 0.5 * 1.5), np.zeros(FILTERS1, np.float32), f(WIDTH2 * FILTERS1, FILTERS2, by=(2 / (WIDTH2 * FILTERS1)) ** 0.5),
                 np.zeros(FILTERS2, np.float32), f(2 * FILTERS2, by=0.1), np.array(np.log(share / (1 - share)), np.float32))


def train(rows: Sample) -> Model:
    """Fit all layers by Adam on weighted logistic loss. Without rows of both classes the score is the share of the label."""
    share = (rows.counts[1] + 0.5) / (sum(rows.counts) + 1)
    model = _start(share)
    y = np.array(rows.y, np.float32)
    if len(set(rows.y)) < 2:
        model.w3[:] = 0
        return model
    per_class = np.array([rows.counts[0] / (y == 0).sum(), rows.counts[1] / (y == 1).sum()])
    weight = per_class[y.astype(int)]
    weight /= weight.mean()
    names = ("embed", "w1", "b1", "w2", "b2", "w3", "b3")
    m1, m2, k = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    steps = EPOCHS * (len(y) // BATCH + 1)
    g = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        order = g.permutation(len(y))
        for at in range(0, len(y), BATCH):
            own = order[at : at + BATCH]
            k += 1
            grads = _gradients(model, [rows.texts[i] for i in own], y[own], weight[own])
            rate = RATE * min(1, k / 30) * (1 - k / (steps + 1))
            for n in names:
                d = grads[n]
                m1[n], m2[n] = 0.9 * m1[n] + 0.1 * d, 0.99 * m2[n] + 0.01 * d * d
                setattr(model, n, (getattr(model, n) - rate * (m1[n] / (1 - 0.9**k)) / (np.sqrt(m2[n] / (1 - 0.99**k)) + 1e-7)).astype(np.float32))
            model.embed[PAD] = 0
    return model


def _gradients(model: Model, texts: list[str], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    x, counts = chunks(texts)
    s: dict = {}
    m = model.features(x, s)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    owner = np.repeat(np.arange(len(counts)), counts)
    mean, most = np.add.reduceat(m, first) / counts[:, None], np.maximum.reduceat(m, first)
    doc = np.concatenate((mean, most), 1)
    p = 1 / (1 + np.exp(-np.clip(doc @ model.w3 + model.b3, -30, 30)))
    d = ((p - y) * weight / len(y)).astype(np.float32)
    ddoc = d[:, None] * model.w3
    dm = ddoc[owner, :FILTERS2] / counts[owner][:, None] + ddoc[owner, FILTERS2:] * (m == most[owner])
    dm = (dm * (m > 0)).astype(np.float32)
    dh2 = np.zeros((len(x), s["n2"], FILTERS2), np.float32)
    np.put_along_axis(dh2, s["top"][:, None, :], dm[:, None, :], 1)
    dh2 = dh2.reshape(-1, FILTERS2)
    live = np.flatnonzero(dh2.any(1))  # only the places of maxima carry gradient
    dlive = dh2[live]
    out = {"w3": doc.T @ d, "b3": d.sum(), "w2": s["c"][live].T @ dlive, "b2": dlive.sum(0)}
    dc = (dlive @ model.w2.T).reshape(-1, WIDTH2, FILTERS1)
    dh1 = np.zeros_like(s["h1"])
    row, pos = live // s["n2"], live % s["n2"] * STRIDE2
    for j in range(WIDTH2):
        np.add.at(dh1, (row, pos + j), dc[:, j])
    dh1 = (dh1 * (s["h1"] > 0)).reshape(-1, FILTERS1)
    live = np.flatnonzero(dh1.any(1))
    dlive = dh1[live]
    out |= {"w1": s["a"][live].T @ dlive, "b1": dlive.sum(0)}
    da = (dlive @ model.w1.T).reshape(-1, WIDTH1, EMBED)
    row, pos = live // s["n1"], live % s["n1"] * STRIDE1
    codes = np.stack([x[row, pos + j] for j in range(WIDTH1)], 1).ravel()
    da = da.reshape(-1, EMBED)
    out["embed"] = np.stack([np.bincount(codes, da[:, j], minlength=257) for j in range(EMBED)], 1).astype(np.float32)
    return out


def _probability(spark: SparkSession, model: Model, text_col: str = "text") -> Column:
    """The score of a column of texts as an Arrow-batched function."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # some 30 kB

    @F.pandas_udf("double")
    def run(texts):
        import pandas as pd

        return pd.Series(shared.value.probabilities(texts.tolist()) if len(texts) else np.zeros(0))

    return run(F.coalesce(F.col(text_col), F.lit("")))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. Null text counts as empty; a null id isn't held out. Other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    rows = rows.select("doc_id", "held_out", _probability(docs.sparkSession, model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more."""
    rows, own = renamed(docs)
    scored = rows.withColumn("score", _probability(docs.sparkSession, model, own["text"])).filter(F.col("score") >= threshold)
    return scored.select(*(F.col(v).alias(k) for k, v in own.items()))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(sample(docs, labels, "quality", MOST, MAX_CHARS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
