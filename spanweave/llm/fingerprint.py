"""Operator 2, document fingerprints: closed syncmers with their places, compared by anchors that lie in the same order."""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import small_batches, table

#: Code points of a k-mer and of the inner substrings of which the least must lie at an edge.
K, S = 16, 10
#: Code points hashed at once.
BLOCK = 1 << 20
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_A = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _join(a: np.ndarray, b: np.ndarray, width: int, which: int) -> np.ndarray:
    """Hashes of substrings: those of ``a`` followed, ``width`` on, by those of ``b``."""
    n = len(b) - width
    return a[:n] * _A[which] + b[width:]


def _block(codes: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-mers that are taken; of a whole text without one, those of its least k-mer."""
    h1 = _mix(codes.astype(np.uint64) + np.uint64(1))
    h2 = _join(h1, h1, 1, 0)
    h4 = _join(h2, h2, 2, 1)
    h8 = _join(h4, h4, 4, 2)
    inner = _mix(_join(h8, h2, 8, 3))  # S code points
    outer = _mix(_join(h8, h8, 8, 4))  # K code points
    w = K - S + 1
    least, span = inner, 1
    while 2 * span <= w:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < w:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    at = np.flatnonzero((least == inner[: len(least)]) | (least == inner[w - 1 :]))
    if whole and not len(at):
        at = np.array([np.argmin(outer)])
    return at, (outer[at] >> np.uint64(32)).astype(np.uint32)


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and 32-bit hashes of the closed syncmers of a whole text.

    A k-mer is taken if the least hash of its inner substrings is that of its first or its last one: this depends on the
    k-mer alone, and any K - S k-mers in a row hold one that is taken. A text with fewer k-mers and none taken has its least
    k-mer as its one anchor; a text shorter than K has its own hash. So only an empty text has none. Half of a text under
    2 K code points holds no whole k-mer, so such a text has nothing in common with one that shares only that half.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if n < K:
        own = int.from_bytes(hashlib.blake2b(codes.tobytes(), digest_size=4).digest(), "little")
        return np.zeros(1, np.int64), np.array([own], np.uint32)
    parts = []
    for i in range(0, n - K + 1, BLOCK):
        at, h = _block(codes[i : i + BLOCK + K - 1], n - K < BLOCK)
        parts.append((at + i, h))
    return np.concatenate([p for p, _ in parts]), np.concatenate([h for _, h in parts])


def pack(found: tuple[np.ndarray, np.ndarray]) -> str:
    """A fingerprint as text: base64 of five bytes an anchor, its hash and its distance from the one before (under K - S)."""
    at, h = found
    out = np.empty((len(at), 5), np.uint8)
    out[:, :4] = h.astype(">u4").view(np.uint8).reshape(-1, 4)
    out[:, 4] = np.diff(at, prepend=0)
    return base64.b64encode(out.tobytes()).decode()


def unpack(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 5)
    return np.cumsum(raw[:, 4].astype(np.int64)), np.ascontiguousarray(raw[:, :4]).view(">u4").ravel().astype(np.uint32)


def _keys(h: np.ndarray) -> np.ndarray:
    """Each hash with how many equal ones come before it."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    count = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    out = np.empty(len(h), np.uint64)
    out[order] = (s.astype(np.uint64) << np.uint64(32)) | count.astype(np.uint64)
    return out


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], keys: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """Twice the longest run of common anchors in the same order, over all anchors of both; two empty texts are alike (1)."""
    n = len(a[1]) + len(b[1])
    if not n:
        return 1.0
    ka, kb = keys or (_keys(a[1]), _keys(b[1]))
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    there = ib[np.argsort(ia, kind="stable")]
    if (np.diff(there) > 0).all():
        return 2.0 * len(there) / n
    tails: list[int] = []
    for x in there.tolist():
        k = bisect.bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return 2.0 * len(tails) / n


def edited(text: str, follower: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of ``follower``."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


class _Doc:
    def __init__(self, doc_id: int | None, text: str):
        self.id, self.text, self.found = doc_id, text, anchors(text)
        self.keys = _keys(self.found[1])

    def row(self, follower: _Doc) -> tuple:
        changed = edited(self.text, follower.text)
        other = self.found if changed == self.text else anchors(changed)
        return (self.id, len(self.text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), pack(self.found), pack(other),
                likeness(self.found, other), likeness(self.found, follower.found, (self.keys, follower.keys)))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part come in order of their ids, and after them the first row of the part that follows."""
    before, part, done, out = None, None, False, []
    for batch in batches:
        for p, guest, doc_id, text in zip(*(batch.column(k).to_pylist() for k in ("part", "guest", "doc_id", "text")), strict=True):
            if p != part:
                before, part, done = None, p, False
            if done:
                continue
            now = _Doc(doc_id, text)
            if before is not None:
                out.append(before.row(now))
            before, done = now, guest
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)
            out = []


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every whole text, its edited text, and how near the edited and the next document come.

    The next document follows in ascending id (the first one after the last). Texts are dealt once, by ranges of ids,
    and each range also gets the first row of the next, so that no task sees more than its range and holds two texts at
    a time. Only range bounds and one id per range reach the driver.

    Null text counts as empty. Null ids come first; rows with equal ids follow in order of text length and text. A single
    row is its own next one. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    lowest = -(2**63)
    ids = docs.select(F.coalesce(F.col(id_col), F.lit(lowest)).cast("long").alias("id"))
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts)
    bounds = np.unique(np.array(cuts, np.float64)).astype(np.int64) if cuts else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def part_of(x):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, x.to_numpy(np.int64), side="right").astype(np.int32))

    firsts = sorted((r[0], r[1]) for r in ids.select(part_of("id").alias("part"), "id").groupBy("part").agg(F.min("id")).collect())
    host = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}  # the part before, or the last one
    keys, hosts = np.array(sorted(host), np.int64), np.array([host[k] for k in sorted(host)], np.int32)

    @F.pandas_udf("int")
    def guest_of(x):
        import pandas as pd

        v = x.to_numpy(np.int64)
        at = np.searchsorted(keys, v).clip(max=max(0, len(keys) - 1))
        return pd.Series(np.where(keys[at] == v, hosts[at], -1).astype(np.int32)) if len(keys) else pd.Series(np.full(len(v), -1, np.int32))

    rows = docs.select(F.coalesce(F.col(id_col), F.lit(lowest)).cast("long").alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", part_of("key").alias("_part"), guest_of("key").alias("_host"))
    own = F.struct(F.col("_part").alias("part"), F.lit(False).alias("guest"))
    there = F.struct(F.col("_host").alias("part"), F.lit(True).alias("guest"))
    rows = rows.select("key", "doc_id", "text", F.explode(F.when(F.col("_host") >= 0, F.array(own, there)).otherwise(F.array(own))).alias("_to")).select("_to.part", "_to.guest", "key", "doc_id", "text")
    dealt = rows.repartition(parts, "part").sortWithinPartitions("part", "guest", "key", F.length("text"), "text")
    return dealt.select("part", "guest", "doc_id", "text").mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
