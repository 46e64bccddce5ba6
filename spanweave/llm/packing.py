"""Operator 3, packing: hierarchical multi-length packing of token sequences."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import small_batches, table
from .tokenize import vocabulary, words

#: Context sizes, shortest first; a window of the longest is the padded size.
TIERS = (256, 512, 1024, 2048)
END = 1
#: Documents packed together, tokens of a step group, and tokens that are in memory at once beside those of one document.
BIN_DOCS, STEP_TOKENS, RUN_TOKENS = 1024, 1 << 16, 1 << 23


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (tier, pieces (document, start, length)) that hold every token of documents of these lengths once.

    Whole windows of the longest tier stand by themselves. What is left of each document goes to the shortest tier that
    takes it. From the longest down, each opens a window of its tier, and the gap is filled with the largest remainders
    of shorter tiers that fit, then by cutting the shortest one that doesn't. All windows are full but the last of all.
    """
    top, out, pool = tiers[-1], [], []
    for doc, n in enumerate(lengths):
        whole = n - n % top
        out += [(top, [(doc, s, top)]) for s in range(0, whole, top)]
        if n > whole:
            pool.append((n - whole, doc, whole))
    pool.sort()
    while pool:
        n, doc, start = pool.pop()
        tier = next(t for t in tiers if t >= n)
        pieces, gap = [(doc, start, n)], tier - n
        while gap and pool:
            if k := bisect_right(pool, (gap, 1 << 62, 0)):
                n, doc, start = pool.pop(k - 1)
            else:
                n, doc, start = pool.pop(0)
                insort(pool, (n - gap, doc, start + gap))
                n = gap
            pieces.append((doc, start, n))
            gap -= n
        out.append((tier, pieces))
    return out


def step_groups(sequences: list[tuple[int, list[tuple[int, int, int]]]], tokens: int = STEP_TOKENS) -> list[int]:
    """A step group for each sequence, so that groups differ little in attention cost (the sum of squared piece lengths)."""
    size = lambda s: sum(p[2] for p in s[1])
    n = max(1, round(sum(map(size, sequences)) / tokens))
    cost = [sum(p[2] ** 2 for p in s[1]) for s in sequences]
    out, load = [0] * len(sequences), [(0, g) for g in range(n)]
    for k in sorted(range(len(sequences)), key=lambda k: (-cost[k], k)):
        c, g = heapq.heappop(load)
        out[k] = g
        heapq.heappush(load, (c + cost[k], g))
    return out


_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("tier", pa.int32()), ("step_group", pa.int64())])
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def _bins(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = words(path)
        now, size, sequences, groups, held = None, 0, 0, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal size, sequences, groups
            made = pack([len(t) for _, t in held])
            steps, rows = step_groups(made), []
            for k, ((tier, pieces), g) in enumerate(zip(made, steps, strict=True)):
                offset = 0
                for doc, start, n in pieces:
                    doc_id, ids = held[doc]
                    rows.append((doc_id, start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), len(ids), (now << 32) + sequences + k, offset, tier, (now << 20) + groups + g))
                    offset += n
            sequences, groups = sequences + len(made), groups + max(steps) + 1
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

        for batch in batches:
            ids = coder.encode(batch.column("text").to_pylist())
            for b, doc_id, t in zip(batch.column("bin").to_pylist(), batch.column("doc_id").to_pylist(), ids, strict=True):
                if held and (b != now or len(held) >= 4 * BIN_DOCS or size >= RUN_TOKENS):
                    yield flush()
                if b != now:
                    now, sequences, groups = b, 0, 0
                held.append((doc_id, np.append(t, np.uint16(END))))
                size += len(t) + 1
        if held:
            yield flush()

    return run


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    Documents are dealt by a hash of their id and text to bins of about BIN_DOCS, whose number follows the row count; a bin is
    tokenized, packed (:func:`pack`) and balanced (:func:`step_groups`) by one task, and pads one window at most. A bin
    with many more rows, as from repeated rows, or with very long texts is packed in runs of 4 * BIN_DOCS documents or
    RUN_TOKENS tokens, each of which pads one window.

    Null or empty text: the end id alone. Null and repeated ids are documents of their own. The result doesn't depend on
    the partitioning of ``docs``. An empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    bins = max(1, -(-docs.count() // BIN_DOCS))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), text), F.lit(bins)).cast("long").alias("bin"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    dealt = rows.repartition("bin").sortWithinPartitions("bin", "doc_id", F.length("text"), "text")
    return dealt.mapInArrow(_bins(path or vocabulary()), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
