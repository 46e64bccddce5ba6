"""The bounded sample of labelled rows on which classifiers are trained."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .common import written

#: Rows whose crc32 of the id as text leaves 0 are held out.
FOLDS = 5


@dataclass(frozen=True)
class Sample:
    texts: list[str]
    y: list[int]
    #: Rows of class 0 and 1 among all labelled rows that may be learned from and fit.
    counts: tuple[int, int]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: tuple[int, int], max_chars: int, seed: str = "train") -> Sample:
    """At most ``most`` = (of class 0, of class 1) texts, by a hash of their ids, among the labelled ones of at most ``max_chars`` code points.

    Only rows outside the held-out fold. Null labels say nothing; an id with several labels has the largest; one with
    several texts gives the least of those that fit. So no more than sum(most) * max_chars code points reach the driver, and a longer
    text takes no place in the sample. ``counts`` are of the rows that fit.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")).filter(~held_out())
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).filter(F.length("text") <= max_chars)
    hashed = known.join(texts.select("doc_id").distinct(), "doc_id").withColumn("h", F.md5(F.concat(F.lit(seed), F.col("doc_id").cast("string"))))
    hashed = written(hashed, "labelled")
    n = dict(hashed.groupBy("y").count().collect())
    picks = None
    for y in (0, 1):
        some = hashed.filter(F.col("y") == y).orderBy("h", "doc_id").limit(most[y])
        picks = some if picks is None else picks.unionByName(some)
    rows = texts.join(F.broadcast(picks), "doc_id").groupBy("h", "y", "doc_id").agg(F.min("text").alias("text")).orderBy("h", "doc_id").toArrow()  # sum(most) ids
    return Sample(rows.column("text").to_pylist(), rows.column("y").to_pylist(), (n.get(0, 0), n.get(1, 0)))
