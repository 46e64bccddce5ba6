"""Operator 10, URL filters: a temporal list join. Dated list entries become validity intervals; captures meet those active when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import renamed, small, table, written

#: Validity intervals are cut at multiples of so many days, so that a join key is an entry and a span of time.
SPAN_DAYS = 32
DAY0 = "2020-01-01"


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and final dot; an IPv6 address without its brackets; '' where there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?\[?((?<=\[)[^/?#\]]*|[^/?#:]*)", 1), r"\.$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """Entries (list, key, action ``add`` or ``remove``, day) as intervals (list, key, since, until) in which the key is listed.

    ``day`` counts days; an interval holds its first day, not its last. The last entry of a key on a day decides, where
    ``add`` comes after ``remove``. Entries with a null list, key or day say nothing. ``until`` is null while open.
    """
    clean = entries.filter(F.col("list").isNotNull() & F.col("key").isNotNull() & F.col("day").isNotNull())
    last = clean.groupBy("list", "key", "day").agg(F.min("action").alias("action"))  # 'add' < 'remove'
    turn = W.partitionBy("list", "key").orderBy("day")
    spans = last.withColumn("until", F.lead("day").over(turn)).withColumn("was", F.lag("action").over(turn))
    # a repeated add doesn't end what it repeats
    runs = spans.filter(F.col("was").isNull() | (F.col("was") != F.col("action"))).select("list", "key", F.col("day").alias("since"), "action")
    return runs.withColumn("until", F.lead("since").over(W.partitionBy("list", "key").orderBy("since"))).filter("action = 'add'").select("list", "key", "since", "until")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetch_day") -> DataFrame:
    """``captures`` with host, blocked, lists (sorted names of the lists that held the host or a parent domain on the day of fetching) and listed_since (the earliest start of those intervals).

    An entry ``example.com`` covers ``example.com`` and every host below it. Only the distinct hosts and days are joined
    with the entries, on entry and span of days together: a hot host costs one row per day, and an entry that was added
    and removed often meets only the intervals near the day. A list of few intervals is broadcast; with a longer one the
    join is a shuffle whose hot keys (such as ``com``) Spark splits.

    Null or malformed URL: host '' and not blocked. Null day: not blocked. Repeated captures stay as they are. Empty
    tables give no captures, or none blocked. Columns of these names in ``captures`` are replaced.
    """
    new = ("host", "blocked", "lists", "listed_since")
    rows, own = renamed(captures)
    rows = rows.withColumns({"host": host_of(F.col(own[url_col])), "day": F.col(own[day_col])})
    seen = rows.select("host", F.col("day").alias("_day")).filter((F.col("host") != "") & F.col("_day").isNotNull()).distinct()
    parts = F.split("host", r"\.")
    keys = seen.select("host", "_day", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("key"))
    keys = keys.withColumn("span", F.floor(F.col("_day") / SPAN_DAYS))
    last = seen.agg(F.max("_day")).first()[0] or 0
    held = intervals(entries.withColumn("key", F.lower("key"))).filter(F.col("since") <= last)
    held = held.withColumn("span", F.explode(F.sequence(F.floor(F.col("since") / SPAN_DAYS), F.floor(F.least(F.coalesce(F.col("until") - 1, F.lit(last)), F.lit(last)) / SPAN_DAYS))))
    met = keys.join(small(written(held, "url-intervals")), ["key", "span"]).filter((F.col("since") <= F.col("_day")) & (F.col("until").isNull() | (F.col("_day") < F.col("until"))))
    verdict = met.groupBy(F.col("host").alias("_host"), "_day").agg(F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.min("since").alias("listed_since"))
    out = rows.join(verdict, (F.col("host") == F.col("_host")) & (F.col("day") == F.col("_day")), "left")
    return out.select(*(F.col(v).alias(k) for k, v in own.items() if k not in new), "host", F.col("lists").isNotNull().alias("blocked"), F.coalesce("lists", F.lit("")).alias("lists"), "listed_since")


def _number(of: Column, salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), of)), 1, 7), 16, 10).cast("long")


def sample_entries(hosts: DataFrame) -> DataFrame:
    """Dated entries for the hosts of a table without lists: of each third host an ``adult`` entry that is removed and
    added again, of each fifth host's parent domain a ``spam`` entry that stays or is removed, all dated by hash."""
    host = hosts.select(F.col("host").alias("key")).distinct().filter("key != ''")
    n = _number(F.col("key"), "a")
    first = host.filter(n % 3 == 0).withColumn("day", n % 200)
    adult = first.select(F.lit("adult").alias("list"), "key", F.explode(F.array(*(F.struct(F.lit(a).alias("action"), (F.col("day") + d).alias("day")) for a, d in (("add", 0), ("remove", 70), ("add", 130))))).alias("e")).select("list", "key", "e.action", "e.day")
    parent = host.select(F.regexp_replace("key", r"^[^.]*\.", "").alias("key")).filter("key like '%.%.%'").distinct()
    m = _number(F.col("key"), "b")
    base = parent.filter(m % 5 == 0).withColumn("day", m % 300)
    spam = base.select(F.lit("spam").alias("list"), "key", F.lit("add").alias("action"), "day").unionByName(
        base.filter(m % 2 == 0).select(F.lit("spam").alias("list"), "key", F.lit("remove").alias("action"), (F.col("day") + 45).alias("day")))
    return adult.unionByName(spam)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day derived from its id (the table has none), against entries derived from all hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_day", _number(F.coalesce(F.col("page_id").cast("string"), F.lit("")), "p") % 365)
    entries = sample_entries(pages.select(host_of(F.col("url")).alias("host")))
    out = filter_urls(captures, entries)
    dated = lambda day: F.date_format(F.date_add(F.to_date(F.lit(DAY0)), day.cast("int")), "yyyy-MM-dd")
    return out.select("page_id", "url", dated(F.col("fetch_day")).alias("fetched"), "host", "blocked", "lists", F.coalesce(dated(F.col("listed_since")), F.lit("")).alias("listed_since"))


ORACLE = r"""WITH c AS (SELECT page_id, url, ('0x' || substr(md5('p' || coalesce(page_id::VARCHAR, '')), 1, 7))::BIGINT % 365 AS day,
  rtrim(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '.') AS host FROM pages),
h AS (SELECT DISTINCT host AS key FROM c WHERE host <> ''),
a AS (SELECT key, ('0x' || substr(md5('a' || key), 1, 7))::BIGINT AS n FROM h),
p AS (SELECT DISTINCT regexp_replace(key, '^[^.]*\.', '') AS key FROM h),
b AS (SELECT key, ('0x' || substr(md5('b' || key), 1, 7))::BIGINT AS n FROM p WHERE key LIKE '%.%.%'),
e AS (SELECT 'adult' AS list, key, n % 200 AS since, n % 200 + 70 AS until FROM a WHERE n % 3 = 0
  UNION ALL SELECT 'adult', key, n % 200 + 130, NULL FROM a WHERE n % 3 = 0
  UNION ALL SELECT 'spam', key, n % 300, CASE WHEN n % 2 = 0 THEN n % 300 + 45 END FROM b WHERE n % 5 = 0),
v AS (SELECT host, day, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, min(since) AS listed_since
  FROM (SELECT DISTINCT host, day FROM c) x JOIN e ON (host = key OR ends_with(host, '.' || key)) AND since <= day AND (until IS NULL OR day < until) GROUP BY ALL)
SELECT page_id, url, strftime(DATE '2020-01-01' + c.day::INTEGER, '%Y-%m-%d') AS fetched, c.host AS host, lists IS NOT NULL AS blocked, coalesce(lists, '') AS lists,
  coalesce(strftime(DATE '2020-01-01' + listed_since::INTEGER, '%Y-%m-%d'), '') AS listed_since
FROM c LEFT JOIN v ON c.host = v.host AND c.day = v.day"""
