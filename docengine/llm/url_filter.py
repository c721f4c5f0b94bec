"""Operator 3, URL filters: a temporal list join.

Dated list entries (a domain is put on a list or taken off it) become validity intervals; every capture is evaluated
against the entries active when it was fetched. Domains are resolved once for each distinct host: the host and its parent
domains meet the entries by equality, and the host's intervals are gathered. Captures then meet their host's intervals in
one equi-join and the as-of test is a filter over a short array inside it, so no range join is needed. The hosts concerned
are counted: while they are few they are broadcast and captures don't move, so that a host of a third of all captures
is in no one's way; beyond that adaptive execution splits the join's large partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import saved

_BROADCAST_ROWS = 20_000  # hosts with their intervals

#: list, domain, day, on or off: the query's entries.
ENTRIES = [
    ("spam", "spam-farm.example.org", "2024-01-10", True),
    ("spam", "spam-farm.example.org", "2024-06-01", False),
    ("spam", "spam-farm.example.org", "2024-09-15", True),
    ("spam", "cheap-pills.example.com", "2024-02-01", True),
    ("spam", "blog.thertion.example.org", "2024-03-01", True),
    ("adult", "example.net", "2024-04-01", True),
    ("adult", "example.net", "2024-05-01", False),
    ("adult", "ththth.example.net", "2024-07-01", True),
    ("mirror", "example.org", "2024-10-01", True),
    ("mirror", "m.therou.example.com", "2024-01-01", True),
    ("allow", "ththen.example.com", "2024-01-01", True),
    ("allow", "cheap-pills.example.com", "2024-08-01", True),
    ("allow", "cheap-pills.example.com", "2024-11-01", False),
]


def host_of(url):
    """Lower-case host of a URL without credentials, port and last dot; empty if there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"\.$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """list, domain, since, until (exclusive; null: open) of entries(list, domain, at, active).

    Entries with nulls are ignored. Of entries of one list, domain and time, one that takes off wins.
    """
    rows = entries.select("list", F.lower("domain").alias("domain"), F.col("at").cast("timestamp").alias("at"), "active").dropna()
    rows = rows.groupBy("list", "domain", "at").agg(F.min("active").alias("active"))
    later = F.lead("at").over(Window.partitionBy("list", "domain").orderBy("at"))
    return rows.withColumn("until", later).where("active").select("list", "domain", F.col("at").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(page_id, url, fetched): page_id, host, fetched, lists (sorted, comma-joined), entry, verdict.

    lists are those with an active entry for the host or a parent domain at fetch time, entry is the longest such domain.
    verdict: allow if the allow list is among them, else block if any is, else pass. Captures with null url or time, or
    without host, pass with no lists. Repeated captures are each evaluated; an empty list lets all pass.
    """
    rows = captures.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), F.col("fetched").cast("timestamp").alias("fetched"))
    listed = intervals(entries)
    deepest = listed.agg(F.max(F.size(F.split("domain", r"\.")))).first()[0] or 1  # no longer domain is looked up
    labels = F.split("host", r"\.")
    depth = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.least(depth, F.lit(deepest))), lambda k: F.array_join(F.slice(labels, depth - k + 1, k), "."))
    hosts = rows.select("host").where("host <> ''").distinct().select("host", F.explode(domains).alias("domain"))
    known = hosts.join(listed, "domain").groupBy("host").agg(F.collect_list(F.struct("domain", "list", "since", "until")).alias("spans"))
    at = F.col("fetched")
    active = F.filter(F.coalesce("spans", F.array()), lambda s: (s["since"] <= at) & (s["until"].isNull() | (at < s["until"])))
    longest = F.array_max(F.transform("active", lambda s: F.struct(F.length(s["domain"]).alias("n"), s["domain"].alias("domain"))))["domain"]
    lists = F.array_sort(F.array_distinct(F.transform("active", lambda s: s["list"])))
    known = saved(known, "hosts")  # a row for each host that any entry concerns
    out = rows.join(F.broadcast(known) if known.count() <= _BROADCAST_ROWS else known, "host", "left").withColumn("active", active).withColumn("lists", lists)
    verdict = F.when(F.array_contains("lists", "allow"), "allow").when(F.size("lists") > 0, "block").otherwise("pass")
    return out.select("page_id", "host", "fetched", F.array_join("lists", ",").alias("lists"), F.coalesce(longest, F.lit("")).alias("entry"), verdict.alias("verdict"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; as the table has no fetch times, page_id spreads them over the hours of 2024."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    hours = F.expr("make_interval(0, 0, 0, 0, cast(pmod(page_id * 7919, 8784) as int), 0, 0)")
    captures = pages.select("page_id", "url", (F.lit("2024-01-01").cast("timestamp_ntz") + hours).alias("fetched"))
    entries = spark.createDataFrame(ENTRIES, "list string, domain string, at string, active boolean").withColumn("at", F.to_date("at"))
    return evaluate(captures, entries).withColumn("fetched", F.date_format("fetched", "yyyy-MM-dd HH:mm"))


_VALUES = ", ".join(f"('{a}', '{b}', TIMESTAMP '{c} 00:00:00', {str(d).lower()})" for a, b, c, d in ENTRIES)
ORACLE = f"""
WITH e AS (SELECT *, lead(since) OVER (PARTITION BY list, domain ORDER BY since) AS until FROM (VALUES {_VALUES}) t(list, domain, since, active)),
c AS (SELECT page_id, TIMESTAMP '2024-01-01' + to_hours(CAST((page_id * 7919) % 8784 AS INTEGER)) AS fetched,
  regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\\.$', '') AS host FROM pages),
m AS (SELECT page_id, list, domain FROM c JOIN e ON active AND (host = domain OR ends_with(host, '.' || domain)) AND since <= fetched AND (until IS NULL OR fetched < until)),
g AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, max_by(domain, length(domain)) AS entry FROM m GROUP BY page_id)
SELECT page_id, host, strftime(fetched, '%Y-%m-%d %H:%M') AS fetched, coalesce(lists, '') AS lists, coalesce(entry, '') AS entry,
  CASE WHEN list_contains(string_split(lists, ','), 'allow') THEN 'allow' WHEN lists IS NOT NULL THEN 'block' ELSE 'pass' END AS verdict
FROM c LEFT JOIN g USING (page_id)
"""
