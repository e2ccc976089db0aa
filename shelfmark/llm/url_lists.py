"""URL filters whose lists change over time: a temporal list join in DataFrame operations.

A list is a log of dated entries ``(key, verdict, category, entry_date, change)``, where
``change`` is ``add`` or ``remove`` and a key is a host suffix of at least two labels or a
host with leading path segments.  Consecutive entries of one ``(key, verdict, category)``
become validity intervals ``[valid_from, valid_to)``; an addition and a removal of one day
leave it active.  A capture is judged by the entries active when it was fetched: the
longest matching key decides, and ``allow`` beats ``block`` on the same key.

Both sides carry a month, so a capture meets only intervals of its month.  Captures of one
URL and day are judged once, however many there are.  URLs are cut into as many keys as
the deepest key of the list needs, so long URLs cost nothing extra and none is missed.

URLs that are null or hold no host, and captures without a date, pass.  Entries without
key or date and unknown changes or verdicts take no part; repeated entries count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """The path without query and fragment, without its first slash."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``(key, verdict, category, valid_from, valid_to)``; open intervals end at null."""
    by = ["key", "verdict", "category"]
    days = (
        entries.where("key IS NOT NULL AND entry_date IS NOT NULL AND change IN ('add', 'remove') AND verdict IN ('block', 'allow')")
        .groupBy(*by, "entry_date").agg(F.max(F.col("change") == "add").alias("active"))
    )
    order = W.partitionBy(*by).orderBy("entry_date")
    return (
        days.withColumn("valid_to", F.lead("entry_date").over(order)).where("active")
        .select(*by, F.col("entry_date").alias("valid_from"), "valid_to")
    )


def month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def url_keys(host: Column, path: Column, labels: int, segments: int) -> Column:
    """Host suffixes of 2 to ``labels`` labels and the host with 1 to ``segments`` path segments."""
    parts, steps = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda s: s != "")
    n_hosts, n_paths = F.least(F.size(parts), F.lit(labels)), F.least(F.size(steps), F.lit(segments))
    none = F.array().cast("array<string>")
    hosts = F.when(n_hosts < 2, none).otherwise(
        F.transform(F.sequence(F.lit(2), F.greatest(n_hosts, F.lit(2))), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    )
    paths = F.when(n_paths < 1, none).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n_paths, F.lit(1))), lambda n: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, n), "/")))
    )
    return F.array_distinct(F.concat(hosts, paths))


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures(page_id, url, fetched_on)`` with ``host``, ``verdict``, ``matched_key`` and ``categories``."""
    intervals = validity_intervals(entries)
    # two numbers, however long the list
    depth = intervals.agg(
        F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))).alias("labels"),
        F.max(F.size(F.split("key", "/")) - 1).alias("segments"),
    ).first()
    asked = captures.where("url IS NOT NULL AND fetched_on IS NOT NULL").select("url", "fetched_on").distinct()
    last = asked.agg(F.max("fetched_on")).first()[0]
    host = host_of(F.col("url"))
    keyed = asked.withColumn("host", host).where("host IS NOT NULL").select(
        "url", "fetched_on", month(F.col("fetched_on")).alias("month"),
        F.explode(url_keys(F.col("host"), path_of(F.col("url")), max(depth["labels"] or 0, 2), depth["segments"] or 0)).alias("key"),
    )
    until = F.coalesce(F.least(F.date_sub("valid_to", 1), F.lit(last)), F.lit(last))
    monthly = intervals.where(F.col("valid_from") <= F.lit(last)).withColumn(
        "month", F.explode(F.sequence(month(F.col("valid_from")), F.greatest(month(until), month(F.col("valid_from")))))
    )
    hits = keyed.join(monthly, ["key", "month"]).where("fetched_on >= valid_from AND (valid_to IS NULL OR fetched_on < valid_to)")
    per_key = hits.groupBy("url", "fetched_on", "key").agg(
        F.min("verdict").alias("verdict"), F.array_sort(F.collect_set("category")).alias("categories")
    )
    best = per_key.groupBy("url", "fetched_on").agg(
        F.max_by(F.struct("key", "verdict", "categories"), F.struct(F.length("key").alias("n"), F.col("key").alias("k"))).alias("best")
    )
    return captures.join(best, ["url", "fetched_on"], "left").select(
        "page_id", host.alias("host"), "fetched_on", F.coalesce("best.verdict", F.lit("pass")).alias("verdict"),
        F.col("best.key").alias("matched_key"), F.array_join("best.categories", ",").alias("categories"),
    )


def derived_captures(pages: DataFrame, first_day: str = "2024-01-01", days: int = 366) -> DataFrame:
    """Every page as a capture; the table holds no dates, so its id gives the day."""
    return pages.select(
        "page_id", "url", F.expr(f"date_add(DATE '{first_day}', CAST(pmod(page_id, {days}) AS INT))").alias("fetched_on")
    )


def derived_entries(pages: DataFrame, first_day: str = "2024-01-01") -> DataFrame:
    """A dated list over the hosts of ``pages``: blocks that come, go and return, whole domains
    for a month, and exceptions for one section of a host."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    hosts = hosts.withColumn("n", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long"))
    domains = hosts.select(F.substring_index("host", ".", -2).alias("host")).where("host LIKE '%.%'").distinct()
    domains = domains.withColumn("n", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long"))

    def entry(rows: DataFrame, where: str, key: str, verdict: str, category: str, day: str, change: str) -> DataFrame:
        return rows.where(where).selectExpr(
            f"{key} AS key", f"'{verdict}' AS verdict", f"{category} AS category",
            f"date_add(DATE '{first_day}', CAST({day} AS INT)) AS entry_date", f"'{change}' AS change",
        )

    kind = "element_at(array('ads', 'adult', 'malware', 'spam'), CAST(n % 4 + 1 AS INT))"
    parts = [
        entry(hosts, "n % 3 = 0", "host", "block", kind, "n % 200", "add"),
        entry(hosts, "n % 6 = 0", "host", "block", kind, "n % 200 + 40", "remove"),
        entry(hosts, "n % 12 = 0", "host", "block", kind, "n % 200 + 90", "add"),
        entry(hosts, "n % 5 = 0", "concat(host, '/en')", "allow", "'exception'", "n % 150", "add"),
        entry(domains, "n % 2 = 0", "host", "block", "'parked'", "100", "add"),
        entry(domains, "n % 2 = 0", "host", "block", "'parked'", "131", "remove"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
