"""Category feeds and change-log pages landed as one payload per row.

Each reader returns every payload's verdict beside its rows: a payload that
fails is never the same as a payload without rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import normalise as N

_TEXT = "STRUCT<_VALUE: STRING>"
_ENTRY = (
    f"STRUCT<title: {_TEXT}, link: ARRAY<STRUCT<_VALUE: STRING, _href: STRING>>, guid: {_TEXT}, id: STRING, "
    f"description: {_TEXT}, summary: {_TEXT}, pubDate: STRING, published: STRING, updated: STRING>"
)
FEED_SHAPE = (
    f"STRUCT<channel: STRUCT<item: ARRAY<{_ENTRY}>>, item: ARRAY<{_ENTRY}>, entry: ARRAY<{_ENTRY}>, _corrupt_record: STRING>"
)
XML_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def _filled(column: Column) -> Column:
    value = F.trim(column)
    return F.when(value != "", value)


def parsed_feeds(payloads: DataFrame) -> DataFrame:
    """``feed_key, category_id, checked_at`` with ``entries`` and ``feed_status``."""
    x = F.from_xml("payload", FEED_SHAPE, XML_OPTIONS)
    none = F.array().cast(f"ARRAY<{_ENTRY}>")
    parsed = payloads.withColumn("_x", x)
    broken = F.col("_x").isNull() | F.col("_x._corrupt_record").isNotNull()
    entries = F.concat(
        F.coalesce("_x.channel.item", none), F.coalesce("_x.item", none), F.coalesce("_x.entry", none)
    )
    return parsed.select(
        "feed_key", "category_id", "checked_at",
        F.when(broken, none).otherwise(entries).alias("entries"),
        F.when(broken, "failed").otherwise("parsed").alias("feed_status"),
    )


def feed_entries(payloads: DataFrame) -> DataFrame:
    """RSS or Atom payloads -> entries; title and link are required, dates stay text.

    Every payload keeps at least one row: a failed or empty one has NULL entry
    columns and its ``feed_status``.
    """
    one = parsed_feeds(payloads).select(
        "feed_key", "category_id", "checked_at", "feed_status", F.posexplode_outer("entries").alias("position", "e")
    )
    direct = F.try_element_at(F.filter(F.transform("e.link", lambda v: _filled(v["_VALUE"])), lambda v: v.isNotNull()), F.lit(1))
    href = F.try_element_at(F.filter(F.transform("e.link", lambda v: _filled(v["_href"])), lambda v: v.isNotNull()), F.lit(1))
    link = F.coalesce(direct, href)
    entries = one.select(
        "feed_key", "category_id", "checked_at", "feed_status", "position",
        F.coalesce(_filled(F.col("e.guid._VALUE")), _filled(F.col("e.id")), link).alias("source_id"),
        _filled(F.col("e.title._VALUE")).alias("title"), link.alias("link"),
        F.coalesce(_filled(F.col("e.description._VALUE")), _filled(F.col("e.summary._VALUE"))).alias("description"),
        F.coalesce(_filled(F.col("e.pubDate")), _filled(F.col("e.published")), _filled(F.col("e.updated"))).alias("published_text"),
    )
    usable = F.col("position").isNull() | (F.col("title").isNotNull() & F.col("link").isNotNull())
    return entries.filter(usable)


def entries_with_hints(entries: DataFrame, hosts: list[str], canonical_host: str) -> DataFrame:
    """Parsed entries -> the columns that ``merge_feeds`` takes."""
    hinted = N.extract_hints(entries.filter("title IS NOT NULL"))
    return (
        N.canonicalise_urls(hinted, "link", hosts, canonical_host)
        .withColumn("published_at", N.feed_date(F.col("published_text")))
    )


# Dublin Core elements, and error codes that mean an empty result.
DC_ELEMENTS = [
    "contributor", "coverage", "creator", "date", "description", "format", "identifier", "language",
    "publisher", "relation", "rights", "source", "subject", "title", "type",
]
EMPTY_CODES = ["noRecordsMatch"]
_DC = ", ".join(f"{name}: ARRAY<STRING>" for name in DC_ELEMENTS)
_RECORD = (
    "STRUCT<header: STRUCT<_status: STRING, identifier: STRING, datestamp: STRING>, "
    f"metadata: STRUCT<dc: STRUCT<{_DC}>>>"
)
PAGE_SHAPE = (
    "STRUCT<responseDate: STRING, error: STRUCT<_VALUE: STRING, _code: STRING>, "
    f"ListRecords: STRUCT<record: ARRAY<{_RECORD}>, "
    "resumptionToken: STRUCT<_VALUE: STRING, _cursor: STRING, _completeListSize: STRING, _expirationDate: STRING>>, "
    "_corrupt_record: STRING>"
)


def change_pages(pages: DataFrame) -> DataFrame:
    """One row per page: status, error code, token, cursor, list size, record count."""
    parsed = pages.withColumn("_x", F.from_xml("payload", PAGE_SHAPE, XML_OPTIONS))
    broken = F.col("_x").isNull() | F.col("_x._corrupt_record").isNotNull()
    code = F.col("_x.error._code")
    status = (
        F.when(broken, "failed").when(code.isin(EMPTY_CODES), "empty").when(F.col("_x.error").isNotNull(), "protocol_error")
        .otherwise("parsed")
    )
    token = F.col("_x.ListRecords.resumptionToken")
    return parsed.select(
        "request_id", "page_no", status.alias("page_status"), code.alias("error_code"),
        _filled(token["_VALUE"]).alias("token"), F.try_to_number(token["_cursor"], F.lit("999999999999")).cast("bigint").alias("cursor"),
        F.try_to_number(token["_completeListSize"], F.lit("999999999999")).cast("bigint").alias("list_size"),
        F.col("_x.ListRecords.record").alias("records"),
    )


def change_events(pages: DataFrame) -> DataFrame:
    """Change-log pages -> events with a deleted flag and Dublin Core fields as a map.

    Headers without identifier or date stamp are not events.
    """
    record = change_pages(pages).filter("page_status = 'parsed'").select("request_id", "page_no", F.posexplode("records").alias("position", "r"))
    pairs = F.array(*[
        F.struct(F.lit(name).alias("key"), F.transform(F.col(f"r.metadata.dc.{name}"), lambda v: F.trim(v)).alias("value")) for name in DC_ELEMENTS
    ])
    fields = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    identifiers = F.coalesce(F.col("r.metadata.dc.identifier"), F.array().cast("array<string>"))
    return record.select(
        "request_id", "page_no", "position", _filled(F.col("r.header.identifier")).alias("identifier"),
        _filled(F.col("r.header.datestamp")).alias("datestamp"),
        (F.coalesce(F.col("r.header._status"), F.lit("")) == "deleted").alias("deleted"), fields.alias("fields"),
        N.first_record_key(F.col("r.header.identifier"), identifiers).alias("record_key"),
    ).filter("identifier IS NOT NULL AND datestamp IS NOT NULL")


def page_sequence_check(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Whether each request's result set arrived whole.

    ``pages``: ``request_id, page_no, ok, declared_total``; ``items``:
    ``request_id, item_id``.  ``success`` needs every page, one declared total
    that equals the items, and no repeated item; ``failed`` means no page came.
    """
    p = pages.groupBy("request_id").agg(
        F.count_if("ok").alias("pages_ok"), F.count_if(~F.col("ok")).alias("pages_failed"),
        F.count_distinct(F.when(F.col("ok"), F.col("page_no"))).alias("_pages"),
        F.max(F.when(F.col("ok"), F.col("page_no"))).alias("_last"),
        F.min("declared_total").alias("_low"), F.max("declared_total").alias("_high"),
    )
    i = items.groupBy("request_id", "item_id").agg(F.count("*").alias("_n")).groupBy("request_id").agg(
        F.sum("_n").alias("n_items"), F.count_if(F.col("_n") > 1).alias("repeated"),
    )
    zero = F.lit(0)
    joined = p.join(i, "request_id", "left").withColumn("n_items", F.coalesce("n_items", zero)).withColumn(
        "repeated", F.coalesce("repeated", zero)
    )
    reasons = F.array_compact(F.array(
        F.when(F.col("pages_failed") > 0, "page_failed"),
        F.when(F.col("_pages") != F.col("_last"), "page_missing"),
        F.when(F.col("_low") != F.col("_high"), "total_changed"),
        F.when(F.col("_low").isNull(), "total_unknown"),
        F.when(F.col("_high") != F.col("n_items"), "total_differs"),
        F.when(F.col("repeated") > 0, "item_repeated"),
    ))
    status = F.when(F.col("pages_ok") == 0, "failed").when(F.size("reasons") == 0, "success").otherwise("partial")
    return joined.withColumn("reasons", reasons).select("request_id", "n_items", status.alias("status"), "reasons")


def replay_check(saved: DataFrame, feeds: DataFrame, window_end) -> DataFrame:
    """Per feed key, whether a saved inventory covers exactly the configured feeds.

    ``saved``: ``feed_key, category_id, checked_at``; ``feeds``: ``feed_key, category_id``.
    """
    from shelfmark.operators.gates import instant

    held = saved.groupBy("feed_key").agg(
        F.count("*").alias("_n"), F.min("category_id").alias("_category"),
        F.min("checked_at").alias("_low"), F.max("checked_at").alias("_high"),
    )
    wanted = feeds.select("feed_key", F.col("category_id").alias("_wanted"))
    end = instant(window_end)
    state = (
        F.when(F.col("_n").isNull(), "missing").when(F.col("_wanted").isNull(), "extra").when(F.col("_n") > 1, "duplicate")
        .when(F.col("_category") != F.col("_wanted"), "category_differs")
        .when((F.col("_low") != end) | (F.col("_high") != end), "other_window").otherwise("usable")
    )
    return held.join(wanted, "feed_key", "full_outer").select("feed_key", state.alias("state"))


def replay_snapshot(saved: DataFrame, feeds: DataFrame, window_end) -> DataFrame:
    """The saved rows if every feed is usable, else none: one mismatch refuses them all."""
    flawed = replay_check(saved, feeds, window_end).filter("state <> 'usable'").agg((F.count("*") == 0).alias("_all"))
    verdict = F.broadcast(flawed.filter("_all").select(F.lit(1).alias("_one")))
    return saved.withColumn("_one", F.lit(1)).join(verdict, "_one", "left_semi").drop("_one")
