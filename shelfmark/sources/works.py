"""Bibliography payloads in JSON -> one table of works, and journal records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import normalise as N


def _text(column: Column) -> Column:
    value = F.trim(column)
    return F.when(value != "", value)


def _first(column: Column) -> Column:
    return _text(F.try_element_at(column, F.lit(1)))


def _raw_type(raw: Column, text: Column) -> Column:
    """Missing stays NULL, a blank or non-text label becomes ``unrecognized``."""
    return F.when(raw.isNull() | (raw == "null"), F.lit(None)).otherwise(F.coalesce(_text(text), F.lit("unrecognized")))


_PARTS = "STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>"
CROSSREF_SHAPE = (
    "STRUCT<DOI: STRING, title: ARRAY<STRING>, `container-title`: ARRAY<STRING>, type: STRING, "
    "author: ARRAY<STRUCT<given: STRING, family: STRING>>, "
    f"`published-online`: {_PARTS}, `published-print`: {_PARTS}, published: {_PARTS}>"
)


def _dated(parts: Column) -> tuple[Column, Column]:
    """Text and precision of one date-parts list."""
    first = F.try_element_at(parts, F.lit(1))
    year, month, day = (F.try_element_at(first, F.lit(n)) for n in (1, 2, 3))
    valid_day = F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("y-M-d")).isNotNull()
    value = (
        F.when((F.size(first) >= 3) & valid_day, F.format_string("%04d-%02d-%02d", year, month, day))
        .when((F.size(first) == 2) & month.between(1, 12), F.format_string("%04d-%02d", year, month))
        .when((F.size(first) == 1) & year.isNotNull(), F.format_string("%04d", year))
    )
    precision = F.when(value.isNull(), None).when(F.length(value) > 7, "day").when(F.length(value) > 4, "month").otherwise("year")
    return value, precision


def works_from_crossref(raw: DataFrame) -> DataFrame:
    """JSON works -> rows; online beats print beats generic dates, and a generic date
    proves no event.  Rows without DOI or title are not works."""
    w = raw.withColumn("w", F.from_json("payload", CROSSREF_SHAPE))
    online, online_p = _dated(F.col("w.published-online.date-parts"))
    printed, printed_p = _dated(F.col("w.published-print.date-parts"))
    generic, generic_p = _dated(F.col("w.published.date-parts"))
    names = F.filter(
        F.transform("w.author", lambda a: F.trim(F.concat_ws(" ", _text(a["given"]), _text(a["family"])))), lambda n: n != ""
    )
    doi = N.doi_norm(F.col("w.DOI"))
    return w.select(
        F.lit("crossref").alias("provider"), doi.alias("work_key"), doi.alias("doi"), _first(F.col("w.title")).alias("title"),
        F.coalesce(names, F.array().cast("array<string>")).alias("authors"),
        _first(F.col("w.container-title")).alias("container_title"),
        _raw_type(F.get_json_object("payload", "$.type"), F.col("w.type")).alias("raw_type"),
        F.coalesce(online, printed, generic).alias("value"),
        F.when(online.isNotNull(), online_p).when(printed.isNotNull(), printed_p).otherwise(generic_p).alias("precision"),
        F.when(online.isNotNull(), "recently_published_online").when(printed.isNotNull(), "recently_assigned_to_issue").alias("event"),
        F.concat(F.lit("https://doi.org/"), doi).alias("stable_url"), F.lit(None).cast("bigint").alias("citations"),
    ).filter("doi IS NOT NULL AND title IS NOT NULL")


OPENALEX_SHAPE = (
    "STRUCT<id: STRING, doi: STRING, title: STRING, type: STRING, publication_date: STRING, "
    "authorships: ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>, primary_location: STRUCT<landing_page_url: STRING>>"
)


def works_from_openalex(raw: DataFrame) -> DataFrame:
    """JSON works -> rows; a missing or malformed citation count is unknown, not zero."""
    w = raw.withColumn("w", F.from_json("payload", OPENALEX_SHAPE))
    names = F.filter(F.transform("w.authorships", lambda a: F.trim(a["author"]["display_name"])), lambda n: n != "")
    count = F.get_json_object("payload", "$.cited_by_count")
    quoted = F.col("payload").rlike(r'"cited_by_count"\s*:\s*"')  # a quoted number is text
    day = F.when(
        F.col("w.publication_date").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
        & F.try_to_timestamp("w.publication_date", F.lit("yyyy-MM-dd")).isNotNull(), F.col("w.publication_date")
    )
    return w.select(
        F.lit("openalex").alias("provider"), F.col("w.id").alias("work_key"), N.doi_norm(F.col("w.doi")).alias("doi"),
        _text(F.col("w.title")).alias("title"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"),
        F.lit(None).cast("string").alias("container_title"),
        _raw_type(F.get_json_object("payload", "$.type"), F.col("w.type")).alias("raw_type"),
        day.alias("value"), F.when(day.isNotNull(), "day").alias("precision"),
        F.when(day.isNotNull(), "recently_published").alias("event"),
        F.coalesce("w.primary_location.landing_page_url", "w.id").alias("stable_url"),
        F.when(~quoted & count.rlike("^[0-9]{1,18}$"), count.cast("bigint")).alias("citations"),
    ).filter("work_key IS NOT NULL AND title IS NOT NULL")


JOURNAL_SHAPE = (
    "STRUCT<num_found: STRING, numFound: STRING, documents: ARRAY<STRUCT<"
    "resource_type: STRING, resourceType: STRING, uid: STRING, fields: MAP<STRING, STRING>>>>"
)


def _field_values(fields: Column, name: str) -> Column:
    """Values of one field, whose JSON is a text, a wrapper of one value, or a list."""
    raw = fields[name]
    listed = F.coalesce(F.get_json_object(raw, "$.listValue.values"), F.when(raw.startswith("["), raw))
    many = F.transform(
        F.from_json(listed, "array<string>"),
        lambda e: F.coalesce(F.get_json_object(e, "$.stringValue"), F.get_json_object(e, "$.strValue"), F.get_json_object(e, "$.numberValue"),
                             F.when(~e.startswith("{"), e)),
    )
    one = F.coalesce(
        F.get_json_object(raw, "$.stringValue"), F.get_json_object(raw, "$.strValue"), F.get_json_object(raw, "$.numberValue"),
        F.when(~raw.startswith("{"), raw),
    )
    values = F.coalesce(many, F.array(one))
    return F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))


def records_from_journal_api(raw: DataFrame) -> DataFrame:
    """Wrapped JSON pages -> journal records with the page's verdict.

    A page with a gateway error, without count, or with a document of another
    kind or without identity fails whole and yields one row without a record.
    """
    p = raw.withColumn("p", F.from_json("payload", JOURNAL_SHAPE))
    code = F.lower(F.coalesce(F.get_json_object("payload", "$.Code"), F.get_json_object("payload", "$.code")))
    found = F.coalesce("p.num_found", "p.numFound")
    def fields(d):
        return d["fields"]
    def kind(d):
        return F.coalesce(d["resource_type"], d["resourceType"], F.try_element_at(_field_values(fields(d), "Type"), F.lit(1)), F.lit(""))
    def identity(d):
        return F.coalesce(F.try_element_at(_field_values(fields(d), "Id"), F.lit(1)), d["uid"], F.lit(""))
    docs = F.col("p.documents")
    reason = (
        F.when(F.col("p").isNull(), "invalid_json_shape").when(code.isNotNull() & ~code.isin("success", "200", "0"), "gateway_error")
        .when(found.isNull() | ~found.rlike("^[0-9]{1,12}$"), "invalid_count").when(docs.isNull(), "invalid_documents")
        .when((found.cast("bigint") > 0) & (F.size(docs) == 0), "missing_documents")
        .when(F.exists(docs, lambda d: kind(d) != "Periodical"), "unexpected_resource_type")
        .when(F.exists(docs, lambda d: ~identity(d).rlike("^[A-Za-z0-9_.-]{1,128}$") | (F.size(_field_values(fields(d), "Title")) == 0)), "missing_identity")
    )
    judged = p.withColumn("reason", reason)
    kept = judged.select(
        "page_id", "reason", F.explode_outer(F.when(F.col("reason").isNull(), docs)).alias("d"),
    )
    d = F.col("d")
    def first(name):
        return F.try_element_at(_field_values(F.col("d.fields"), name), F.lit(1))
    date = first("PublishDate")
    year = F.coalesce(_text(F.regexp_extract(first("PublishYear"), "^(?:19|20)[0-9]{2}", 0)), _text(F.regexp_extract(date, "^(?:19|20)[0-9]{2}", 0)))
    return kept.select(
        "page_id", F.coalesce("reason", F.lit("parsed")).alias("page_status"),
        F.when(d.isNotNull(), identity(d)).alias("record_id"), first("Title").alias("title"),
        F.when(d.isNotNull(), _field_values(F.col("d.fields"), "Creator")).alias("authors"), first("PeriodicalTitle").alias("venue"),
        year.cast("int").alias("year"), first("Issue").alias("issue"), first("DOI").alias("doi"), date.alias("publish_date"),
    )
