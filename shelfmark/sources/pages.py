"""Web pages landed as HTML text: links, listings and tables of contents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import normalise as N
from shelfmark.functions.references import unescape

def inner_text(column: Column) -> Column:
    """Text of an HTML fragment, references resolved and spaces squeezed."""
    bare = unescape(F.regexp_replace(column, r"<[^>]*>", ""))
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


# an anchor with its link in double, single or no quotes, and its text
ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))[^>]*>(.*?)</a\s*>"


def page_links(pages: DataFrame, canonical: Callable[[Column], Column], raw_pattern: str | None = None, most: int | None = None) -> DataFrame:
    """Links of each page: anchors first, then bare URLs; the first label of a URL wins.

    ``canonical`` turns a link into the kept URL or NULL.  With ``most``,
    ``page_status`` is ``link_limit`` on a page with more URLs, which then yields
    no links; pages without links keep one row.
    """
    groups = [F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(k)).alias(f"g{k}") for k in range(1, 5)]
    anchors = F.transform(
        F.arrays_zip(*groups),
        lambda a: F.struct(
            F.concat(*[F.coalesce(a[f"g{k}"], F.lit("")) for k in (1, 2, 3)]).alias("href"), inner_text(a["g4"]).alias("label")
        ),
    )
    if raw_pattern:
        bare = F.transform(
            F.regexp_extract_all(F.translate(unescape(F.col("html")), "\u00a0", " "), F.lit(f"({raw_pattern})"), F.lit(1)),
            lambda u: F.struct(u.alias("href"), F.lit("").alias("label")),
        )
        anchors = F.concat(anchors, bare)
    found = pages.select("page_id", F.posexplode_outer(anchors).alias("position", "a")).select(
        "page_id", "position", canonical(F.col("a.href")).alias("url"), F.col("a.label").alias("label")
    )
    first = found.filter("url IS NOT NULL").groupBy("page_id", "url").agg(
        F.min_by("label", "position").alias("label"), F.min("position").alias("position")
    )
    sizes = first.groupBy("page_id").agg(F.count("*").alias("_n"))
    marked = pages.select("page_id").join(sizes, "page_id", "left").withColumn(
        "page_status", F.when(F.lit(most is not None) & (F.col("_n") > (most or 0)), "link_limit").when(F.col("_n").isNull(), "no_links").otherwise("parsed")
    )
    kept = first if most is None else first.join(sizes.filter(F.col("_n") <= most).select("page_id"), "page_id", "left_semi")
    return marked.select("page_id", "page_status").join(kept, "page_id", "left")


# Marks of a challenge page, the page count and issue labels.
CHALLENGE_MARKS = ["captcha", "verify-human", "安全验证"]
PAGE_COUNT = r"TotalPageCount[\"']?\)?\s*(?:\.val\(|=|:)\s*[\"']?([0-9]+)"
ISSUE_LABEL = r"((?:19|20)[0-9]{2})\s*年\s*第?\s*([0-9A-Za-z]{1,6})\s*期"
MONTH_LABEL = r"((?:19|20)[0-9]{2})\s*年\s*(0?[1-9]|1[0-2])\s*月"
ITEM_START = r"(?is)<div\b[^>]*\bclass\s*=\s*[\"'][^\"']*\blist-item\b[^\"']*[\"'][^>]*>"


def listing_records(
    pages: DataFrame, article_url: Callable[[Column], Column], kind_mark: str, title_mark: str | None = None
) -> DataFrame:
    """Listing pages -> journal records with the page's verdict.

    ``title_mark`` is a pattern of what the site appends to titles, to be cut off.

    A challenge page, a missing page count and pages whose count and rows
    disagree fail; they keep one row without a record.
    """
    blocked = F.lit(False)
    for mark in CHALLENGE_MARKS:
        blocked = blocked | F.col("html").contains(mark)
    total = F.regexp_extract("html", PAGE_COUNT, 1)
    split = F.split("html", ITEM_START)
    blocks = F.slice(split, F.lit(2), F.size(split))
    item_title = inner_text(F.regexp_extract(F.col("_title"), r"(?is)<a\b[^>]*>(.*?)</a>", 1))
    if title_mark:
        item_title = F.regexp_replace(item_title, rf"\s*(?:{title_mark})$", "")
    heads = pages.select("page_id", blocked.alias("_blocked"), F.when(total != "", total.cast("int")).alias("total_pages"))
    items = pages.select("page_id", F.posexplode_outer(blocks).alias("position", "b"))
    title_part = F.regexp_extract("b", r"(?is)<p\b[^>]*\bclass\s*=\s*[\"'][^\"']*\btit\b[^\"']*[\"'][^>]*>(.*?)</p>", 1)
    source_part = F.regexp_extract("b", r"(?is)<p\b[^>]*\bclass\s*=\s*[\"'][^\"']*\bsource\b[^\"']*[\"'][^>]*>(.*?)</p>", 1)
    # parts that several columns need are columns themselves, so each is found once
    source = F.col("_source")
    redirects = F.regexp_extract_all(source, F.lit(r"(?is)<a\b[^>]*href\s*=\s*[\"'][^\"']*Redirect[^\"']*[\"'][^>]*>(.*?)</a>"), F.lit(1))
    authors = F.transform(
        F.regexp_extract_all(source, F.lit(r"(?is)<a\b[^>]*data-key[^>]*author=[^>]*>(.*?)</a>"), F.lit(1)), inner_text
    )
    label = F.col("_label")
    issue, month = F.regexp_extract(label, ISSUE_LABEL, 2), F.regexp_extract(label, MONTH_LABEL, 2)
    year = F.coalesce(
        F.nullif(F.regexp_extract(label, ISSUE_LABEL, 1), F.lit("")), F.nullif(F.regexp_extract(label, MONTH_LABEL, 1), F.lit(""))
    )
    parts = items.withColumn("_title", title_part).withColumn("_source", source_part).withColumn("_redirects", redirects)
    records = parts.withColumn("_label", inner_text(F.try_element_at("_redirects", F.lit(2)))).select(
        "page_id", "position",
        item_title.alias("title"),
        article_url(F.concat(*[F.regexp_extract("_title", ANCHOR, k) for k in (1, 2, 3)])).alias("url"),
        F.array_distinct(F.filter(authors, lambda a: a != "")).alias("authors"),
        F.regexp_replace(inner_text(F.try_element_at("_redirects", F.lit(1))), "[《》]", "").alias("venue"),
        year.cast("int").alias("year"),
        F.when(issue != "", F.regexp_replace(F.upper(issue), "^0+", "")).when(month != "", F.concat(month.cast("int").cast("string"), F.lit("月"))).alias("issue"),
        F.when(month != "", month.cast("int")).alias("label_month"),
        inner_text(source).contains(kind_mark).alias("_kind"),
    )
    usable = records.filter("title <> '' AND url IS NOT NULL AND venue <> '' AND _kind")
    body = F.struct("title", "authors", "venue", "year", "issue", "label_month")
    kept = usable.groupBy("page_id", "url").agg(F.max_by(body, "position").alias("r")).select("page_id", "url", "r.*")
    sizes = kept.groupBy("page_id").agg(F.count("*").alias("_n"))
    verdict = heads.groupBy("page_id").agg(F.first("_blocked").alias("_blocked"), F.first("total_pages").alias("total_pages")).join(
        sizes, "page_id", "left"
    )
    n = F.coalesce("_n", F.lit(0))
    status = (
        F.when(F.col("_blocked"), "blocked").when(F.col("total_pages").isNull(), "pagination_missing")
        .when((F.col("total_pages") > 0) & (n == 0), "records_missing")
        .when((F.col("total_pages") == 0) & (n > 0), "pagination_inconsistent").otherwise("parsed")
    )
    judged = verdict.withColumn("page_status", status)
    good = judged.filter("page_status = 'parsed'").select("page_id")
    return judged.select("page_id", "page_status", "total_pages").join(kept.join(good, "page_id", "left_semi"), "page_id", "left")


def toc_articles(pages: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of contents -> articles of sound issues, and a verdict per issue.

    ``pages``: ``request_id, page_no, host, html``; ``rules``, one per host:
    ``article_pattern`` with groups URL, title, author, and ``issue_pattern``.
    Repeated titles, an issue that changes between pages, or no articles reject
    the whole request.
    """
    ruled = pages.join(rules, "host").withColumn("issue", F.expr("regexp_extract(html, issue_pattern, 1)"))
    found = ruled.select(
        "request_id", "page_no", "issue",
        F.posexplode_outer(F.arrays_zip(
            F.expr("regexp_extract_all(html, article_pattern, 1)").alias("u"), F.expr("regexp_extract_all(html, article_pattern, 2)").alias("t"),
            F.expr("regexp_extract_all(html, article_pattern, 3)").alias("a"),
        )).alias("position", "x"),
    ).select("request_id", "page_no", "issue", "position", F.col("x.u").alias("url"), inner_text(F.col("x.t")).alias("title"), inner_text(F.col("x.a")).alias("author"))
    titles = found.filter("title IS NOT NULL").groupBy("request_id", "title").agg(F.count("*").alias("_n")).groupBy("request_id").agg(
        F.count("*").alias("n_titles"), F.max("_n").alias("_most")
    )
    issues = ruled.groupBy("request_id").agg(F.min("issue").alias("_low"), F.max("issue").alias("_high"))
    status = (
        F.when(F.col("_low") == "", "issue_heading_missing").when(F.col("_low") != F.col("_high"), "issue_changed")
        .when(F.col("n_titles").isNull(), "articles_missing").when(F.col("_most") > 1, "titles_repeat").otherwise("complete")
    )
    verdict = issues.join(titles, "request_id", "left").select(
        "request_id", F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("issue"), F.coalesce("n_titles", F.lit(0)).alias("n_titles"), status.alias("toc_status")
    )
    good = verdict.filter("toc_status = 'complete'").select("request_id")
    return found.filter("title IS NOT NULL").join(good, "request_id", "left_semi").select(
        "request_id", "issue", "title", F.nullif("author", F.lit("")).alias("author"), "url"
    ), verdict


def post_links(pages: DataFrame, host: str) -> DataFrame:
    """``page_links`` for direct posts of one host."""
    pattern = rf"https://{re.escape(host)}/s(?:/[A-Za-z0-9_-]+|\?[^\s\"'<>]+)"
    return page_links(pages, lambda c: N.post_url(c, host), pattern)
