"""Checks of sources and sinks.

Raw payloads are rendered from the driver tables in small groups, so the jobs
read as much as the tables hold and the twin can state the rows directly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import Tables, cat, pick
from shelfmark.session import shared_path
from shelfmark.sources import feeds, pages, tables, taxonomies, works

BATCH = 20


def batched(df, row, *keys):
    """Rows rendered as text and joined per group of at most ``BATCH`` consecutive ids."""
    return df.withColumn("_r", F.struct("event_id", row.alias("text"))).groupBy(*keys, F.floor(F.col("event_id") / BATCH).alias("batch")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["text"]), "").alias("body")
    )


def tag(name, value):
    return F.coalesce(cat(f"<{name}>", value, f"</{name}>"), F.lit(""))


def feed_payloads(t: Tables):
    k, e, u = F.col("k"), F.col("event_id").cast("string"), F.col("user_id").cast("string")
    rss = cat(
        "<item>", F.when(k % 13 != 0, tag("title", cat("R &amp; ", u))).otherwise(""), tag("link", cat("https://feed.example.org/rec/U", u)),
        F.when(k % 2 == 0, tag("guid", cat("g", e))).otherwise(""), tag("description", F.when(k % 3 == 0, cat("In ", (2015 + k % 10).cast("string")))),
        tag("pubDate", F.when(k % 4 != 0, cat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), " GMT"))), "</item>",
    )
    atom = cat(
        "<entry>", F.when(k % 13 != 0, tag("title", cat("R &amp; ", u))).otherwise(""), "<link rel='alternate' href='https://feed.example.org/rec/U", u, "'/>",
        F.when(k % 2 == 0, tag("id", cat("g", e))).otherwise(""), tag("summary", F.when(k % 3 == 0, cat("In ", (2015 + k % 10).cast("string")))),
        tag("updated", F.when(k % 4 != 0, cat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "Z"))), "</entry>",
    )
    is_atom = F.floor(F.col("event_id") / BATCH) % 2 == 1
    body = batched(t.v_k, F.when(is_atom, atom).otherwise(rss))
    b = F.col("batch")
    text = F.when(b % 10 == 9, cat("<feed><entry>", F.col("body"))).when(
        b % 2 == 1, cat("<?xml version='1.0'?><feed xmlns='http://www.w3.org/2005/Atom'><title>f</title>", F.col("body"), "</feed>")
    ).otherwise(cat("<rss version='2.0'><channel><title>f</title>", F.col("body"), "</channel></rss>"))
    return body.select(cat("f", b.cast("string")).alias("feed_key"), cat("c", (b % 5).cast("string")).alias("category_id"),
                       F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("checked_at"), text.alias("payload"))


FEED_ROWS = """
    SELECT 'f' || b AS feed_key, CASE WHEN b % 10 = 9 THEN 'failed' ELSE 'parsed' END AS feed_status,
      CASE WHEN b % 10 <> 9 THEN CASE WHEN k % 2 = 0 THEN 'g' || event_id ELSE 'https://feed.example.org/rec/U' || user_id END END AS source_id,
      CASE WHEN b % 10 <> 9 THEN 'R & ' || user_id END AS title, CASE WHEN b % 10 <> 9 THEN 'https://feed.example.org/rec/U' || user_id END AS link,
      CASE WHEN b % 10 <> 9 AND k % 3 = 0 THEN 'In ' || (2015 + k % 10) END AS description,
      CASE WHEN b % 10 <> 9 AND k % 4 <> 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS published_at,
      row_number() OVER (PARTITION BY b ORDER BY event_id) AS rn, b
    FROM (SELECT *, event_id // 20 AS b FROM v_k) WHERE b % 10 = 9 OR k % 13 <> 0"""


@check("a01_feed_entries", f"""
    SELECT feed_key, feed_status, source_id, title, link, description, published_at FROM ({FEED_ROWS}) WHERE b % 10 <> 9 OR rn = 1""")
def _(t):
    from shelfmark.functions.normalise import feed_date

    return feeds.feed_entries(feed_payloads(t)).select(
        "feed_key", "feed_status", "source_id", "title", "link", "description", feed_date(F.col("published_text")).alias("published_at")
    )


@check("a01_entries_with_hints", f"""
    SELECT feed_key, link AS record_url, lower(replace(link, 'https://feed.example.org/rec/', '')) AS record_key,
      CAST(replace(description, 'In ', '') AS BIGINT) AS year_hint, published_at FROM ({FEED_ROWS}) WHERE b % 10 <> 9""")
def _(t):
    hinted = feeds.entries_with_hints(feeds.feed_entries(feed_payloads(t)), ["feed.example.org"], "feed.example.org")
    return hinted.select("feed_key", "record_url", "record_key", "year_hint", "published_at")


def oai_pages(t: Tables):
    k, u = F.col("k"), F.col("user_id").cast("string")
    record = cat(
        "<record><header", F.when(F.col("event_type") == "error", " status='deleted'").otherwise(""), ">",
        F.when(k % 17 != 0, tag("identifier", cat("oai:x:", F.when(k % 5 == 0, "z").otherwise(cat("/rec/U", u))))).otherwise(""),
        tag("datestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), "</header>",
        F.when(F.col("event_type") != "error", cat(
            "<metadata><oai_dc:dc xmlns:oai_dc='http://www.openarchives.org/OAI/2.0/oai_dc/' xmlns:dc='http://purl.org/dc/elements/1.1/'>",
            tag("dc:date", (2015 + k % 10).cast("string")), F.when(k % 2 == 0, "<dc:type>a</dc:type><dc:type> b </dc:type>").otherwise(""),
            tag("dc:identifier", cat("https://feed.example.org/rec/U", u)), "</oai_dc:dc></metadata>")).otherwise(""),
        "</record>",
    )
    body = batched(t.v_k, record)
    b = F.col("batch")
    head = "<OAI-PMH xmlns='http://www.openarchives.org/OAI/2.0/'><responseDate>2024-01-01T00:00:00Z</responseDate>"
    text = F.when(b % 10 == 7, F.lit(head + "<error code='noRecordsMatch'>none</error></OAI-PMH>")).when(
        b % 10 == 8, F.lit(head + "<error code='badResumptionToken'>old</error></OAI-PMH>")
    ).when(b % 10 == 9, cat(head, "<ListRecords>", F.col("body"))).otherwise(
        cat(head, "<ListRecords>", F.col("body"), "<resumptionToken cursor='", (b * 20).cast("string"), "' completeListSize='9'>t", b.cast("string"), "</resumptionToken></ListRecords></OAI-PMH>")
    )
    return body.select(cat("r", F.floor(b / 4).cast("string")).alias("request_id"), (b % 4).alias("page_no"), text.alias("payload"))


@check("a02_change_events", """
    SELECT 'r' || (b // 4) AS request_id, b % 4 AS page_no, 'oai:x:' || CASE WHEN k % 5 = 0 THEN 'z' ELSE '/rec/U' || user_id END AS identifier,
      strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS datestamp, event_type = 'error' AS deleted,
      CASE WHEN k % 5 <> 0 OR event_type <> 'error' THEN 'u' || user_id END AS record_key, CASE WHEN event_type <> 'error' THEN CAST(2015 + k % 10 AS VARCHAR) END AS dates,
      CASE WHEN event_type <> 'error' AND k % 2 = 0 THEN 'a|b' END AS kinds
    FROM (SELECT *, event_id // 20 AS b FROM v_k) WHERE b % 10 < 7 AND k % 17 <> 0""")
def _(t):
    return feeds.change_events(oai_pages(t)).select(
        "request_id", "page_no", "identifier", "datestamp", "deleted", "record_key",
        F.array_join(F.col("fields")["date"], "|").alias("dates"), F.array_join(F.col("fields")["type"], "|").alias("kinds"),
    )


@check("a02_change_pages", """
    SELECT 'r' || (b // 4) AS request_id, b % 4 AS page_no, CASE b % 10 WHEN 7 THEN 'empty' WHEN 8 THEN 'protocol_error' WHEN 9 THEN 'failed' ELSE 'parsed' END AS page_status,
      CASE WHEN b % 10 < 7 THEN 't' || b END AS token, CASE WHEN b % 10 < 7 THEN b * 20 END AS cursor, CASE WHEN b % 10 < 7 THEN 9 END AS list_size
    FROM (SELECT DISTINCT event_id // 20 AS b FROM events)""", ints="cursor list_size")
def _(t):
    return feeds.change_pages(oai_pages(t)).select("request_id", "page_no", "page_status", "token", "cursor", "list_size")


@check("a03_page_sequence_check", """
    WITH p AS (SELECT o_custkey AS request_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_no, o_orderkey, o_custkey % 9 <> 0 OR o_orderkey % 2 = 0 AS ok FROM orders),
    sizes AS (SELECT o_custkey AS request_id, count(*) AS n FROM orders GROUP BY 1),
    pages AS (SELECT p.*, n + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS total FROM p JOIN sizes USING (request_id) WHERE o_orderkey % 41 <> 0),
    items AS (SELECT request_id, CASE WHEN o_orderkey % 53 = 0 THEN 0 ELSE o_orderkey END AS item_id FROM p),
    r AS (SELECT request_id, count(*) AS n_items, count(*) - count(DISTINCT item_id) > 0 AS repeated FROM items GROUP BY 1),
    a AS (SELECT request_id, count(*) FILTER (WHERE ok) AS good, count(*) FILTER (WHERE NOT ok) AS bad, count(DISTINCT page_no) FILTER (WHERE ok) AS np, max(page_no) FILTER (WHERE ok) AS last, min(total) AS lo, max(total) AS hi FROM pages GROUP BY 1),
    j AS (SELECT a.*, n_items, concat_ws('|', CASE WHEN bad > 0 THEN 'page_failed' END, CASE WHEN np <> last THEN 'page_missing' END, CASE WHEN lo <> hi THEN 'total_changed' END,
        CASE WHEN hi <> n_items THEN 'total_differs' END, CASE WHEN repeated THEN 'item_repeated' END) AS reasons FROM a JOIN r USING (request_id))
    SELECT request_id, n_items, CASE WHEN good = 0 THEN 'failed' WHEN reasons = '' THEN 'success' ELSE 'partial' END AS status, reasons FROM j""")
def _(t):
    from pyspark.sql import Window

    o = F.col("o_orderkey")
    w = Window.partitionBy("o_custkey")
    base = t.orders.select(
        F.col("o_custkey").alias("request_id"), F.row_number().over(w.orderBy(o)).alias("page_no"), o.alias("o"),
        ((F.col("o_custkey") % 9 != 0) | (o % 2 == 0)).alias("ok"), (F.count("*").over(w) + F.when(o % 97 == 0, 1).otherwise(0)).alias("declared_total"),
    )
    items = base.select("request_id", F.when(F.col("o") % 53 == 0, 0).otherwise(F.col("o")).alias("item_id"))
    return feeds.page_sequence_check(base.filter("o % 41 <> 0"), items)


@check("a04_works_from_crossref", """
    SELECT '10.1000/d' || record_id AS doi, 'T ' || record_id AS title, CASE WHEN record_id % 5 = 0 THEN '' WHEN record_id % 2 = 0 THEN 'Ann Lee|Reid' ELSE 'Reid' END AS authors,
      CASE record_id % 4 WHEN 0 THEN 'journal-article' WHEN 1 THEN 'unrecognized' WHEN 2 THEN NULL ELSE 'book' END AS raw_type,
      CASE record_id % 6 WHEN 0 THEN '2020-03-04' WHEN 1 THEN '2019-07' WHEN 2 THEN '2018' WHEN 3 THEN '2020-03-04' END AS value,
      CASE record_id % 6 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' WHEN 3 THEN 'day' END AS precision,
      CASE record_id % 6 WHEN 0 THEN 'recently_published_online' WHEN 1 THEN 'recently_assigned_to_issue' WHEN 3 THEN 'recently_published_online' END AS event
    FROM v_records WHERE record_id % 11 <> 0""")
def _(t):
    d = F.col("record_id")
    ds = d.cast("string")
    authors = F.when(d % 5 == 0, "").when(d % 2 == 0, '"author":[{"given":"Ann","family":"Lee"},{"family":" Reid "}],').otherwise('"author":[{"given":"","family":"Reid"},{}],')
    kind = pick(d % 4, '"type":"journal-article",', '"type":" ",', '"x":1,', '"type":" book",')
    online, printed, generic = '"published-online":{"date-parts":[[2020,3,4]]},', '"published-print":{"date-parts":[[2019,7]]},', '"published":{"date-parts":[[2018]]},'
    dates = pick(d % 6, online + printed, printed + generic, generic, online, '"published":{"date-parts":[[]]},', '"published-print":{"date-parts":[[2019,2,31]]},')
    text = cat('{"DOI":"https://doi.org/10.1000/D', ds, '",', F.when(d % 11 == 0, '"title":[],').otherwise(cat('"title":["T ', ds, '"],')), authors, kind, dates, '"z":0}')
    return works.works_from_crossref(t.v_records.select(text.alias("payload"))).select("doi", "title", "authors", "raw_type", "value", "precision", "event")


@check("a05_works_from_openalex", """
    SELECT 'W' || record_id AS work_key, CASE WHEN record_id % 3 = 0 THEN '10.1000/d' || record_id END AS doi, 'Ann|Bob' AS authors,
      CASE record_id % 4 WHEN 0 THEN record_id END AS citations, CASE record_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'unrecognized' END AS raw_type,
      CASE WHEN record_id % 5 <> 0 THEN '2021-02-03' END AS value,
      CASE WHEN record_id % 7 = 0 THEN 'https://land.example.org' ELSE 'W' || record_id END AS stable_url
    FROM v_records WHERE record_id % 11 <> 0""")
def _(t):
    d = F.col("record_id")
    ds = d.cast("string")
    count = F.when(d % 4 == 0, ds).otherwise(pick(d % 4, "0", "-3", "null", '"12"'))
    text = cat(
        '{"id":"W', ds, '","title":"', F.when(d % 11 == 0, " ").otherwise(cat("T ", ds)), '","doi":', F.when(d % 3 == 0, cat('"https://doi.org/10.1000/D', ds, '"')).otherwise("null"),
        ',"type":', pick(d % 3, '"article"', "5.5", "null"), ',"publication_date":', F.when(d % 5 == 0, '"2021-02-33"').otherwise('"2021-02-03"'),
        ',"cited_by_count":', count, ',"authorships":[{"author":{"display_name":"Ann"}},{"author":{"display_name":" "}},{"author":{"display_name":"Bob "}}]',
        F.when(d % 7 == 0, ',"primary_location":{"landing_page_url":"https://land.example.org"}').otherwise(',"primary_location":null'), "}",
    )
    text = F.regexp_replace(text, '"type":5.5', '"type":" "')
    return works.works_from_openalex(t.v_records.select(text.alias("payload"))).select(
        "work_key", "doi", "authors", "citations", "raw_type", "value", "stable_url"
    )


def listing_pages(t: Tables):
    k, e, u = F.col("k"), F.col("event_id").cast("string"), F.col("user_id").cast("string")
    item = cat(
        "<div class='x list-item'><p class='tit clearfix'><a class='left' href='", F.when(k % 19 == 0, "http://bad/").otherwise("//list.example.org/Article/"), e, ".htm'> T &amp; ", e, "&nbsp;</a></p>",
        "<p class='source'><span><a data-key='A' href='/Search?author=a'>Ann ", u, "</a></span>",
        F.when(k % 2 == 0, "<a data-key='B' href='/Search?author=b'>Bob</a>").otherwise(""), "<a href='/Redirect/1'><span>《V ", u, "》</span></a><a href='/Redirect/1'><span>",
        pick(k % 3, "2024年07期", "2024年3月", "x"), "</span></a><span>", F.when(k % 23 == 0, "book").otherwise("journal"), "</span></p></div>",
    )
    body = batched(t.v_k, item)
    b = F.col("batch")
    html = cat("<div class='lplist'>", F.when(b % 10 == 6, "").otherwise(F.col("body")), "</div>",
               F.when(b % 10 == 7, "").otherwise(cat("<script>$('#hidTotalPageCount').val('", F.when(b % 10 == 8, "0").otherwise("3"), "');</script>")),
               F.when(b % 10 == 9, "captcha").otherwise(""))
    return body.select(b.alias("page_id"), html.alias("html"))


def listing_url(column):
    return F.when(column.rlike(r"^(https:)?//list\.example\.org/Article/[0-9]+\.htm$"), cat("https:", F.regexp_replace(column, "^https:", "")))


@check("a06_listing_records", """
    WITH r AS (SELECT *, event_id // 20 AS b FROM v_k),
    s AS (SELECT DISTINCT b, CASE b % 10 WHEN 9 THEN 'blocked' WHEN 7 THEN 'pagination_missing' WHEN 6 THEN 'records_missing' WHEN 8 THEN 'pagination_inconsistent' ELSE 'parsed' END AS page_status FROM r)
    SELECT s.b AS page_id, page_status, 'https://list.example.org/Article/' || event_id || '.htm' AS url, 'T & ' || event_id AS title,
      'Ann ' || user_id || CASE WHEN k % 2 = 0 THEN '|Bob' ELSE '' END AS authors, 'V ' || user_id AS venue, CASE WHEN k % 3 < 2 THEN 2024 END AS year,
      CASE k % 3 WHEN 0 THEN '7' WHEN 1 THEN '3月' END AS issue, CASE k % 3 WHEN 1 THEN 3 END AS label_month
    FROM s LEFT JOIN r ON r.b = s.b AND page_status = 'parsed' AND k % 19 <> 0 AND k % 23 <> 0""", ints="year label_month")
def _(t):
    return pages.listing_records(listing_pages(t), listing_url, "journal").select(
        "page_id", "page_status", "url", "title", "authors", "venue", "year", "issue", "label_month"
    )


def journal_pages(t: Tables):
    k, e, u = F.col("k"), F.col("event_id").cast("string"), F.col("user_id").cast("string")
    doc = cat(
        ',{"resource_type":"Periodical","uid":"u', e, '","fields":{"Title":{"strValue":"T ', e, '"},"Creator":{"listValue":{"values":[{"strValue":"Ann"},{"strValue":" "},{"strValue":"', u, '"}]}},',
        F.when(k % 2 == 0, cat('"Id":{"strValue":"i', e, '"},')).otherwise(""), F.when(k % 3 == 0, '"PublishYear":{"numberValue":2021},').otherwise(""),
        '"PublishDate":{"strValue":"2020-05-06"},"Issue":"', (k % 12).cast("string"), '","PeriodicalTitle":["V"]}}',
    )
    body = batched(t.v_k, doc)
    b = F.col("batch")
    docs = F.substring("body", 2, 10_000_000)
    text = F.when(b % 10 == 5, F.lit('{"Code":"Failure","num_found":3,"documents":[]}')).when(b % 10 == 6, cat('{"num_found":"x","documents":[', docs, "]}")).when(
        b % 10 == 7, F.lit('{"num_found":3,"documents":[]}')
    ).when(b % 10 == 8, cat('{"num_found":3,"documents":[{"resource_type":"Thesis","fields":{}},', docs, "]}")).when(
        b % 10 == 9, cat('{"num_found":3,"documents":[{"resource_type":"Periodical","fields":{}},', docs, "]}")
    ).otherwise(cat('{"code":"SUCCESS","num_found":"20","documents":[', docs, "]}"))
    return body.select(b.alias("page_id"), text.alias("payload"))


@check("a07_records_from_journal_api", """
    WITH r AS (SELECT *, event_id // 20 AS b FROM v_k),
    s AS (SELECT DISTINCT b, CASE b % 10 WHEN 5 THEN 'gateway_error' WHEN 6 THEN 'invalid_count' WHEN 7 THEN 'missing_documents' WHEN 8 THEN 'unexpected_resource_type' WHEN 9 THEN 'missing_identity' ELSE 'parsed' END AS page_status FROM r)
    SELECT s.b AS page_id, page_status, CASE WHEN k % 2 = 0 THEN 'i' ELSE 'u' END || event_id AS record_id, 'T ' || event_id AS title, 'Ann|' || user_id AS authors,
      CASE WHEN event_id IS NOT NULL THEN 'V' END AS venue, CASE WHEN k % 3 = 0 THEN 2021 WHEN k IS NOT NULL THEN 2020 END AS year, CAST(k % 12 AS VARCHAR) AS issue
    FROM s LEFT JOIN r ON r.b = s.b AND page_status = 'parsed'""", ints="year")
def _(t):
    out = works.records_from_journal_api(journal_pages(t))
    return out.select("page_id", "page_status", "record_id", "title", "authors", "venue", "year", "issue")


def toc_pages(t: Tables):
    k, e, u = F.col("k"), F.col("event_id").cast("string"), F.col("user_id").cast("string")
    row = cat("<li><a href='/view/", e, "'>T ", F.when((k == 5) & (F.col("event_id") % 3 == 0), "same").otherwise(e), "</a> <i>", F.when(k % 4 != 0, cat("A ", u)).otherwise(""), "</i></li>")
    body = batched(t.v_k, row)
    b = F.col("batch")
    request = F.floor(b / 3)
    html = cat(F.when(request % 11 == 0, "").otherwise(cat("<h1>2024 No. ", F.when((request % 7 == 0) & (b % 3 == 2), "9").otherwise((request % 6).cast("string")), "</h1>")),
               F.when(request % 13 == 0, "").otherwise(F.col("body")))
    return body.select(request.alias("request_id"), (b % 3).alias("page_no"), F.lit("toc.example.org").alias("host"), html.alias("html"))


def toc_rules(t: Tables):
    return t.spark.createDataFrame(
        [("toc.example.org", r"<a href='([^']*)'>([^<]*)</a> <i>([^<]*)</i>", r"<h1>2024 No\. ([0-9]+)</h1>")],
        "host string, article_pattern string, issue_pattern string",
    )


TOC = """
    WITH r AS (SELECT *, event_id // 60 AS q, CASE WHEN k = 5 AND event_id % 3 = 0 THEN 'T same' ELSE 'T ' || event_id END AS title FROM v_k),
    many AS (SELECT q, title FROM r GROUP BY ALL HAVING count(*) > 1), pages AS (SELECT q, count(DISTINCT event_id // 20) AS np, count(DISTINCT title) AS n FROM r GROUP BY q),
    s AS (SELECT q, CASE WHEN q % 13 = 0 THEN 0 ELSE n END AS n_titles, CASE WHEN q % 11 = 0 THEN '' WHEN NOT (q % 7 = 0 AND np = 3) THEN CAST(q % 6 AS VARCHAR) END AS issue,
        CASE WHEN q % 11 = 0 THEN 'issue_heading_missing' WHEN q % 7 = 0 AND np = 3 THEN 'issue_changed' WHEN q % 13 = 0 THEN 'articles_missing' WHEN q IN (SELECT q FROM many) THEN 'titles_repeat' ELSE 'complete' END AS toc_status FROM pages)"""


@check("a08_toc_verdict", TOC + " SELECT q AS request_id, n_titles, issue, toc_status FROM s")
def _(t):
    return pages.toc_articles(toc_pages(t), toc_rules(t))[1]


@check("a08_toc_articles", TOC + """
    SELECT q AS request_id, issue, title, CASE WHEN k % 4 <> 0 THEN 'A ' || user_id END AS author, '/view/' || event_id AS url FROM r JOIN s USING (q) WHERE toc_status = 'complete'""")
def _(t):
    return pages.toc_articles(toc_pages(t), toc_rules(t))[0]


@check("a09_page_links", """
    WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1, 's')) AS url,
        unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2, 's')) AS label,
        generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1, 's'), 1) - 1 AS pos FROM pages),
    f AS (SELECT page_id, url, arg_min(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(label, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g')), pos) AS label, min(pos) AS position FROM a WHERE url <> '' GROUP BY ALL),
    n AS (SELECT page_id, count(*) AS n FROM f GROUP BY 1)
    SELECT p.page_id, CASE WHEN n.n IS NULL THEN 'no_links' ELSE 'parsed' END AS page_status, f.url, f.label, f.position
    FROM pages p LEFT JOIN n USING (page_id) LEFT JOIN f ON f.page_id = p.page_id""")
def _(t):
    return pages.page_links(t.pages, lambda c: F.when(c != "", c))


def taxonomy_payloads(t: Tables):
    """Category payloads of ten parts each, in both written forms, with planted faults."""
    p = F.col("p_partkey")
    ps = (p + 2).cast("string")
    parent = F.when(p % 10 == 0, F.lit(None)).otherwise((F.floor(p / 10) * 10 + 2).cast("string"))
    name = F.when(p % 17 == 3, F.lit("")).when(p % 10 == 0, cat("Root ", ps)).otherwise(F.col("p_name"))
    object_ = cat('{"name":"', name, '","id":', ps, ',"parents":"1', F.coalesce(cat(",", parent), F.lit("")), '","primaryParent":', F.coalesce(parent, F.lit("1")), "}")
    row = cat('["', name, '","', ps, '",[1', F.coalesce(cat(",", parent), F.lit("")), "],", F.when(p % 19 == 4, "77").otherwise(F.coalesce(parent, F.lit('""'))), "]")
    positional = F.floor(p / 10) % 2 == 1
    rows = t.part.select(F.floor(p / 10).alias("s"), F.struct(p.alias("p"), F.when(positional, row).otherwise(object_).alias("text")).alias("r"))
    body = rows.groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["text"]), ",").alias("b"))
    return body.select(cat("s", F.col("s").cast("string")).alias("snapshot_id"),
                       F.when(F.col("s") % 2 == 1, cat("[", F.col("b"), "]")).otherwise(cat('{"categories":[', F.col("b"), "]}")).alias("payload"))


@check("a10_taxonomy_nodes", """
    SELECT 's' || (p_partkey // 10) AS snapshot_id, CAST(p_partkey + 2 AS VARCHAR) AS category_id, CASE WHEN p_partkey % 10 = 0 THEN 'Root ' || (p_partkey + 2) ELSE p_name END AS name,
      CASE WHEN p_partkey % 10 = 0 THEN '' ELSE CAST(p_partkey // 10 * 10 + 2 AS VARCHAR) END AS parent_ids,
      CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_partkey // 10 * 10 + 2 AS VARCHAR) END AS primary_parent_id, TRUE AS active
    FROM part WHERE p_partkey % 17 <> 3 AND NOT (p_partkey // 10 % 2 = 1 AND p_partkey % 19 = 4)""")
def _(t):
    return taxonomies.taxonomy_nodes(taxonomy_payloads(t))[0]


@check("a10_taxonomy_set_aside", """
    SELECT 's' || (p_partkey // 10) AS snapshot_id, p_partkey % 10 AS source_index, CAST(p_partkey + 2 AS VARCHAR) AS category_id,
      CASE WHEN p_partkey // 10 % 2 = 1 AND p_partkey % 19 = 4 THEN 'primary_parent_not_parent' WHEN p_partkey % 10 = 0 THEN 'unnamed_parent' ELSE 'empty_category_name_unreferenced_leaf' END AS reason
    FROM part WHERE p_partkey % 17 = 3 OR (p_partkey // 10 % 2 = 1 AND p_partkey % 19 = 4)""")
def _(t):
    return taxonomies.taxonomy_nodes(taxonomy_payloads(t))[1]


@check("a10_duplicate_names", """
    SELECT 's' || (p_partkey // 10) AS snapshot_id, lower(p_name) AS name_key, count(*) AS n_ids, min(CAST(p_partkey + 2 AS VARCHAR)) AS first_id
    FROM part WHERE p_partkey % 17 <> 3 AND p_partkey % 10 <> 0 AND NOT (p_partkey // 10 % 2 = 1 AND p_partkey % 19 = 4) GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    return taxonomies.taxonomy_nodes(taxonomy_payloads(t))[2]


def saved_feeds(t: Tables):
    c = F.col("o_custkey")
    key = cat("f", (c % 200).cast("string")).alias("feed_key")
    end = F.lit("2024-01-08 00:00:00").cast("timestamp_ntz")
    saved = t.orders.filter("o_custkey % 200 < 150").select(
        key, cat("c", (c % 200 + F.when(c % 200 % 17 == 0, 1).otherwise(0)).cast("string")).alias("category_id"),
        F.when(c % 200 % 13 == 0, end - F.expr("INTERVAL 1 HOUR")).otherwise(end).alias("checked_at"),
    ).distinct()
    wanted = t.orders.filter("o_custkey % 200 >= 20").select(key, cat("c", (c % 200).cast("string")).alias("category_id")).distinct()
    return saved, wanted


@check("a13_replay_check", """
    WITH k AS (SELECT DISTINCT o_custkey % 200 AS n FROM orders)
    SELECT 'f' || n AS feed_key, CASE WHEN n >= 150 THEN 'missing' WHEN n < 20 THEN 'extra' WHEN n % 17 = 0 THEN 'category_differs' WHEN n % 13 = 0 THEN 'other_window' ELSE 'usable' END AS state FROM k""")
def _(t):
    return feeds.replay_check(*saved_feeds(t), "2024-01-08 00:00:00")


@check("a13_replay_snapshot", """
    SELECT DISTINCT 'f' || (o_custkey % 200) AS feed_key, 'c' || (o_custkey % 200) AS category_id FROM orders
    WHERE o_custkey % 200 BETWEEN 20 AND 149 AND o_custkey % 200 % 17 <> 0 AND o_custkey % 200 % 13 <> 0""")
def _(t):
    saved, wanted = saved_feeds(t)
    good = saved.join(feeds.replay_check(saved, wanted, "2024-01-08 00:00:00").filter("state = 'usable'"), "feed_key", "left_semi")
    usable = feeds.replay_snapshot(good, good.select("feed_key", "category_id"), "2024-01-08 00:00:00")
    refused = feeds.replay_snapshot(saved, wanted, "2024-01-08 00:00:00")
    return usable.select("feed_key", "category_id").unionByName(refused.select("feed_key", "category_id"))


@check("a14_write_run", """
    SELECT record_url, reason_code, 'run-1' AS run_id FROM v_unresolved WHERE attempts < 3 UNION ALL SELECT record_url, reason_code, 'run-3' FROM v_unresolved WHERE attempts >= 3""")
def _(t):
    root = shared_path(t.spark, "runs")
    rows = t.v_unresolved.select("record_url", "reason_code", "attempts")
    tables.write_run({"unresolved": rows.filter("attempts < 3").drop("attempts")}, root, "run-1", "weekly", ("2024-01-01", "2024-01-08"))
    # a run that stopped before its ledger row stays unseen
    rows.drop("attempts").write.parquet(f"{root}/unresolved/run_id=run-2")
    tables.write_run({"unresolved": rows.filter("attempts >= 3").drop("attempts")}, root, "run-3", "weekly", ("2024-01-08", "2024-01-15"))
    return tables.read_run_table(t.spark, root, "unresolved")


@check("a14_latest_version", "SELECT record_url, 'run-1' AS run_id FROM v_unresolved WHERE attempts < 3")
def _(t):
    """A later run that did not write the table leaves its state as it was."""
    root = shared_path(t.spark, "runs")
    rows = t.v_unresolved.select("record_url", "attempts")
    tables.write_run({"unresolved": rows.filter("attempts < 3")}, root, "run-1", "weekly", ("2024-01-01", "2024-01-08"))
    tables.write_run({"report": rows}, root, "run-2", "on-demand", ("2024-01-08", "2024-01-15"))
    return tables.latest_version(t.spark, root, "unresolved").select("record_url", "run_id")


@check("a15_review_queue", """
    SELECT record_url, title, 'year_review_pending' AS reason, '' AS labels, NULL AS evidence_fingerprint FROM v_unresolved WHERE attempts = 0
    UNION ALL SELECT record_url, title, 'identity_unverified', 'a:' || attempts || '|' || reason_code, sha256('a:' || attempts || chr(30) || reason_code) FROM v_unresolved WHERE attempts = 1
    UNION ALL SELECT record_url, title, 'confirmed_type', 'a:' || attempts || '|' || reason_code, sha256('a:' || attempts || chr(30) || reason_code) FROM v_unresolved WHERE attempts = 3""")
def _(t):
    rows = t.v_unresolved.withColumn("labels", F.array(F.col("reason_code"), cat("a:", F.col("attempts").cast("string"))))
    unconfirmed = rows.filter("attempts IN (1, 2)").withColumn("reason", F.when(F.col("attempts") == 1, "identity_unverified").otherwise("filtered_out"))
    return tables.review_queue(rows.filter("attempts = 0"), unconfirmed, rows.filter("attempts = 3"))
