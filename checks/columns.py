"""Checks of the normalisation columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import cat, pick
from shelfmark.functions import normalise as N

# SQL twins share these spellings.
FOLD = (
    "trim(regexp_replace(replace(replace(strip_accents(lower({0})), 'ß', 'ss'), '&', ' and '), "
    "'[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
)
NORM = (
    "trim(regexp_replace(replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), '&', ' and '), "
    "'[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
)
STOPS = (
    "['a','an','and','at','das','de','der','des','die','el','en','et','for','in','la','le','les',"
    "'of','on','the','to','un','und','une']"
)


@check("b01_doi_norm", """
    SELECT record_id,
      CASE WHEN record_id % 4 <> 3 AND record_id % 3 = 0 THEN '10.1000/a' || (record_id % 400) END AS doi_norm
    FROM v_records""")
def _(t):
    d = F.col("record_id")
    body = F.when(d % 3 == 0, cat("10.1000/A", (d % 400).cast("string"))).otherwise(F.lit("10.12/short"))
    raw = F.when(d % 4 == 0, cat(" https://doi.org/", body)).when(
        d % 4 == 1, cat("DOI: ", body, ".;)")
    ).when(d % 4 == 2, cat("http://dx.doi.org/", body, ",")).otherwise(cat("see ", body))
    return t.v_records.select("record_id", N.doi_norm(raw).alias("doi_norm"))


@check("b02_title_norm", f"SELECT record_id, {NORM.format('title')} AS title_norm FROM v_records")
def _(t):
    return t.v_records.select("record_id", N.title_norm(F.col("title")).alias("title_norm"))


@check("b03_title_fold", f"SELECT record_id, {FOLD.format('title')} AS title_fold FROM v_records")
def _(t):
    return t.v_records.select("record_id", N.title_fold(F.col("title")).alias("title_fold"))


@check("b04_compact", """
    SELECT record_id, regexp_replace(replace(lower(nfc_normalize(title)), 'ß', 'ss'),
           '[^\\p{L}\\p{N}]', '', 'g') AS compact FROM v_records""")
def _(t):
    return t.v_records.select("record_id", N.compact(F.col("title")).alias("compact"))


@check("b05_term_norm", """
    SELECT record_id, regexp_replace(replace(lower(nfc_normalize(title)), 'ß', 'ss'),
           '\\s+', '', 'g') AS term_norm FROM v_records""")
def _(t):
    return t.v_records.select("record_id", N.term_norm(F.col("title")).alias("term_norm"))


@check("b06_content_tokens", f"""
    SELECT record_id, array_to_string(list_sort(list_distinct(list_filter(string_split(
        {FOLD.format('title')}, ' '), lambda x: x <> '' AND NOT list_contains({STOPS}, x)))), '|') AS content_tokens
    FROM v_records""")
def _(t):
    folded = N.title_fold(F.col("title"))
    return t.v_records.select("record_id", N.content_tokens(folded).alias("content_tokens"))


@check("b07_script_families", """
    SELECT record_id, concat_ws('|',
        CASE WHEN regexp_matches(x, '\\p{Han}') THEN 'CJK' END,
        CASE WHEN regexp_matches(x, '\\p{Cyrillic}') THEN 'CYRILLIC' END,
        CASE WHEN regexp_matches(x, '\\p{Greek}') THEN 'GREEK' END,
        CASE WHEN regexp_matches(x, '\\p{Latin}') THEN 'LATIN' END) AS scripts
    FROM (SELECT record_id, CASE record_id % 4 WHEN 0 THEN title WHEN 1 THEN '漢字 ' || record_id
                 WHEN 2 THEN 'λόγος ' || title ELSE 'Мир' END AS x FROM v_records)""")
def _(t):
    d = F.col("record_id")
    text = F.when(d % 4 == 0, F.col("title")).when(d % 4 == 1, cat("漢字 ", d.cast("string"))).when(
        d % 4 == 2, cat("λόγος ", F.col("title"))
    ).otherwise(F.lit("Мир"))
    return t.v_records.select("record_id", N.script_families(text).alias("scripts"))


@check("b08_author_keys", """
    SELECT record_id,
      CASE record_id % 3 WHEN 0 THEN 'ann lee ' || s WHEN 1 THEN 'ann ' || s || ' van' ELSE s || ' van' END AS name_words,
      s AS surname, CASE record_id % 3 WHEN 2 THEN 'v' ELSE 'a' END AS initial
    FROM (SELECT record_id, 'src' || (record_id % 20) AS s FROM v_records)""")
def _(t):
    d = F.col("record_id")
    s = cat("Src", (d % 20).cast("string"))
    name = F.when(d % 3 == 0, cat("Ann Lee ", s)).when(
        d % 3 == 1, cat("van ", s, F.when(d % 2 == 0, ", Ann").otherwise("，Ann"))
    ).otherwise(cat("Van ", s))
    return t.v_records.select("record_id", N.author_keys(name).alias("a")).select("record_id", "a.*")


@check("b09_split_display", """
    SELECT event_id, CASE WHEN k % 2 = 0 THEN 'Reid, User ' || user_id END AS author,
        CASE WHEN k % 2 = 0 THEN 'On: K ' || k WHEN k % 3 = 0 THEN 'Note: K ' || k
             ELSE 'Plain, K ' || k END AS title
    FROM v_k""")
def _(t):
    k, u = F.col("k"), F.col("user_id").cast("string")
    ks = k.cast("string")
    text = F.when(k % 2 == 0, cat("Reid, User ", u, ": On: K ", ks)).when(
        k % 3 == 0, cat(" Note: K ", ks)
    ).otherwise(cat("Plain, K ", ks, " "))
    return t.v_k.select("event_id", N.split_display(text).alias("s")).select("event_id", "s.*")


@check("b10_record_url", """
    SELECT event_id, CASE WHEN k % 7 <> 0 AND k % 11 <> 0 AND k % 13 <> 0
        THEN 'https://feed.example.org/rec/U' || user_id END AS record_url FROM v_k""")
def _(t):
    k, u = F.col("k"), F.col("user_id").cast("string")
    link = cat(
        F.when(k % 7 == 0, "http://").otherwise("https://"),
        F.when(k % 13 == 0, "evil.example.org").when(k % 2 == 0, "www.feed.example.org")
        .otherwise("feed.example.org"),
        F.when(k % 11 == 0, "/rec/..").otherwise(cat("/rec/U", u, "/")), "?ref=feed#top",
    )
    hosts = ["feed.example.org", "www.feed.example.org"]
    return t.v_k.select("event_id", N.record_url(link, hosts, "feed.example.org").alias("record_url"))


@check("b11_record_key", """
    SELECT event_id, CASE WHEN k % 5 <> 4 THEN 'u-' || user_id END AS record_key FROM v_k""")
def _(t):
    k, u = F.col("k"), F.col("user_id").cast("string")
    head = F.when(k % 5 == 0, cat("oai:x:/REC/U-", u)).when(k % 5 == 1, cat("oai:x%2Frec%2FU-", u, "?a=1"))
    others = F.when(k % 5 == 4, F.array(F.lit("none"))).otherwise(
        F.array(F.lit("doi:x"), cat("https://feed.example.org/rec/U-", u, "#z"))
    )
    return t.v_k.select("event_id", N.first_record_key(head, others).alias("record_key"))


@check("b12_post_url", """
    SELECT event_id, CASE WHEN k % 3 = 0 THEN 'https://post.example.org/s/abcdefgh_' || user_id
        WHEN k % 5 <> 0 AND k % 7 <> 0 THEN 'https://post.example.org/s?__biz=b' || user_id || '&mid=' || k || '&idx=1&sn=z'
        END AS post_url FROM v_k""")
def _(t):
    k, u = F.col("k"), F.col("user_id").cast("string")
    link = F.when(k % 3 == 0, cat("https://post.example.org:443/s/abcdefgh_", u, "?share=1")).otherwise(
        cat("https://post.example.org/s?sn=z&amp;__biz=b", u, "&amp;mid=", k.cast("string"),
            F.when(k % 5 == 0, "").otherwise("&amp;idx=1"), F.when(k % 7 == 0, "&amp;mid=2").otherwise(""),
            "&amp;track=9")
    )
    return t.v_k.select("event_id", N.post_url(link, "post.example.org").alias("post_url"))


@check("b13_feed_date", """
    SELECT event_id, CASE WHEN k % 4 = 0 THEN strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S')
        WHEN k % 4 < 3 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS feed_date FROM v_k""")
def _(t):
    k = F.col("k")
    text = F.when(k % 4 == 0, cat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), " +0200")).when(
        k % 4 == 1, cat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), " GMT")
    ).when(k % 4 == 2, cat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "Z")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    return t.v_k.select("event_id", N.feed_date(text).alias("feed_date"))


@check("b14_year_hint", """
    SELECT event_id, 2000 + k % 20 AS year_hint FROM v_k""", ints="year_hint")
def _(t):
    k = F.col("k")
    year = (2000 + k % 20).cast("string")
    text = F.when(k % 3 == 0, cat("Mind 12034 (", year, "), 1999")).when(
        k % 3 == 1, cat("pp. 120199, ", year)
    ).otherwise(cat(F.repeat(F.lit("x "), 300), year))
    return t.v_k.select("event_id", N.year_hint(text).alias("year_hint"))


@check("b15_doi_hint", """
    SELECT event_id, CASE WHEN k % 3 <> 2 THEN '10.1000/u' || user_id || CASE WHEN k % 3 = 0 THEN '(1' ELSE '' END END AS doi_hint
    FROM v_k""")
def _(t):
    k, u = F.col("k"), F.col("user_id").cast("string")
    text = F.when(k % 3 == 0, cat("in https%3A%2F%2Fdoi.org%2F10.1000%2FU", u, "%281%29. ")).when(
        k % 3 == 1, cat("<a href='http://dx.doi.org/10.1000/U", u, "'>x</a>")
    ).otherwise(cat("doi 10.1000/u", u))
    return t.v_k.select("event_id", N.doi_hint(text).alias("doi_hint"))


@check("b16_type_hint", """
    SELECT event_id, CASE k % 7 WHEN 0 THEN 'preprint' WHEN 1 THEN 'working-paper' WHEN 2 THEN 'forthcoming-article'
        WHEN 3 THEN 'author-accepted-manuscript' WHEN 4 THEN 'submitted-manuscript' WHEN 5 THEN 'manuscript' END AS type_hint
    FROM v_k""")
def _(t):
    k = F.col("k")
    text = pick(
        k % 7, "a Pre-print, manuscript", "Working Paper 7", "To appear in Mind", "Author&#39;s accepted manuscript",
        "unpublished manuscript", "old manuscript", "manuscripts",
    )
    return t.v_k.select("event_id", N.type_hint(text).alias("type_hint"))


@check("b17_explicit_review_label", """
    SELECT event_id, k % 8 IN (0, 1, 2, 3, 4) AS is_review FROM v_k""")
def _(t):
    k = F.col("k")
    title = pick(
        k % 8, "Review of Mind", "[Book review: Logic]", "Rezension zu Kant", "Compte rendu de Vrin", "书评：逻辑",
        "Reviewing the field", "Peer review of", "Logic",
    )
    return t.v_k.select("event_id", N.explicit_review_label(title).alias("is_review"))


@check("b18_canonical_type", """
    SELECT record_id,
      CASE WHEN raw_type = 'Unsafe Type!' THEN NULL ELSE raw_type END AS safe_type,
      CASE WHEN provider = 'openalex' THEN CASE raw_type WHEN 'article' THEN 'article' WHEN 'book' THEN 'book'
             WHEN 'report' THEN 'working-paper' WHEN 'other' THEN 'other' WHEN 'dataset' THEN 'dataset' END
           ELSE CASE raw_type WHEN 'journal-article' THEN 'article' WHEN 'book' THEN 'book'
             WHEN 'report' THEN 'working-paper' WHEN 'other' THEN 'other' WHEN 'dataset' THEN 'dataset' END END AS canonical_type
    FROM v_records""")
def _(t):
    return N.with_canonical_type(t.v_records).select("record_id", "safe_type", "canonical_type")


@check("b19_date_bounds", """
    SELECT record_id,
      strftime(CASE precision WHEN 'year' THEN date_trunc('year', l_shipdate) WHEN 'month' THEN date_trunc('month', l_shipdate)
            ELSE l_shipdate END, '%Y-%m-%d %H:%M:%S') AS lo,
      strftime(CASE precision WHEN 'year' THEN date_trunc('year', l_shipdate) + INTERVAL 1 YEAR
            WHEN 'month' THEN date_trunc('month', l_shipdate) + INTERVAL 1 MONTH
            ELSE l_shipdate + INTERVAL 1 DAY END, '%Y-%m-%d %H:%M:%S') AS hi
    FROM v_date_values""")
def _(t):
    bounds = N.date_bounds(F.col("value"), F.col("precision"))
    return t.v_date_values.select("record_id", bounds.alias("b")).select("record_id", "b.lo", "b.hi")


@check("b20_label_month", """
    SELECT url, CASE WHEN NOT placeholder THEN y END AS label_year, CASE WHEN NOT placeholder THEN m END AS label_month
    FROM (SELECT 'https://list.example.org/' || l_orderkey || '/' || l_linenumber AS url, CAST(year(l_shipdate) AS BIGINT) AS y,
            CAST(month(l_shipdate) AS BIGINT) AS m,
            l_partkey % 4 = 3 OR (l_partkey % 4 IN (0, 1) AND month(l_shipdate) = 1 AND day(l_shipdate) = 1) AS placeholder
          FROM lineitem)""")
def _(t):
    k = F.col("l_partkey") % 4
    text = F.when(k == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).when(
        k == 1, F.date_format("l_shipdate", "yyyy年M月d日")
    ).when(k == 2, F.date_format("l_shipdate", "yyyy年MM月")).otherwise(F.date_format("l_shipdate", "MM.yyyy"))
    url = cat("https://list.example.org/", F.col("l_orderkey").cast("string"), "/", F.col("l_linenumber").cast("string"))
    return t.lineitem.select(url.alias("url"), N.label_month(text).alias("m")).select(
        "url", F.col("m.year").alias("label_year"), F.col("m.month").alias("label_month")
    )


@check("b21_row_hash", """
    SELECT record_id, sha256(record_id || chr(31) || title || chr(31) || coalesce(doi, '')) AS row_hash,
        sha256(array_to_string(list_sort([provider, raw_type, author]), chr(30))) AS fingerprint
    FROM v_records""")
def _(t):
    return t.v_records.select(
        "record_id", N.row_hash(F.col("record_id"), F.col("title"), F.col("doi")).alias("row_hash"),
        N.evidence_fingerprint(F.array("provider", "raw_type", "author")).alias("fingerprint"),
    )


@check("b22_issue_key", """
    SELECT url, sha256(replace(lower(venue), ' ', '') || '|' || year || '|' || issue) AS issue_key,
        CASE WHEN ltrim('00' || issue, '0') = '' THEN '0' ELSE ltrim('00' || issue, '0') END AS issue_no
    FROM v_issue_records""")
def _(t):
    return t.v_issue_records.select(
        "url", N.issue_key(F.col("venue"), F.col("year"), F.col("issue")).alias("issue_key"),
        N.issue_no(cat("00", F.col("issue"))).alias("issue_no"),
    )


@check("b23_work_id", """
    SELECT record_id, CASE WHEN doi IS NOT NULL THEN 'work:doi:' || doi
        WHEN record_id % 5 = 0 THEN 'work:provider:' || sha256('W' || record_id)
        ELSE 'work:record:' || sha256('https://feed.example.org/rec/' || record_id) END AS work_id
    FROM v_records""")
def _(t):
    d = F.col("record_id")
    provider_id = F.when(d % 5 == 0, cat("W", d.cast("string")))
    return t.v_records.select(
        "record_id",
        N.work_id(F.col("doi"), provider_id, cat("https://feed.example.org/rec/", d.cast("string"))).alias("work_id"),
    )


@check("b24_first_author", """
    SELECT record_id, CASE record_id % 5 WHEN 0 THEN 'Ann ' || author WHEN 1 THEN '王小明' WHEN 2 THEN '王明'
        WHEN 3 THEN '欧阳' END AS first_author FROM v_records""")
def _(t):
    d = F.col("record_id")
    raw = F.when(d % 5 == 0, cat("Ann ", F.col("author"), "; Bob")).when(d % 5 == 1, F.lit("王 小明、李四")).when(
        d % 5 == 2, F.lit("王 明")
    ).when(d % 5 == 3, F.lit("欧阳 建国")).otherwise(F.lit(""))
    return t.v_records.select("record_id", N.first_author(raw).alias("first_author"))


@check("b25_safe_text", r"""
    SELECT record_id, regexp_replace(replace(replace(replace(trim(regexp_replace(title, '\s+', ' ', 'g')),
        '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_\[\]#])', '\\\1', 'g') AS safe_text FROM v_records""")
def _(t):
    return t.v_records.select("record_id", N.safe_text(F.col("title")).alias("safe_text"))
