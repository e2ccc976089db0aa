"""Column expressions that normalise record fields.

All are built-in expressions except the two Unicode folds, whose Arrow
function only receives the strings that are not plain ASCII.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from shelfmark import vocab
from shelfmark.functions.references import unescape


@pandas_udf(StringType())
def _compatible_lower(values: pd.Series) -> pd.Series:
    if values.isna().all():
        return values
    return values.map(lambda v: unicodedata.normalize("NFKC", v).casefold(), na_action="ignore")


@pandas_udf(StringType())
def _without_marks(values: pd.Series) -> pd.Series:
    def strip(value: str) -> str:
        parts = unicodedata.normalize("NFKD", value.casefold())
        bare = "".join(c for c in parts if not unicodedata.combining(c))
        return unicodedata.normalize("NFKC", bare).casefold()

    if values.isna().all():
        return values
    return values.map(strip, na_action="ignore")


def _mostly_builtin(column: Column, rest) -> Column:
    plain = F.octet_length(column) == F.char_length(column)  # a byte per character: ASCII, without a pattern
    return F.when(plain, F.lower(column)).otherwise(rest(F.when(~plain, column)))


def casefold(column: Column) -> Column:
    """NFKC and full case folding."""
    return _mostly_builtin(column, _compatible_lower)


def _words(column: Column) -> Column:
    spaced = F.replace(column, F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(spaced, r"[^\p{L}\p{N}]+", " "))


def doi_norm(column: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.trim(column), vocab.DOI_PREFIX, ""))
    bare = F.regexp_replace(F.lower(bare), r"[.,;)]+$", "")
    return F.when(bare.rlike(vocab.DOI_SHAPE), bare)


def title_norm(column: Column) -> Column:
    return _words(casefold(column))


def title_fold(column: Column) -> Column:
    """``title_norm`` without accents."""
    return _words(_mostly_builtin(column, _without_marks))


def compact(column: Column) -> Column:
    return F.regexp_replace(casefold(column), r"[^\p{L}\p{N}]", "")


def same_text(left: Column, right: Column) -> Column:
    """Equality of two ``compact`` values, never true for empty text."""
    return (left == right) & (left != "")


def term_norm(column: Column) -> Column:
    return F.regexp_replace(casefold(column), r"(?U)\s+", "")


def words_of(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda w: w != "")


def content_tokens(folded: Column) -> Column:
    """Sorted distinct content words of a folded title."""
    stops = F.array(*[F.lit(w) for w in vocab.TITLE_STOPWORDS])
    return F.array_sort(F.array_except(words_of(folded), stops))


# Script name -> letter class.
SCRIPTS = [
    ("LATIN", r"\p{IsLatin}"), ("GREEK", r"\p{IsGreek}"), ("CYRILLIC", r"\p{IsCyrillic}"),
    ("CJK", r"\p{IsHan}"), ("HIRAGANA", r"\p{IsHiragana}"), ("KATAKANA", r"\p{IsKatakana}"),
]


def script_families(column: Column) -> Column:
    named = [F.when(column.rlike(shape), F.lit(name)) for name, shape in SCRIPTS]
    known = "".join(shape for _, shape in SCRIPTS)
    other = F.when(column.rlike(rf"[\p{{L}}&&[^{known}]]"), F.lit("OTHER"))
    return F.array_sort(F.array_compact(F.array(*named, other)))


def author_keys(column: Column) -> Column:
    """Struct of sorted distinct name words, surname and first initial.

    ``Surname, Given`` takes the last word before the comma as surname; other
    forms take the last word.  Blank names give a NULL struct.
    """
    column = F.translate(column, "，﹐︐", ",,,")  # other forms of the comma
    words = words_of(title_fold(column))
    before = words_of(title_fold(F.substring_index(column, ",", 1)))
    has_comma = column.contains(",")
    surname = F.when(has_comma, F.try_element_at(before, F.lit(-1))).otherwise(
        F.try_element_at(words, F.lit(-1))
    )
    given = F.when(
        has_comma, F.slice(words, F.size(before) + 1, F.greatest(F.size(words), F.lit(1)))
    ).otherwise(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))
    initial = F.left(F.try_element_at(given, F.lit(1)), F.lit(1))
    return F.when(
        F.size(words) > 0,
        F.struct(
            F.array_join(F.array_sort(F.array_distinct(words)), " ").alias("name_words"),
            F.coalesce(surname, F.lit("")).alias("surname"),
            F.coalesce(initial, F.lit("")).alias("initial"),
        ),
    )


def split_display(column: Column) -> Column:
    """``Surname, Given: Title`` -> struct(author, title)."""
    author = F.substring_index(column, ": ", 1)
    title = F.trim(F.substr(column, F.length(author) + 3))
    splits = column.contains(": ") & author.contains(",") & (title != "")
    return F.struct(
        F.when(splits, F.trim(author)).alias("author"),
        F.when(splits, title).otherwise(F.trim(column)).alias("title"),
    )


def record_url(column: Column, hosts: list[str], canonical_host: str) -> Column:
    """Canonical https record URL on an allowed host, else NULL."""
    value = F.trim(column)
    host = F.lower(F.try_parse_url(value, F.lit("HOST")))
    route = F.try_parse_url(value, F.lit("PATH"))
    scheme = F.lower(F.try_parse_url(value, F.lit("PROTOCOL")))
    allowed = (scheme == "https") & host.isin(hosts) & route.rlike(vocab.RECORD_PATH)
    return F.when(
        allowed, F.concat(F.lit(f"https://{canonical_host}"), F.regexp_replace(route, "/+$", ""))
    )


def record_key(column: Column) -> Column:
    """Lower-case key after ``/rec/`` of an identifier or URL, else NULL."""
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(column, r"\+", "%2B")), column)
    key = F.lower(F.trim(F.regexp_extract(F.trim(decoded), r"(?i)/rec/([^/?#]+)", 1)))
    return F.when(key != "", key)


def first_record_key(identifier: Column, others: Column) -> Column:
    """Key of the header identifier, else of the first other identifier with one."""
    keys = F.filter(F.transform(others, record_key), lambda k: k.isNotNull())
    return F.coalesce(record_key(identifier), F.try_element_at(keys, F.lit(1)))


def post_url(column: Column, host: str) -> Column:
    """Direct https post URL on ``host``; query links keep only their four identifiers."""
    value = F.trim(F.regexp_replace(column, "&amp;", "&"))
    route = F.try_parse_url(value, F.lit("PATH"))
    query = F.try_parse_url(value, F.lit("QUERY"))
    port_free = F.regexp_replace(F.lower(F.try_parse_url(value, F.lit("AUTHORITY"))), ":443$", "")
    direct = (F.try_parse_url(value, F.lit("PROTOCOL")) == "https") & (port_free == host)
    names = ["__biz", "mid", "idx", "sn"]
    pieces, complete = [], F.lit(True)
    for name in names:
        found = F.regexp_extract_all(query, F.lit(rf"(?:^|&){name}=([^&]+)"), F.lit(1))
        complete = complete & (F.size(found) == 1)
        pieces.append(F.concat(F.lit(f"{name}="), F.try_element_at(found, F.lit(1))))
    return F.when(
        direct & route.rlike(r"^/s/[A-Za-z0-9_-]{8,}$"),
        F.concat(F.lit(f"https://{host}"), route),
    ).when(
        direct & (route == "/s") & query.isNotNull() & complete,
        F.concat(F.lit(f"https://{host}/s?"), F.concat_ws("&", *pieces)),
    )


# Accepted feed date spellings; all carry a zone.
FEED_DATE_FORMATS = [
    "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd HH:mm:ssXXX",
]


def feed_date(column: Column) -> Column:
    """RFC 822 or ISO text with a zone -> UTC instant, else NULL."""
    value = F.regexp_replace(F.trim(column), r"^[A-Za-z]{3},\s*", "")
    value = F.regexp_replace(value, r"\s+(?:GMT|UTC|UT)$", " +0000")
    tries = [F.try_to_timestamp(value, F.lit(fmt)) for fmt in FEED_DATE_FORMATS]
    return utc_ntz(F.coalesce(*tries))


def utc_ntz(instant: Column) -> Column:
    """TIMESTAMP -> TIMESTAMP_NTZ holding UTC, whatever the session zone."""
    local = instant.cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)


def year_hint(column: Column) -> Column:
    found = F.regexp_extract(column, vocab.YEAR_SHAPE, 0)
    return F.when(found != "", found.cast("int"))


def doi_hint(column: Column) -> Column:
    text = unescape(column)
    text = F.coalesce(F.try_url_decode(F.regexp_replace(text, r"\+", "%2B")), text)
    return doi_norm(F.regexp_extract(text, vocab.DOI_LINK, 0))


def type_hint(column: Column) -> Column:
    text = unescape(column)
    return F.coalesce(*[F.when(text.rlike(shape), F.lit(kind)) for kind, shape in vocab.TYPE_PHRASES])


def explicit_review_label(title: Column) -> Column:
    return title.rlike(vocab.REVIEW_PREFIX)


def safe_raw_type(provider: Column, raw: Column) -> Column:
    """Controlled type text of a provider, or NULL when it is not one."""
    value = F.regexp_replace(F.lower(F.trim(raw)), "_", "-")
    value = F.when(
        provider == "change-log", F.regexp_replace(value, "^info:eu-repo/semantics/", "")
    ).otherwise(value)
    return F.when(value.rlike(vocab.SAFE_TYPE), value)


def type_map(spark) -> DataFrame:
    """The fixed provider vocabulary as a table of fewer than a hundred rows."""
    rows = [(p, raw, kind) for p, kinds in vocab.TYPE_MAP.items() for raw, kind in kinds.items()]
    return spark.createDataFrame(rows, "provider string, safe_type string, canonical_type string")


def with_canonical_type(df: DataFrame, provider: str = "provider", raw: str = "raw_type") -> DataFrame:
    """Add ``safe_type`` and ``canonical_type``; unknown labels stay NULL.

    The vocabulary has a fixed size, so its broadcast cannot grow with the data.
    """
    kinds = type_map(df.sparkSession).withColumnRenamed("provider", "_provider").withColumnRenamed(
        "safe_type", "_safe"
    )
    safe = safe_raw_type(F.col(provider), F.col(raw))
    return (
        df.withColumn("safe_type", safe)
        .join(
            F.broadcast(kinds),
            (F.col(provider) == F.col("_provider")) & (F.col("safe_type") == F.col("_safe")),
            "left",
        )
        .drop("_provider", "_safe")
    )


def date_bounds(value: Column, precision: Column) -> Column:
    """Half-open UTC interval ``[lo, hi)`` that a dated text can mean."""
    year = F.left(value, F.lit(4)).cast("int")
    month = F.substring(value, 6, 2).cast("int")
    first = F.when(precision == "year", F.make_date(year, F.lit(1), F.lit(1))).when(
        precision == "month", F.make_date(year, month, F.lit(1))
    ).when(precision == "day", F.left(value, F.lit(10)).cast("date"))
    last = F.when(precision == "year", F.add_months(first, 12)).when(
        precision == "month", F.add_months(first, 1)
    ).when(precision == "day", F.date_add(first, 1))
    instant = F.when(
        precision == "second", F.left(F.regexp_replace(value, "T", " "), F.lit(19)).cast("timestamp_ntz")
    )
    return F.struct(
        F.coalesce(first.cast("timestamp_ntz"), instant).alias("lo"),
        F.coalesce(
            last.cast("timestamp_ntz"), instant + F.expr("INTERVAL 1 SECOND")
        ).alias("hi"),
    )


def label_month(column: Column) -> Column:
    """struct(year, month) of a source date label; 1 January is a placeholder."""
    value = F.regexp_replace(F.regexp_replace(F.trim(column), "[年月]", "-"), "日", "")
    value = F.regexp_replace(value, "-+$", "")
    shape = (
        r"^((?:19|20)[0-9]{2})[-/](0?[1-9]|1[0-2])"
        r"(?:[-/]([0-9]{1,2})(?:[ T][0-9]{2}:[0-9]{2}(?::[0-9]{2})?Z?)?)?$"
    )
    year = F.regexp_extract(value, shape, 1)
    month = F.regexp_extract(value, shape, 2)
    day = F.regexp_extract(value, shape, 3)
    real = F.try_to_timestamp(
        F.concat_ws("-", year, month, F.when(day == "", F.lit("1")).otherwise(day)),
        F.lit("yyyy-M-d"),
    ).isNotNull()
    placeholder = (month.cast("int") == 1) & (day != "") & (day.cast("int") == 1)
    keep = (year != "") & real & ~placeholder
    return F.when(
        keep, F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"))
    )


def row_hash(*parts: Column) -> Column:
    """sha256 over unit-separated parts; NULL parts count as empty text."""
    filled = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("\x1f", *filled), 256)


def evidence_fingerprint(items: Column) -> Column:
    """sha256 of an array of evidence texts in sorted order."""
    return F.sha2(F.array_join(F.array_sort(items), "\x1e"), 256)


def issue_no(column: Column) -> Column:
    bare = F.regexp_replace(column, "^0+", "")
    return F.when(bare == "", F.lit("0")).otherwise(bare)


def venue_key(venue: Column) -> Column:
    return F.regexp_replace(casefold(venue), r"(?U)\s+", "")


def issue_key(venue: Column, year: Column, issue: Column) -> Column:
    return F.sha2(F.concat_ws("|", venue_key(venue), year.cast("string"), issue), 256)


def work_id(doi: Column, provider_id: Column, url: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("work:doi:"), doi),
        F.concat(F.lit("work:provider:"), F.sha2(provider_id, 256)),
        F.concat(F.lit("work:record:"), F.sha2(url, 256)),
    )


def first_author(column: Column) -> Column:
    """First name of a delimited list; a spaced two-part CJK name is re-joined."""
    first = F.trim(F.element_at(F.split(column, "[;；、,，]+", 2), 1))
    parts = F.split(first, r"\s+")
    cjk = F.forall(parts, lambda p: p.rlike(r"^[㐀-鿿]+$"))
    joined = F.array_join(parts, "")
    short = (F.length(joined) <= 4) & F.exists(parts, lambda p: F.length(p) == 1)
    spaced = (F.size(parts) > 1) & (F.size(parts) <= 3) & cjk
    return F.when(
        (column != "") & spaced, F.when(short, joined).otherwise(F.element_at(parts, 1))
    ).when(column != "", first)


def safe_text(column: Column) -> Column:
    """One inert line of Markdown text."""
    line = F.trim(F.regexp_replace(column, r"(?U)\s+", " "))
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        line = F.replace(line, F.lit(raw), F.lit(escaped))
    return F.regexp_replace(line, r"([\\`*_\[\]#])", r"\\$1")


def normalise_records(df: DataFrame) -> DataFrame:
    """Add the comparison columns of a bibliography table.

    Needs ``title``, ``author``, ``doi``; adds ``doi_norm``, ``title_norm``,
    ``title_fold``, ``content_tokens``, ``scripts`` and ``author_keys``.
    """
    return (
        df.withColumn("doi_norm", doi_norm(F.col("doi")))
        .withColumn("title_norm", title_norm(F.col("title")))
        .withColumn("title_fold", title_fold(F.col("title")))
        .withColumn("content_tokens", content_tokens(F.col("title_fold")))
        .withColumn("scripts", script_families(F.col("title")))
        .withColumn("author_keys", author_keys(F.col("author")))
    )


def extract_hints(df: DataFrame, description: str = "description") -> DataFrame:
    """Add the hints a feed description gives before any look-up."""
    text = F.col(description)
    return (
        df.withColumn("year_hint", year_hint(text))
        .withColumn("doi_hint", doi_hint(text))
        .withColumn("type_hint", type_hint(text))
    )


def canonicalise_urls(df: DataFrame, column: str, hosts: list[str], canonical_host: str) -> DataFrame:
    """Add ``record_url`` (NULL where the link is not an allowed record) and ``record_key``."""
    return df.withColumn("record_url", record_url(F.col(column), hosts, canonical_host)).withColumn(
        "record_key", record_key(F.col(column))
    )
