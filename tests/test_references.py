"""Character references against the standard library's reading of them."""

import html
import random

from pyspark.sql import functions as F

from shelfmark.functions import normalise as N
from shelfmark.functions.references import unescape
from shelfmark.sources.pages import inner_text


def test_references_equal_the_library(spark):
    rng = random.Random(3)
    names = sorted(html.entities.html5)
    pieces = ["&", ";", "#", "x", "X", "amp", "lt", "not", "notit;", "&amp;lt;", "&ampgt", "39", "0", "00", "128", "1F600", "D800", "110000", "99999999999999999999", "FDD0", " ", "<", "é", "\n", "&#13;", "&#x1;"]
    texts = ["&".join(["", n, n + "b"]) for n in names]
    texts += [f"&#{k};" for k in (*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0xFFFF, 0x1F600, 0x10FFFF, 0x110000)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(4000)] + ["", "plain", "&", "a&b&"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    got = df.select("text", unescape(F.col("text")).alias("out")).collect()
    wrong = [(r.text, r.out) for r in got if r.out != (None if r.text is None else html.unescape(r.text))]
    assert wrong == []


def test_hints_and_text_resolve_all_references(spark):
    df = spark.createDataFrame([(1, "doi: <a href='https&colon;&sol;&sol;doi.org&#x2F;10.1000&#47;ab12'>", "<b>Caf&eacute&nbsp;&CounterClockwiseContourIntegral; &copy2024</b>")], "k int, d string, h string")
    row = df.select(N.doi_hint(F.col("d")).alias("doi"), inner_text(F.col("h")).alias("text")).first()
    assert (row.doi, row.text) == ("10.1000/ab12", "Café ∳ ©2024")


def test_every_name_is_found_under_its_first_letter(spark):
    from html.entities import html5

    from shelfmark.functions.references import unescape

    names = spark.createDataFrame([(n, f"a&{n} b") for n in html5 if n.endswith(";")] + [("1x;", "a&1x; b"), ("é;", "a&é; b"), ("", "a& b")], "name string, text string")
    for r in names.withColumn("got", unescape(names.text)).collect():
        assert r.got == (f"a{html5[r.name]} b" if r.name in html5 else r.text)
