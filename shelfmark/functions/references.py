"""Character references of HTML text, resolved once and from left to right.

The names are those of HTML 5.  As in browsers the ``;`` may be missing after numbers and after
the old names, of which the longest that fits counts (``&notit;`` is ``¬it;``).  Numbers of no
character give U+FFFD, those of control and reserved characters nothing; unknown names stay.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRY, VALUE = "\x1e", "\x1f"
# names without ``;``, the longest first
OLD_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
# numbers 0x80 to 0x9F are read as Windows-1252 where it has a character
WINDOWS = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")
WINDOWS = "".join(chr(0x80 + k) if c == "�" else c for k, c in enumerate(WINDOWS))


def _value(name: Column) -> Column:
    """What ``name`` stands for, or NULL.  Maps are searched key by key, so each first letter has its own."""
    maps = []
    for code in range(ord("A"), ord("z") + 1):
        own = [f"{n}{VALUE}{value}" for n, value in html5.items() if n[0] == chr(code)]
        maps.append(F.str_to_map(F.lit(ENTRY.join(own)), F.lit(ENTRY), F.lit(VALUE)))
    return F.try_element_at(F.get(F.array(*maps), F.ascii(name) - ord("A")), name)


def _numbered(digits: Column, base: int, width: int) -> Column:
    """The character of a number, given without leading zeros; more digits than ``width`` are no character."""
    code = F.conv(F.when(F.length(digits) <= width, F.when(digits == "", "0").otherwise(digits)), base, 10).cast("int")
    none = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    control = (code.between(1, 0x1F) & ~code.isin(9, 10, 12, 13)) | (code == 0x7F)
    reserved = code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    encoded = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when(none, "�").when(code.between(0x80, 0x9F), F.substring(F.lit(WINDOWS), code - 0x7F, F.lit(1)))
        .when(control | reserved, "").otherwise(encoded)
    )


def _resolved(part: Column) -> Column:
    """Text that followed an ampersand, with its reference resolved."""

    def rest(found: Column) -> Column:
        return F.substr(part, F.length(found) + 1)

    number, hexed = F.regexp_extract(part, "^#[0-9]+;?", 0), F.regexp_extract(part, "^#[xX][0-9a-fA-F]+;?", 0)
    name = F.regexp_extract(part, r"^[^\t\n\f <&#;]{1,32};?", 0)
    old = F.regexp_extract(part, f"^(?:{'|'.join(OLD_NAMES)})", 0)
    of_name = _value(name)
    return (
        F.when(number != "", F.concat(_numbered(F.regexp_extract(part, "^#0*([0-9]*)", 1), 10, 7), rest(number)))
        .when(hexed != "", F.concat(_numbered(F.regexp_extract(part, "^#[xX]0*([0-9a-fA-F]*)", 1), 16, 6), rest(hexed)))
        .when(of_name.isNotNull(), F.concat(of_name, rest(name)))
        .when(old != "", F.concat(_value(old), rest(old)))
        .otherwise(F.concat(F.lit("&"), part))
    )


def unescape(column: Column) -> Column:
    """``column`` with its character references resolved; NULL stays NULL."""
    parts = F.split(column, "&")
    resolved = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), _resolved)
    return F.when(column.contains("&"), F.concat(parts[0], F.array_join(resolved, ""))).otherwise(column)
