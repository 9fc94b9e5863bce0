"""Text column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space characters of Unicode plus the four information separators, as
# a character set for trimming and as a regular expression class.
WHITE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# Single characters below 256 become one table look-up in Java; the others are asked for only
# between the least and the greatest of them.
WHITE = (r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
         r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]")

# Control characters that make a text file binary: all below 32 except tab and line feed, and
# 127 to 159.
DISALLOWED_CONTROL = r"[\x00-\x08\x0b-\x1f\x7f-\x9f]"
ANY_CONTROL = r"[\x00-\x1f]"


def strip(col: Column) -> Column:
    """Trim all white space, not only blanks, from both ends; touches only the ends."""
    return F.btrim(col, F.lit(WHITE_CHARS))


def strip_line(col: Column) -> Column:
    """``strip`` of a column that costs nothing to read again, such as a field.

    Trimming a set of characters looks through the whole set at both ends; a text that begins and
    ends with visible ASCII needs none. Bytes are found at once, characters by counting.
    """
    def visible(at: int) -> Column:
        return F.substring(col.cast("binary"), at, 1).between(F.lit(b"!"), F.lit(b"~"))

    return F.when(visible(1) & visible(-1), col).otherwise(strip(col))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(WHITE_CHARS))


def is_blank(col: Column) -> Column:
    return F.ltrim(col, F.lit(WHITE_CHARS)) == ""


def squeeze_case(col: Column) -> Column:
    """Drop all white space and lower-case: the identity used to compare questions."""
    return F.lower(F.regexp_replace(col, WHITE, ""))


def escape_markup(col: Column) -> Column:
    """Escape ``& < > " '`` in that order, so text cannot close a prompt tag."""
    # The five escapes of the HTML standard as Python's html module writes them.
    for raw, safe in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#x27;"),
    ):
        col = F.replace(col, F.lit(raw), F.lit(safe))
    return col


def sha256_hex(col: Column) -> Column:
    return F.sha2(col, 256)


def ordered_text(items: Column, separator: str) -> Column:
    """Join ``array<struct<position, text>>`` by position."""
    return F.array_join(F.transform(F.array_sort(items), lambda s: s["text"]), separator)
