"""Scalar text expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a full Unicode strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: separator between title and abstract in a paper's hash.
HASH_SEPARATOR = "|||"

# Fixed value: a label's leading characters that are neither CJK, letter nor digit.
LABEL_PREFIX = r"^[^\x{4e00}-\x{9fff}A-Za-z0-9]+"


def strip(s: Column) -> Column:
    """Remove Unicode whitespace at both ends (linear, also on long runs)."""
    return F.btrim(s, F.lit(WHITESPACE))


def is_blank(s: Column) -> Column:
    return strip(s) == ""


def _given(s: Column) -> Column:
    """A missing title or abstract is empty."""
    return F.coalesce(s, F.lit(""))


def match_text(title: Column, abstract: Column) -> Column:
    """The text patterns are searched in; the line feed stops "." at the title's end."""
    return F.concat(_given(title), F.lit("\n"), _given(abstract))


def paper_hash(title: Column, abstract: Column) -> Column:
    return F.md5(F.concat(_given(title), F.lit(HASH_SEPARATOR), _given(abstract)))


def display_label(label: Column) -> Column:
    """Label without its leading emoji or punctuation."""
    return strip(F.regexp_replace(label, LABEL_PREFIX, ""))


def pct_label(pct: Column) -> Column:
    """"12.3%" from two percent upwards, else empty; halves round to even."""
    return F.when(pct >= 2.0, F.concat(F.format_number(pct, 1), F.lit("%"))).otherwise("")


def truncate(s: Column, n: int, suffix: str = "") -> Column:
    """The first n characters, then `suffix`."""
    return F.concat(F.substring(s, 1, n), F.lit(suffix)) if suffix else F.substring(s, 1, n)


def error_snippet(raw: Column, n: int = 400) -> Column:
    """Head of a broken payload on one line."""
    return F.replace(truncate(raw, n), F.lit("\n"), F.lit(" "))
