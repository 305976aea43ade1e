"""Small text helpers as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def java_regex(pattern: str) -> str:
    r"""Make a regex written for an RE2-style engine mean the same in Java.

    Java's ``.`` and ``$`` know more line ends, its ``$`` matches before a last
    newline and its ``\s`` includes ``\x0B``.
    """
    out, in_class = [], False
    for token in re.findall(r"\\.|.", pattern, re.DOTALL):
        if token == r"\s":
            token = r" \t\n\f\r" if in_class else r"[ \t\n\f\r]"
        elif token == "[" and not in_class:
            in_class = True
        elif token == "[":
            token = r"\["
        elif token == "]":
            in_class = False
        elif token == "&" and in_class:
            token = r"\&"
        elif token == "$" and not in_class:
            token = r"\z"
        out.append(token)
    return "(?d)" + "".join(out)


def java_quote(text: str) -> str:
    """Quote a literal for use inside a Java regex."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def quote_regex(text: Column) -> Column:
    """Column form of :func:`java_quote`."""
    return F.regexp_replace(text, r"([\\.^$|?*+()\[\]{}])", r"\\$1")


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def mask(value: Column, capped: bool = True) -> Column:
    """First two and last two characters; at most 16 stars between if capped."""
    hidden = F.length(value) - 4
    stars = F.least(hidden, F.lit(16)) if capped else hidden
    shown = F.concat(
        F.substring(value, 1, 2), F.repeat(F.lit("*"), stars), F.right(value, F.lit(2))
    )
    return F.when(F.length(value) <= 4, F.lit("****")).otherwise(shown)


def fingerprint(value: Column) -> Column:
    """A stable stand-in for a raw value in outputs."""
    return F.sha2(value, 256)


def preview(value: Column, size: int = 10) -> Column:
    """Start of the raw value. Shows secret text: opt-in only."""
    return F.when(
        F.length(value) > size, F.concat(F.substring(value, 1, size), F.lit("..."))
    ).otherwise(value)


def truncate(text: Column, size: int) -> Column:
    return F.when(
        F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))
    ).otherwise(text)


def csv_escape(text: Column) -> Column:
    """``;`` to ``,``, line ends to blanks, quotes where a comma or quote is left."""
    flat = F.translate(text, ";\n\r", ",  ")
    quoted = F.concat(F.lit('"'), F.replace(flat, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(flat.contains(",") | flat.contains('"'), quoted).otherwise(flat)


def count_literal(text: Column, literal: Column) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    gone = F.length(text) - F.length(F.replace(text, literal, F.lit("")))
    return (gone / F.length(literal)).cast("int")


def bar_width(count: Column, total: Column, scale: int = 50, limit: int | None = 30) -> Column:
    width = F.floor(count * F.lit(scale) / F.greatest(total, F.lit(1)))
    if limit is not None:
        width = F.least(width, F.lit(limit))
    return width.cast("int")
