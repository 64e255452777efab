"""String functions with the Unicode behaviour that the rules need."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.functions.binding import bind

#: Unicode white space; the four separators U+001C to U+001F count as white space too.
SPACE = r"[\s\x1C-\x1F]"
ASCII_ONLY = r"\A\p{ASCII}*\z"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (trim() takes off spaces only)."""
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def collapse(c: Column) -> Column:
    """Stripped, with each run of white space as one space."""
    return F.regexp_replace(strip(c), rf"(?U){SPACE}+", " ")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _folded(lists: pd.Series) -> pd.Series:
    fold = lambda s: None if s is None else " ".join(unicodedata.normalize("NFC", s).split()).casefold()
    return lists.map(lambda row: None if row is None else [fold(s) for s in row])


def normalised(values: list[Column]) -> Column:
    """Comparison forms of several strings as one array column: NFC, white space collapsed, case folded; nulls stay.

    Only strings beyond ASCII go to Python, all of a row in one crossing; ASCII ones are folded in the JVM.
    """
    rows = F.array(*values)
    beyond = F.transform(rows, lambda s: F.when(~s.rlike(ASCII_ONLY), s))
    return F.zip_with(rows, _folded(beyond), lambda s, folded: F.coalesce(folded, F.lower(collapse(s))))


def strip_fences(c: Column) -> Column:
    """The reply without a code fence at its ends, cut to its outermost braces where it has them."""

    def cut(bare: Column) -> Column:
        first = F.instr(bare, "{")
        last = F.char_length(bare) - F.instr(F.reverse(bare), "}") + 1
        # without "}" the reversed text has no place for it either, and last is beyond the end
        has = (first > 0) & (last > first) & (last <= F.char_length(bare))
        return F.when(has, bare.substr(first, last - first + 1)).otherwise(strip(bare))

    return bind(F.regexp_replace(strip(c), r"(?iU)\A\s*```(?:json)?\s*|\s*```\s*\z", ""), cut)


def escape_html(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c
