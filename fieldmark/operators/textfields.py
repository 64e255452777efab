"""Labelled values in plain text, with fallbacks, and the confidence of the words that make up a value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.binding import bind

#: A word boundary between ASCII word characters only; Java's \b counts accented letters as well.
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_TRIM = r"(?U)\A[\s﻿]+|[\s﻿]+\z"

# Keys in order and their patterns (case doesn't count; the first group is the value).
LABELS = (
    ("Name", rf"{_B}(?:full\s*name|name){_E}\s*[:.\-]\s*(.+)"),
    ("ID number", rf"{_B}(?:id|civil|national)\s*(?:(?:no|number){_E}|#(?=[A-Za-z0-9_]))\s*[:.\-]\s*([A-Z0-9\-]{{5,}})"),
    ("Passport no", rf"{_B}(?:passport)(?:\s*(?:(?:no|number){_E}|#(?=[A-Za-z0-9_]))|{_E})\s*[:.\-]\s*([A-Z0-9]{{6,}})"),
    ("Date of birth", rf"{_B}(?:date\s*of\s*birth|dob|birth){_E}\s*[:.\-]\s*(.+)"),
    ("Expiry date", rf"{_B}(?:expiry|expires|expiration|valid\s*until){_E}\s*[:.\-]\s*(.+)"),
    ("Nationality", rf"{_B}(?:nationality|citizenship){_E}\s*[:.\-]\s*(.+)"),
    ("Sex", rf"{_B}(?:sex|gender){_E}\s*[:.\-]\s*([A-Za-z]+)"),
    ("Reference", rf"{_B}(?:invoice|ref|reference)(?:\s*(?:(?:no|number){_E}|#(?=[A-Za-z0-9_]))|{_E})\s*[:.\-]\s*([A-Z0-9\-\/]{{3,}})"),
    ("Total", rf"{_B}(?:total|amount\s*due){_E}\s*[:.\-]?\s*([A-Z]{{0,3}}\s?[\d,.]+)"),
)
#: One of a label's words, in lower case, is in every line that its pattern fits.
WORDS_OF = {
    "Name": ("name",), "ID number": ("id", "civil", "national"), "Passport no": ("passport",), "Date of birth": ("birth", "dob"), "Expiry date": ("expir", "valid"),
    "Nationality": ("nationality", "citizenship"), "Sex": ("sex", "gender"), "Reference": ("invoice", "ref"), "Total": ("total", "amount"),
}
LABEL_WORDS = tuple(w for words in WORDS_OF.values() for w in words)
DATE = rf"(?=\d){_B}\d{{1,2}}[/\-.]\d{{1,2}}[/\-.]\d{{2,4}}{_E}"
LONG_NUMBER = rf"(?=\d){_B}\d{{7,14}}{_E}"
MACHINE_LINE = r"[A-Z0-9<]{25,}"
CAPITALS = r"\A[A-Z][A-Z\s'\-]{7,}\z"
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]{2,}"


def trimmed(c: Column) -> Column:
    """Without white space at both ends; the pattern runs only where an end isn't a visible ASCII character."""
    visible = lambda x: F.ascii(x).between(33, 126)
    return bind(c, lambda x: F.when(visible(x) & visible(F.right(x, F.lit(1))), x).otherwise(F.regexp_replace(x, _TRIM, "")))


def raw_lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def lines_of(text: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(raw_lines(text), trimmed), lambda x: x != "")


def _has(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def _labelled(text: Column, words: tuple[str, ...]) -> Column:
    """(line, text, low: in lower case) of the lines, trimmed, that have one of the words."""
    row = lambda line, i: bind(F.lower(line), lambda low: F.when(_has(low, words), F.struct(i.alias("line"), trimmed(line).alias("text"), low.alias("low"))))
    return F.array_compact(F.transform(raw_lines(text), row))


def _value(row: Column, label: str) -> Column:
    """The value that a labelled line has of a label; empty or null where it has none. The pattern runs over lines with its words only."""
    return F.when(_has(row["low"], WORDS_OF[label]), trimmed(F.regexp_extract(row["text"], f"(?i){dict(LABELS)[label]}", 1)))


def first_label(text: Column, label: str) -> Column:
    """The value of a label's first line that has one, or null."""
    return F.get(F.filter(F.transform(_labelled(text, WORDS_OF[label]), lambda x: _value(x, label)), lambda x: x != ""), F.lit(0))


def first_of(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def dates_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DATE), F.lit(0))


def capitals_line(lines: Column) -> Column:
    """The first line of capitals; most lines begin with none or have small letters, and don't meet the pattern."""
    return F.get(F.filter(lines, lambda x: F.ascii(x).between(65, 90) & (F.upper(x) == x) & x.rlike(CAPITALS)), F.lit(0))


def extract_text_fields(df: DataFrame, text: str = "text", fallbacks: bool = True) -> DataFrame:
    """df with ``found``: array of (key, value), labels in the order in which lines have them, then the fallbacks if wanted.

    The first value of a key counts, so each key is sought once and ranked by its first line; nothing is shuffled. The
    labels' patterns run over the few lines that have a label's word.
    """
    said = F.col(text)
    df = df.withColumn("_labelled", _labelled(said, LABEL_WORDS))
    # (line, label) of the first value of each key, to bring keys into the order of the text
    def labelled(k: int, label: str) -> Column:
        hits = F.transform("_labelled", lambda x: F.struct(x["line"].alias("line"), F.lit(k).alias("label"), _value(x, label).alias("value")))
        return F.get(F.filter(hits, lambda h: h["value"] != ""), F.lit(0))

    found = F.array_sort(F.array_compact(F.array(*[labelled(k, label) for k, (label, _) in enumerate(LABELS)])))
    names = F.array(*[F.lit(n) for n, _ in LABELS])
    by_label = F.transform(found, lambda h: F.struct(names[h["label"]].alias("key"), h["value"].alias("value")))
    if not fallbacks:
        return df.withColumn("found", by_label).drop("_labelled")
    dates = F.col("_dates")
    df = df.withColumn("_dates", dates_of(said))
    rest = [("Date found", F.get(dates, F.lit(0))), ("Date found (2)", F.get(dates, F.lit(1))), ("Number", first_of(said, LONG_NUMBER)), ("Machine-readable line", first_of(said, MACHINE_LINE)), ("Name (uncertain)", capitals_line(lines_of(said))), ("Email", first_of(F.when(said.contains("@"), said), EMAIL))]
    given = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in rest])
    return df.withColumn("found", F.concat(by_label, F.filter(given, lambda f: f["value"].isNotNull()))).drop("_labelled", "_dates")


def label_rows(found: DataFrame, *keys: str) -> DataFrame:
    """keys, ordinal, key and value of everything found, in its order.

    The outer form, then a test: the plain one would test the size of the array first, and the optimiser would copy
    all of the patterns into that test.
    """
    rows = found.select(*keys, F.posexplode_outer("found").alias("ordinal", "f")).where("f IS NOT NULL")
    return rows.select(*keys, "ordinal", "f.key", "f.value")


def value_tokens(value: Column) -> Column:
    return F.filter(F.split(F.upper(value), r"(?U)\s+"), lambda t: t != "")


def word_token(word: Column) -> Column:
    return F.regexp_replace(F.upper(word), r"[^\w<@.\-/]", "")


#: Stands between words that are cleaned together.
_BETWEEN = "\x00"


def word_tokens(words: Column) -> Column:
    """word_token of each of an array's texts, by one pass over all of them; one by one where they hold the mark between words or nulls."""
    at_once = F.split(F.regexp_replace(F.upper(F.array_join(words["text"], _BETWEEN)), rf"[^\w<@.\-/{_BETWEEN}]", ""), _BETWEEN)
    return bind(at_once, lambda t: F.when(F.size(t) == F.size(words), t).otherwise(F.transform(words["text"], word_token)))


def _mean(words: Column) -> Column:
    return F.try_divide(F.aggregate(words, F.lit(0.0), lambda s, w: s + w["confidence"]), F.size(words))


def value_confidence(value: Column, words: Column) -> Column:
    """The mean confidence of the words (array of text, confidence) that occur in the value; null without any."""
    hits = lambda tokens, mine: F.filter(words, lambda w, i: F.array_contains(tokens, F.get(mine, i)))
    return F.when(value.isNotNull(), bind(value_tokens(value), lambda tokens: bind(word_tokens(words), lambda mine: bind(hits(tokens, mine), _mean))))


def mean_confidence(words: Column) -> Column:
    """The rounded mean over all words; null without any."""
    return F.floor(_mean(words) + 0.5).cast("int")


def export_json(found: Column, words: Column, elapsed_ms: Column) -> Column:
    """{fields: {key: value}, meanConfidence (0 without words), wordCount, elapsedMs} as JSON."""
    fields = F.map_from_entries(F.transform(found, lambda f: F.struct(f["key"], f["value"])))
    row = F.struct(fields.alias("fields"), F.coalesce(mean_confidence(words), F.lit(0)).alias("meanConfidence"), F.size(words).alias("wordCount"), elapsed_ms.alias("elapsedMs"))
    return F.to_json(row, {"ignoreNullFields": "false"})
