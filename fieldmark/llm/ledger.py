r"""Quality rules as a ledger: every rule is evaluated once, and policies and their ablations are read off bits.

``measured`` counts what the rules need in one pass over whole texts. ``ledger`` adds ``bits``: bit r is set where rule r
fails. A policy is a mask of rules that each reject, and a mask of which so many may fail; ``judged`` applies versions of
it to a ledger without a look at texts, and ``ablations`` tells, in one aggregate over bits, what each policy would keep
without each of its rules. A ledger is meant to be written: a new policy costs a scan of one column.

Words are runs of characters other than space and tab to carriage return, as they are written. Repeated passages are
found exactly: words become numbers, runs of two, four and eight words pairs of numbers, so that equal runs have equal
numbers; no text is compared by a hash alone.

Defined cases: a null text has no words, as an empty one; a document without words fails the rules on too few words and
no other, since shares of nothing are no failure; rows without an id and repeated rows are judged like all others, each
by itself; a text of any length is read whole, in a batch of its own if need be; an empty table gives an empty ledger;
further columns are ignored unless they are asked for (``keep``), and those named like a measurement can't be.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import map_rows

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: What is counted of a text, in order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_letters", "n_capitals", "longest_word")


@dataclass(frozen=True)
class Rule:
    """A failure as a condition on measurements; ``bit`` is its place in the ledger for ever."""

    bit: int
    name: str
    fails: Callable[[], Column]
    said: str


def _more(part: str, percent: int, whole: str) -> Callable[[], Column]:
    return lambda: 100 * F.col(part) > percent * F.col(whole)


RULES = (
    Rule(0, "few_words", lambda: F.col("n_words") < 20, "fewer than 20 words"),
    Rule(1, "repeated_words", _more("n_repeat_words", 30, "n_words"), "over 30 percent of words in runs of eight that occur again"),
    Rule(2, "symbols", _more("n_symbols", 20, "n_words"), "more than a symbol for five words"),
    Rule(3, "repeated_lines", _more("n_dup_lines", 30, "n_lines"), "over 30 percent of lines seen before"),
    Rule(4, "letterless", lambda: 100 * F.col("n_letter_words") < 75 * F.col("n_words"), "under 75 percent of words have a letter"),
    Rule(5, "capitals", _more("n_capitals", 30, "n_letters"), "over 30 percent of letters are capitals"),
    Rule(6, "short_words", lambda: F.col("word_chars") < 3 * F.col("n_words"), "words of under 3 characters in the mean"),
    Rule(7, "long_words", lambda: F.col("word_chars") > 12 * F.col("n_words"), "words of over 12 characters in the mean"),
    Rule(8, "endless_word", lambda: F.col("longest_word") > 200, "a word of over 200 characters"),
)


def mask(*names: str, rules: tuple = RULES) -> int:
    known = {r.name: 1 << r.bit for r in rules}
    return sum(known[n] for n in names)


@dataclass(frozen=True)
class Policy:
    """A version: rules that reject by themselves, and rules of which ``allowed`` may fail."""

    version: str
    rejects: int
    counted: int = 0
    allowed: int = 0

    def keeps(self, bits: Column) -> Column:
        return (bits.bitwiseAND(F.lit(self.rejects)) == 0) & (F.bit_count(bits.bitwiseAND(F.lit(self.counted))) <= self.allowed)

    def rules(self) -> int:
        return self.rejects | self.counted


BASE = mask("few_words", "repeated_words")
#: Versions in the order of their making; the last is in force.
POLICIES = (
    Policy("base", BASE),
    Policy("lines", BASE | mask("symbols", "repeated_lines")),
    Policy("full", BASE | mask("symbols", "repeated_lines", "letterless", "capitals"), mask("short_words", "long_words", "endless_word"), 1),
)


def _equal_runs(codes: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the runs of so many codes (a power of two) at each place where one begins; equal runs, equal numbers."""
    done = 1
    while done < length and len(codes) > done:
        pairs = codes[:-done].astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes[done:]
        codes, done = pd.factorize(pairs)[0], 2 * done
    return codes if done == length else codes[:0]


def repeated_words(codes: np.ndarray, owner: np.ndarray, texts: int, window: int = WINDOW) -> np.ndarray:
    """By text: the words in windows that the text has twice or more. codes, owner: of each word, texts in turn."""
    runs = _equal_runs(codes, window)
    starts = np.flatnonzero(owner[: len(runs)] == owner[window - 1 :]) if len(runs) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(texts, np.int64)
    own = owner[starts].astype(np.int64) * (int(runs.max()) + 1) + runs[starts]
    which = pd.factorize(own)[0]
    again = starts[np.bincount(which)[which] > 1]
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=texts)


def measure_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text."""
    texts = pc.fill_null(texts, "")
    n = len(texts)

    def by_text(owner: np.ndarray, of=None) -> np.ndarray:
        return np.bincount(owner, weights=of, minlength=n).astype(np.int64)

    def counted(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)

    split = pc.ascii_split_whitespace(texts)
    owner, words = pc.list_parent_indices(split).to_numpy(zero_copy_only=False), split.flatten()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    owner, words = owner[real], words.filter(pa.array(real))
    length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner, length)

    parts = pc.split_pattern(texts, "\n")
    line_owner, lines = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False), parts.flatten()
    said = pc.match_substring_regex(lines, NOT_SPACE).to_numpy(zero_copy_only=False)
    line_owner, lines = line_owner[said], lines.filter(pa.array(said))
    line_codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own_lines = pd.Series(line_owner.astype(np.int64) * (int(line_codes.max(initial=0)) + 1) + line_codes)
    has_letter = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False)
    found = (
        by_text(owner), by_text(owner, length), counted(SYMBOLS), by_text(line_owner), by_text(line_owner[own_lines.duplicated().to_numpy()]), repeated_words(codes, owner, n),
        by_text(owner[has_letter]), counted(r"\p{L}"), counted(r"\p{Lu}"), longest,
    )
    return dict(zip(MEASURES, found))


def measured(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns and the measurements of every row's whole text."""
    if clash := {*keep} & {*MEASURES, "doc_id", "text"}:
        raise ValueError(f"columns that the ledger has itself can't be kept: {', '.join(sorted(clash))}")
    names = ["doc_id", *keep]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", " + ", ".join(f"{m} long" for m in MEASURES)
    work = lambda batch: {c: batch.column(c) for c in names} | measure_texts(batch.column("text"))
    return map_rows(docs, [*names, "text"], schema, lambda: work, text="text", rows=10_000, most_bytes=8 << 20)


def ledger(docs: DataFrame, rules: tuple = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """measured() with ``bits`` of the rules that fail."""
    if len({r.bit for r in rules}) < len(rules) or not all(0 <= r.bit < 63 for r in rules):
        raise ValueError("each rule needs a bit of its own from 0 to 62")
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(r.fails(), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured(docs, keep).withColumn("bits", bits)


def judged(book: DataFrame, policies: tuple = POLICIES) -> DataFrame:
    """A ledger with a column kept_<version> for each policy."""
    return book.withColumns({f"kept_{p.version}": p.keeps(F.col("bits")) for p in policies})


def reasons(bits: Column, rules: tuple = RULES) -> Column:
    """The names of the rules whose bits are set."""
    return F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(1 << r.bit)) != 0, r.name) for r in rules]))


def ablations(book: DataFrame, policies: tuple = POLICIES, rules: tuple = RULES) -> DataFrame:
    """version, rule, n_rows, n_failed, n_kept, n_kept_without: for each policy and each of its rules; no rows of an empty ledger are none kept.

    One aggregate over bits with partial sums in each task; its one row is then unfolded.
    """
    bits, one, sums, rows = F.col("bits"), F.lit(1).cast("long"), [], []
    count = lambda condition: F.count_if(condition)
    for r in rules:
        sums.append(count(bits.bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"failed_{r.bit}"))
    for p in policies:
        sums.append(count(p.keeps(bits)).alias(f"kept_{p.version}"))
        for r in rules:
            if p.rules() >> r.bit & 1:
                sums.append(count(p.keeps(bits.bitwiseAND(F.lit(~(1 << r.bit)).cast("long")))).alias(f"without_{p.version}_{r.bit}"))
                rows.append(F.struct(F.lit(p.version).alias("version"), F.lit(r.name).alias("rule"), F.col("n_rows"), F.col(f"failed_{r.bit}").alias("n_failed"), F.col(f"kept_{p.version}").alias("n_kept"), F.col(f"without_{p.version}_{r.bit}").alias("n_kept_without")))
    return book.agg(F.count(one).alias("n_rows"), *sums).select(F.inline(F.array(*rows)))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the contract, whether the base rules fail and whether the policy in force keeps the row."""
    bits = F.col("bits")
    failed = bits.bitwiseAND(F.lit(BASE)) != 0
    return ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & POLICIES[-1].keeps(bits)).alias("kept"), "bits")
