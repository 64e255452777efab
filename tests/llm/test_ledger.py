"""The rule ledger against plain counting, and its policies against rules evaluated one by one."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldmark.llm import ledger

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {i + k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again),
        "n_letter_words": sum(any(c.isalpha() for c in w) for w in words), "n_letters": sum(c.isalpha() for c in text), "n_capitals": sum(c.isupper() for c in text), "longest_word": max(map(len, words), default=0),
    }


def texts():
    dice = random.Random(2)
    made = [None, "", " \n\t ", "a", "a " * 8, "a " * 9, "x y " * 30, "one\ntwo\none\n \n\none\r\n", "Ä" * 300, "#*$%&|<> 1 2 3", "a\x1cb c d e", "AB cd. " * 40]
    for n in (7, 8, 9, 15, 16, 17, 40, 200, 900):
        for kinds in (1, 2, 3, 40):
            made.append(dice.choice(["", "\n"]) + dice.choice([" ", "\n", "\t\x0b "]).join(dice.choice([f"w{k}", f"É{k}", f"{k}"]) for k in (dice.randrange(kinds) for _ in range(n))))
    whole = " ".join(f"u{i}" for i in range(50))
    return [*made, whole, whole + " z " + whole, made[-1], None]


def test_measurements(spark):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r.asDict() for r in ledger.measured(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for i, t in rows:
        assert {k: got[i][k] for k in ledger.MEASURES} == plain(t), i


def test_a_run_doesnt_go_on_in_the_next_text(spark):
    half = "a b c d"
    rows = [(0, half), (1, half), (2, f"{half} {half} {half}")]
    got = {r["doc_id"]: r["n_repeat_words"] for r in ledger.measured(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()}
    assert got == {0: 0, 1: 0, 2: 12}


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 70001}" for i in range(300_000)) + "\n" + "y" * 1_000_000
    got = ledger.measured(spark.createDataFrame([(1, text), (2, "b")], SCHEMA).coalesce(1)).orderBy("doc_id").collect()
    assert (got[0]["n_words"], got[0]["n_repeat_words"], got[0]["longest_word"], got[1]["n_words"]) == (300_001, 300_000, 1_000_000, 1)


def test_bits_policies_and_ablations(spark):
    df = spark.createDataFrame(list(enumerate(texts())), SCHEMA)
    book = ledger.ledger(df).cache()
    rows = ledger.judged(book).collect()
    assert book.count() == len(texts()) and ledger.ledger(df.limit(0)).count() == 0

    def fails(m, name):
        share = lambda a, b, p: 100 * m[a] > p * m[b]
        return {
            "few_words": m["n_words"] < 20, "repeated_words": share("n_repeat_words", "n_words", 30), "symbols": share("n_symbols", "n_words", 20), "repeated_lines": share("n_dup_lines", "n_lines", 30), "letterless": 100 * m["n_letter_words"] < 75 * m["n_words"],
            "capitals": share("n_capitals", "n_letters", 30), "short_words": m["word_chars"] < 3 * m["n_words"], "long_words": m["word_chars"] > 12 * m["n_words"], "endless_word": m["longest_word"] > 200,
        }[name]

    hard = {"base": ["few_words", "repeated_words"], "lines": ["few_words", "repeated_words", "symbols", "repeated_lines"], "full": ["few_words", "repeated_words", "symbols", "repeated_lines", "letterless", "capitals"]}
    soft = {"full": ["short_words", "long_words", "endless_word"]}

    def keeps(m, version, but=None):
        return not any(fails(m, n) for n in hard[version] if n != but) and sum(fails(m, n) for n in soft.get(version, ()) if n != but) <= 1

    counts = [plain(t) for t in texts()]
    for r in rows:
        m = counts[r["doc_id"]]
        assert all(bool(r["bits"] >> rule.bit & 1) == fails(m, rule.name) for rule in ledger.RULES)
        assert all(r[f"kept_{v}"] == keeps(m, v) for v in hard)
    want = {(v, n): (len(counts), sum(fails(m, n) for m in counts), sum(keeps(m, v) for m in counts), sum(keeps(m, v, n) for m in counts)) for v in hard for n in hard[v] + soft.get(v, [])}
    assert {(r["version"], r["rule"]): tuple(r)[2:] for r in ledger.ablations(book).collect()} == want
    assert {tuple(r)[2:] for r in ledger.ablations(book.limit(0)).collect()} == {(0, 0, 0, 0)}
    named = book.select("bits", ledger.reasons(F.col("bits")).alias("names")).collect()
    assert all(sorted(1 << next(x.bit for x in ledger.RULES if x.name == n) for n in r["names"]) == [1 << b for b in range(9) if r["bits"] >> b & 1] for r in named)
    book.unpersist()


def test_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a b", 1, "k"), (None, "a b", 1, "k")], f"{SCHEMA}, bits int, n_words string")
    assert [r["n_words"] for r in ledger.ledger(df).collect()] == [2, 2]
    assert [r["bits"] for r in ledger.digest(df).collect()] == [1 | 64, 1 | 64]
    with pytest.raises(ValueError):
        ledger.measured(df, keep=("n_words",))
    with pytest.raises(ValueError):
        ledger.ledger(df, rules=(ledger.RULES[0], ledger.RULES[0]))


def test_labelled_documents(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = ledger.digest(docs).join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in rows}
    assert kept[1] == 1.0 and kept.get(0, 0) < 0.2
