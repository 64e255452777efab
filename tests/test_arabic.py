"""Joined forms and visual order, against forms spelt out."""

import unicodedata

from pyspark.sql import functions as F

from fieldmark.functions import arabic

# Words, and the presentation forms that are seen from left to right.
SEEN = {
    "سلام": "FEE1 FEFC FEB3", "لا": "FEFB", "بلا": "FEFC FE91", "ب": "FE8F", "بب": "FE90 FE91", "ببب": "FE90 FE92 FE91", "دار": "FEAD FE8D FEA9", "ماء": "FE80 FE8E FEE3", "محمد": "FEAA FEE4 FEA4 FEE3", "كتاب": "FE8F FE8E FE98 FEDB",
}


def test_words_are_joined_and_turned():
    for word, codes in SEEN.items():
        assert arabic.visual(arabic.joined(word)) == "".join(chr(int(c, 16)) for c in codes.split()), word


def test_forms_stand_for_their_letters():
    for text in ("الحارثي فاطمة", "راجيش كومار نائير", "السَّلام عليكم", "لأن الآن"):
        assert unicodedata.normalize("NFKC", arabic.joined(text)) == unicodedata.normalize("NFC", text)


def test_marks_stay_with_their_letters():
    seen = arabic.visual(arabic.joined("بَب"))
    assert seen == "ﺐﺑَ"


def test_lines_of_two_directions():
    b = lambda text: arabic.visual(text)
    assert b("abc 123") == "abc 123" and b("") == "" and b("...") == "..."
    assert b("اب 123 جد") == "دج 123 با"
    assert b("ID اب") == "ID با" and b("اب ID") == "ID با"
    assert b("اب (جد)") == "(دج) با"
    assert b("x اب جد y") == "x دج با y"


def test_columns(spark):
    rows = [("JOHN",), (None,), ("",), ("ب ب\nJOHN\nلا",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(arabic.shaped(F.col("t"))).collect()]
    assert got == ["JOHN", None, "", "ﺏ ﺏ\nJOHN\nﻻ"]
