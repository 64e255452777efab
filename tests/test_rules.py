"""Validity rules, one value at a time."""

import pytest
from pyspark.sql import functions as F

from fieldmark.functions import rules as r

AS_OF = "2026-01-01"


def reasons(spark, field, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [x[0] for x in df.orderBy("i").select(r.format_reason(field, F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("field", "cases"),
    [
        ("id_number", {"12345678": None, " 12345678\n": None, "1234567": r.NOT_DIGITS, "1234567A": r.NOT_DIGITS, "123456789": r.NOT_DIGITS, "١٢٣٤٥٦٧٨": None, None: None, "": r.NOT_DIGITS}),
        ("date_of_birth", {"1990-04-12": None, " 1990-04-12 ": None, "12/04/1990": r.NOT_ISO, "1990-02-31": r.NOT_ISO, "19900412": r.NOT_ISO, "2024-W01-1": r.NOT_ISO, "1832-01-01": r.BAD_YEAR, "1990-4-1": r.NOT_ISO, "0000-01-01": r.NOT_ISO, "2101-01-01": r.BAD_YEAR, "1900-01-01": None, "2100-12-31": None, None: None}),
        ("sex", {"M": None, "f": None, "MALE": r.NOT_SEX, " m ": None, None: None}),
        ("nationality", {"OMANI": None, "sri lankan": None, "ATLANTEAN": r.UNKNOWN_NATIONALITY, None: None}),
        ("full_name", {"JO": None, "J": r.SHORT_NAME, "JOHN 5MITH": r.DIGIT_NAME, "JOHN ٥": r.DIGIT_NAME, " J ": r.SHORT_NAME, None: None}),
    ],
)
def test_formats(spark, field, cases):
    assert dict(zip(cases, reasons(spark, field, list(cases)))) == cases


def test_arabic_script(spark):
    cases = {"جون": None, "JOHN": r.NOT_ARABIC, "JOHN جون": None, None: None, "ﷲ": None, "": r.NOT_ARABIC}
    df = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, v string").orderBy("i")
    assert [x[0] for x in df.select(r.arabic_reason("sex", F.col("v"))).collect()] == list(cases.values())
    assert [x[0] for x in df.select(r.arabic_reason("id_number", F.col("v"))).collect()] == [None] * len(cases)


@pytest.mark.parametrize(
    ("born", "ends", "want"),
    [
        ("1990-04-12", "2030-04-11", (None, None)),
        ("2030-04-12", "1990-04-12", (r.FUTURE_BIRTH, r.BEFORE_BIRTH)),
        ("1990-04-12", "1990-04-12", (r.BEFORE_BIRTH, r.BEFORE_BIRTH)),
        ("2026-01-01", None, (None, None)),
        ("2026-01-02", None, (r.FUTURE_BIRTH, None)),
        ("1906-01-01", None, (None, None)),
        ("1905-12-31", None, (r.TOO_OLD, None)),
        ("not-a-date", "1990-01-01", (None, None)),
        (" 1990-04-12 ", "1980-01-01", (None, None)),
    ],
)
def test_cross_fields(spark, born, ends, want):
    df = spark.createDataFrame([(born, ends)], "b string, e string")
    got = r.cross_reasons(F.col("b"), F.col("e"), F.lit(AS_OF).cast("date"))
    assert tuple(df.select(got["date_of_birth"], got["expiry_date"]).first()) == want
