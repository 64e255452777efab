"""Validity rules: each gives a reason that a reviewer can act on, or null. Null values fail no rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmark.functions.text import strip
from fieldmark.schemas import ARABIC, NATIONALITIES

# Limits and reasons.
FIRST_YEAR, LAST_YEAR, MAX_AGE = 1900, 2100, 120
MAX_AGE_DAYS = int(MAX_AGE * 365.25)
NOT_DIGITS, NOT_ISO, NOT_SEX = "expected 8 digits", "not a valid ISO date (YYYY-MM-DD)", "expected M or F"
BAD_YEAR = f"year outside {FIRST_YEAR}-{LAST_YEAR}"
UNKNOWN_NATIONALITY, SHORT_NAME, DIGIT_NAME = "not in the known nationality list", "too short to be a name", "contains digits"
NOT_ARABIC, BEFORE_BIRTH = "expected Arabic script", "expiry precedes date of birth"
FUTURE_BIRTH, TOO_OLD = "date of birth is in the future", f"implies an age over {MAX_AGE}"
#: Arabic, its supplement, and both blocks of presentation forms.
ARABIC_SCRIPT = "[؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]"


def iso_date(c: Column) -> Column:
    """The date of a string that is exactly YYYY-MM-DD in ASCII digits, from the year 1; else null."""
    shaped = c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & ~c.startswith("0000")
    return F.when(shaped, c.try_cast("date"))


def format_reason(field: str, value: Column, nationalities: Sequence[str] = NATIONALITIES) -> Column:
    v = strip(value)
    if field == "id_number":
        return F.when(~v.rlike(r"(?U)\A\d{8}\z"), NOT_DIGITS)
    if field in ("date_of_birth", "expiry_date"):
        day = iso_date(v)
        return F.when(v.isNotNull() & day.isNull(), NOT_ISO).when(~F.year(day).between(FIRST_YEAR, LAST_YEAR), BAD_YEAR)
    if field == "sex":
        return F.when(~F.upper(v).isin("M", "F"), NOT_SEX)
    if field == "nationality":
        return F.when(~F.upper(v).isin(*nationalities), UNKNOWN_NATIONALITY)
    return F.when(F.char_length(v) < 2, SHORT_NAME).when(v.rlike(r"(?U)\d"), DIGIT_NAME)


def arabic_reason(field: str, value_ar: Column) -> Column:
    return F.when(~value_ar.rlike(ARABIC_SCRIPT), NOT_ARABIC) if field in ARABIC else F.lit(None).cast("string")


def cross_reasons(birth: Column, expiry: Column, as_of: Column) -> dict[str, Column]:
    """Reasons by field that span several; values are taken as they are, without stripping."""
    born, ends = iso_date(birth), iso_date(expiry)
    wrong_order = ends <= born
    return {
        "date_of_birth": F.when(born > as_of, FUTURE_BIRTH).when(F.date_diff(as_of, born) > MAX_AGE_DAYS, TOO_OLD).when(wrong_order, BEFORE_BIRTH),
        "expiry_date": F.when(wrong_order, BEFORE_BIRTH),
    }
