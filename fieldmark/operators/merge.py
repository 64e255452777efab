"""Two readings of a card merged into a status for each field.

The first rule that applies decides: null in both readings is missing; no second reading, readings that differ, a failed
format or cross-field rule are each a review with its reason; the rest is ok. One projection, no shuffle.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions import rules
from fieldmark.functions.text import normalised
from fieldmark.schemas import ARABIC, CARD_KEYS, FIELDS, NATIONALITIES

UNAVAILABLE, DISAGREED = "consistency pass unavailable", "passes disagreed"


def _day(as_of: datetime.date | str | Column | None) -> Column:
    if as_of is None:
        return F.current_date()
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")


def merge_passes(df: DataFrame, as_of: datetime.date | str | Column | None = None, a: str = "a", b: str = "b", flat: bool = False, nationalities: Sequence[str] = NATIONALITIES) -> DataFrame:
    """df with ``fields`` (array of field, value, value_ar, status, reason in the fields' order) and ``agreement``.

    a, b: columns with cards; a null b is a reading that isn't there. as_of: the day that ages count to. flat: cards lie in
    columns a_<key> and b_<key> beside b_present; for cards that are computed in the same plan, where the optimiser
    would copy the expressions inside a struct to each of its uses.
    """
    first, second = ({k: F.col(f"{c}_{k}") if flat else F.col(c)[k] for k in CARD_KEYS} for c in (a, b))
    absent = ~F.col(f"{b}_present") if flat else F.col(b).isNull()
    values = [first[k] for k in CARD_KEYS] + [second[k] for k in CARD_KEYS]
    df = df.withColumn("_norm", normalised(values))
    at = {k: i for i, k in enumerate(CARD_KEYS)}
    same = lambda k: F.col("_norm")[at[k]].eqNullSafe(F.col("_norm")[at[k] + len(CARD_KEYS)])
    cross = rules.cross_reasons(first["date_of_birth"], first["expiry_date"], _day(as_of))
    # what later expressions share is projected first
    df = df.withColumns(
        {f"_same_{f}": same(f) & same(f"{f}_ar") if f in ARABIC else same(f) for f in FIELDS}
        | {f"_fails_{f}": F.coalesce(rules.format_reason(f, first[f], nationalities), rules.arabic_reason(f, first[f"{f}_ar"]) if f in ARABIC else F.lit(None).cast("string"), cross.get(f, F.lit(None).cast("string"))) for f in FIELDS}
    )
    results, compared, matched = [], [], []
    for f in FIELDS:
        missing = first[f].isNull() & (absent | second[f].isNull())
        agrees = F.col(f"_same_{f}")
        reason = F.when(missing, None).when(absent, UNAVAILABLE).when(~agrees, DISAGREED).otherwise(F.col(f"_fails_{f}"))
        status = F.when(missing, "missing").when(absent | ~agrees | F.col(f"_fails_{f}").isNotNull(), "review").otherwise("ok")
        arabic = F.when(~missing, first[f"{f}_ar"]) if f in ARABIC else F.lit(None).cast("string")
        results.append(F.struct(F.lit(f).alias("field"), first[f].alias("value"), arabic.alias("value_ar"), status.alias("status"), reason.cast("string").alias("reason")))
        compared.append((~missing & ~absent).cast("int"))
        matched.append((~missing & ~absent & agrees).cast("int"))
    add = lambda xs: reduce(lambda x, y: x + y, xs)
    agreement = F.struct(add(matched).alias("matched"), add(compared).alias("compared"), F.lit(len(FIELDS)).alias("total"))
    gone = ("_norm", "_same_", "_fails_", f"{a}_", f"{b}_") if flat else ("_norm", "_same_", "_fails_")
    kept = [c for c in df.columns if not c.startswith(gone)]
    return df.select(*kept, F.array(*results).alias("fields"), agreement.alias("agreement"))


def long_fields(merged: DataFrame, *keys: str) -> DataFrame:
    """One row for each card and field: keys, ordinal, field, value, value_ar, status, reason.

    The array is never empty, so the outer form gives the same rows; the other would test the array before it explodes
    it, and so have the optimiser copy all of the rules' expressions.
    """
    return merged.select(*keys, F.posexplode_outer("fields").alias("ordinal", "f")).select(*keys, "ordinal", "f.*")


def status_counts(merged: DataFrame, *keys: str) -> DataFrame:
    """keys and the number of fields with each status, without a shuffle."""
    count = lambda s: F.size(F.filter("fields", lambda f: f["status"] == s)).alias(s)
    return merged.select(*keys, count("ok"), count("review"), count("missing"))
