"""Fixed fields, types and words of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The fields in order, and those that also have an Arabic value.
FIELDS = ("full_name", "id_number", "date_of_birth", "expiry_date", "nationality", "sex")
ARABIC = ("full_name", "nationality", "sex")
STATUSES = ("ok", "review", "missing")

#: The keys of a card: each field, with its Arabic value beside it where it has one.
CARD_KEYS = tuple(k for f in FIELDS for k in ((f, f"{f}_ar") if f in ARABIC else (f,)))
CARD = T.StructType([T.StructField(k, T.StringType()) for k in CARD_KEYS])
BOX = T.StructType([T.StructField(k, T.IntegerType()) for k in ("x1", "y1", "x2", "y2")])
AGREEMENT = T.StructType([T.StructField(k, T.IntegerType()) for k in ("matched", "compared", "total")])
FIELD_RESULT = T.StructType([*[T.StructField(k, T.StringType()) for k in ("value", "value_ar", "status", "reason")], T.StructField("box", BOX)])
WORD = T.StructType([T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType())])

# Nationalities that are known without a list of one's own.
NATIONALITIES = (
    "OMANI", "INDIAN", "PAKISTANI", "BANGLADESHI", "FILIPINO", "EGYPTIAN", "SUDANESE",
    "JORDANIAN", "SYRIAN", "YEMENI", "SRI LANKAN", "NEPALI", "BRITISH", "AMERICAN",
)

# Labels, classes and colours for display.
FIELD_LABELS = {"full_name": "Name", "id_number": "ID number", "date_of_birth": "Date of birth", "expiry_date": "Expiry", "nationality": "Nationality", "sex": "Sex"}
STATUS_CLASSES = {"ok": "ok", "review": "mid", "missing": "low"}
STATUS_COLOURS = {"ok": "#00B3A4", "review": "#E0952C", "missing": "#D2544B"}
