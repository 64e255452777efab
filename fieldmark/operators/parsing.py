"""Model replies to typed data, in the JVM.

A reply is cut to its outermost braces and must then be one JSON object whose keys are a card's and whose values are
strings, numbers or null. Types are judged on VARIANT values, values taken from from_json, whose number text is the source's.
Of repeated keys the last counts; objects are read as maps, which keep them all, so no setting of the session matters.
Numbers that aren't finite (as 1e400) are an error: they are no legible field.

A corner of a box may be a number, a boolean or a string that spells a number: white space around it, a sign, decimal
digits with single underscores between them, one point, an exponent. Suffixes, hexadecimal digits and words aren't numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.binding import bind
from fieldmark.functions.text import SPACE, strip, strip_fences
from fieldmark.schemas import CARD, CARD_KEYS

NOT_JSON, NOT_OBJECT, NOT_CARD = "not valid JSON", "expected a JSON object, got ", "does not match the card schema"
#: Variant types that a card's value may have; numbers become their text.
SCALARS = ("STRING", "VOID", "BIGINT", "DOUBLE", "FLOAT", "DECIMAL")
_NAMES = {"ARRAY": "list", "STRING": "str", "BOOLEAN": "bool", "VOID": "NoneType", "BIGINT": "int", "DOUBLE": "float", "FLOAT": "float", "DECIMAL": "float"}
#: The largest finite number; comparisons put what isn't a number above all numbers.
LARGEST = float.fromhex("0x1.fffffffffffffp+1023")
_DIGITS = r"[0-9](?:_?[0-9])*"
NUMBER = rf"\A[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"
# Decimal digits of Arabic, Persian and full-width text, each from 0 to 9, and what they become.
OTHER_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹０１２３４５６７８９"
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _kind(v: Column) -> Column:
    """The type's name without its parameters; an absent value and a null are VOID."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), r"\A[A-Z]+", 0), F.lit("VOID"))


def _in_brackets(json: Column) -> Column:
    """In brackets, anything after a value makes the whole unreadable or a second element."""
    return F.concat(F.lit("["), json, F.lit("]"))


def entries_of(json: Column) -> Column:
    """The keys and values (variants) of a text that is one JSON object, the last of repeated keys; null for any other text."""
    read = F.from_json(_in_brackets(json), "array<map<string, variant>>", STRICT)
    last = lambda e: F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda later: later["key"] == x["key"]))
    return bind(read, lambda r: F.when(F.size(r) == 1, bind(F.map_entries(F.get(r, F.lit(0))), last)))


def parse_card(df: DataFrame, text: str = "text", card: str = "card", error: str = "error") -> DataFrame:
    """df with card (null if the reply isn't one) and error (null if it is)."""
    df = df.withColumn("_json", strip_fences(F.col(text)))
    df = df.withColumns({"_entries": entries_of(F.col("_json")), "_read": F.from_json("_json", CARD, STRICT)})
    known = F.forall("_entries", lambda e: e["key"].isin(*CARD_KEYS))
    finite = lambda v: F.abs(F.coalesce(F.try_variant_get(v, "$", "double"), F.lit(0.0))) <= LARGEST
    scalar = F.forall("_entries", lambda e: bind(_kind(e["value"]), lambda k: k.isin(*SCALARS) & (~k.isin("DOUBLE", "FLOAT") | finite(e["value"]))))
    got = lambda kind: F.coalesce(F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])[kind], F.lit("other"))
    # what is no object is read once more for its type
    other = lambda all_: F.when(all_.isNull() | F.try_variant_get(all_, "$[0]", "variant").isNull() | F.try_variant_get(all_, "$[1]", "variant").isNotNull(), NOT_JSON).otherwise(F.concat(F.lit(NOT_OBJECT), got(_kind(F.try_variant_get(all_, "$[0]", "variant")))))
    reason = (
        F.when(F.col("_entries").isNull(), F.coalesce(bind(F.try_parse_json(_in_brackets(F.col("_json"))), other), F.lit(NOT_JSON)))
        .when(~known, f"{NOT_CARD}: a key that no card has")
        .when(~scalar, f"{NOT_CARD}: a value that is no string")
    )
    blank = lambda k: F.when(~F.col("_read")[k].rlike(rf"(?U)\A{SPACE}*\z"), F.col("_read")[k])
    df = df.withColumn(error, reason)
    made = F.when(F.col(error).isNull(), F.struct(*[blank(k).alias(k) for k in CARD_KEYS]))
    return df.withColumn(card, made).drop("_json", "_entries", "_read")


def number_of(said: Column) -> Column:
    """The number that a string spells by the grammar of NUMBER, or null; what is too large for a double is infinite."""
    plain = F.translate(strip(said), OTHER_DIGITS, "0123456789" * 3)
    return bind(plain, lambda x: F.when(x.rlike(NUMBER), F.replace(x, F.lit("_"), F.lit("")).try_cast("double")))


def boxes_of(text: Column) -> Column:
    """The readable boxes of a reply as an array of (field, x1, y1, x2, y2), from [x1, y1, x2, y2] or {"bbox_2d": [...]}; null if it can't be read.

    A number may be a string or a boolean (see above); half rounds to even, and what isn't finite leaves no box.
    """
    def number(v: Column) -> Column:
        of = lambda kind: F.try_variant_get(v, "$", kind)
        return bind(_kind(v), lambda k: F.when(k == "STRING", number_of(of("string"))).when(k == "BOOLEAN", of("boolean").cast("double")).otherwise(of("double")))

    whole = lambda x: F.rint(F.when(~F.isnan(x) & (F.abs(x) < 2147483648.0), x)).cast("int")
    corners = lambda v: F.transform(F.transform(F.coalesce(F.try_variant_get(v, "$.bbox_2d", "array<variant>"), F.try_variant_get(v, "$", "array<variant>")), number), whole)
    read = F.transform(entries_of(strip_fences(text)), lambda e: F.struct(e["key"].alias("field"), corners(e["value"]).alias("b")))
    whole_ones = F.filter(read, lambda x: (F.size(x["b"]) == 4) & F.forall(x["b"], lambda n: n.isNotNull()))
    return F.transform(whole_ones, lambda x: F.struct(x["field"], *[x["b"][i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]))


def parse_boxes(df: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """keys, field, x1, y1, x2, y2 for each readable box of each reply (see boxes_of); an unreadable reply has no rows."""
    rows = df.select(*keys, F.explode_outer(boxes_of(F.col(text))).alias("_b"))
    return rows.where("_b IS NOT NULL").select(*keys, "_b.*")
