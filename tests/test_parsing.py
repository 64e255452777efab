"""Replies to cards and boxes, against a plain reading with Python's json."""

import json
import math

import pytest

from fieldmark.operators import parsing
from fieldmark.schemas import CARD_KEYS

NOT_FINITE = ['{"full_name": 1e400}', '{"id_number": -1e999}', '{"sex": "M", "full_name": 1E+309}']
PAYLOADS = [
    '{"id_number": "1e400"}', *NOT_FINITE,
    '{"full_name": "JOHN"}', '{"id_number": 12345678}', '{"id_number": 1.0}', '{"full_name": true}', '{"full_name": "", "id_number": "   "}', '{"full_name": null}', '{"eye_colour": "brown"}',
    '{"full_name": ["A"]}', '{"full_name": {"a": 1}}', "[1]", '"text"', "3", '{"full_name": "JOHN', "I cannot read this card.", "", '{"full_name": "A"} and {"sex": "M"}', '[{"sex": "M"}]', "{'sex': 'M'}",
    '{"sex": "M", "sex": "F"}', '{"full_name": "جون", "sex_ar": "ذكر"}', "{}", "{", "}", "}{", '{"Full_Name": "A"}', '{"id_number": 123456789012345678901234567890123456789012}', '{"id_number": 01}', '{"sex": "M",}',
]
WRAPS = ["{}", "```json\n{}\n```", "``` {} ```", "Here you are: {} Bye.", " {}\n\t"]


def plain(text):
    """(card or None, family of the error or None)."""
    s = text.strip()
    if s[:3] == "```":
        s = s[3:].lstrip()
        s = s[4:] if s[:4].lower() == "json" else s
    s = s.strip()
    s = s[:-3] if s.endswith("```") else s
    first, last = s.find("{"), s.rfind("}")
    s = s[first : last + 1] if first >= 0 and last > first else s.strip()
    try:
        data = json.loads(s)
    except ValueError:
        return None, parsing.NOT_JSON
    if not isinstance(data, dict):
        return None, parsing.NOT_OBJECT
    if not set(data) <= set(CARD_KEYS) or any(isinstance(v, (bool, list, dict)) or isinstance(v, float) and math.isinf(v) for v in data.values()):
        return None, parsing.NOT_CARD
    said = {k: None if v is None else str(v) for k, v in data.items()}
    return {k: said.get(k) if (said.get(k) or "").strip() else None for k in CARD_KEYS}, None


def test_cards_as_json_reads_them(spark):
    texts = [w.replace("{}", p) for p in PAYLOADS for w in WRAPS]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = parsing.parse_card(df).orderBy("doc_id").collect()
    for row in got:
        card, family = plain(row["text"])
        assert (row["card"] and row["card"].asDict()) == card, row["text"]
        assert (row["error"] or "").startswith(family) if family else row["error"] is None, (row["text"], row["error"])
    assert spark.createDataFrame([], "text string").transform(parsing.parse_card).count() == 0


def test_large_finite_numbers_are_values(spark):
    row = parsing.parse_card(spark.createDataFrame([('{"full_name": 1e300}',)], "text string")).first()
    assert row["error"] is None and float(row["card"]["full_name"]) == 1e300


def test_null_reply_is_an_error(spark):
    row = parsing.parse_card(spark.createDataFrame([(None,)], "text string")).first()
    assert row["card"] is None and row["error"] == parsing.NOT_JSON


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"full_name": [10, 20, 300, 60], "sex": {"bbox_2d": [1, 2, 3, 4]}}', {"full_name": (10, 20, 300, 60), "sex": (1, 2, 3, 4)}),
        ('```json\n{"sex": [1.5, 2.5, "10", " 2.5 "]}\n```', {"sex": (2, 2, 10, 2)}),
        ('{"sex": [1, 2, 3], "full_name": [1, 2, 3, 4, 5], "nationality": [1, 2, 3, 4]}', {"nationality": (1, 2, 3, 4)}),
        ('{"sex": [1, null, 3, 4], "full_name": ["a", 1, 2, 3], "nationality": [true, 2, 3, 4], "x": "y", "z": {"a": 1}}', {"nationality": (1, 2, 3, 4)}),
        ("nothing here", {}), ("[1, 2, 3, 4]", {}), ("123", {}), (None, {}), ('{"sex": [1, 2, 3, 4]} and {"a": 1}', {}),
        ('{"eye_colour": [1, 2, 3, 4]}', {"eye_colour": (1, 2, 3, 4)}), ('{"sex": [1e300, 1, 2, 3]}', {}),
    ],
)
def test_boxes(spark, text, want):
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert {r["field"]: tuple(r[c] for c in ("x1", "y1", "x2", "y2")) for r in parsing.parse_boxes(df, "text", "doc_id").collect()} == want


ODD = [
    "1", " 4 ", "+5", "-6", "6.", ".5", "1_0", "1__0", "_1", "1_", "1.5_0", "1_.5", "1e1", "1E+0_1", "1e", "e1", "1d", "2f", "1D", "2F", "1L", "0x10", "nan", "NaN", "inf", "-Infinity", "infinity", "true", "True", "",
    " ", "+", "1 2", "1,5", "1e400", "\t7\n", "٣", "۴٫۵", "１２", "0b1", "1j", "--1", "2147483648", "2.5", "3.5", "\u00a08\u2003", "null", "1e-400",
]


def test_numbers_in_strings_as_float_reads_them(spark):
    """float() reads more digits than those of Arabic and full-width text; these and what isn't finite aside, all agree."""
    def plain(s):
        try:
            x = float(s)
        except ValueError:
            return None
        return round(x) if math.isfinite(x) and abs(round(x)) < 2**31 else None

    rows = [(i, json.dumps({"sex": [s, 1, 2, 3]})) for i, s in enumerate(ODD)]
    got = {r["doc_id"]: r["x1"] for r in parsing.parse_boxes(spark.createDataFrame(rows, "doc_id int, text string"), "text", "doc_id").collect()}
    for i, s in enumerate(ODD):
        assert got.get(i) == plain(s), s
