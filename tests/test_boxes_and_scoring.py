"""Boxes, overlap, scoring, latency, display."""

import pytest
from pyspark.sql import functions as F

from fieldmark.functions import display
from fieldmark.functions import geometry as g
from fieldmark.operators import boxes, imaging, scoring
from fieldmark.schemas import FIELDS

SIZE = "pw int, ph int, w int, h int"


def kept(spark, claims, pw=1000, ph=600, w=2000, h=1200):
    rows = [(1, f, *b, pw, ph, w, h) for f, b in claims.items()]
    df = spark.createDataFrame(rows, f"doc_id int, field string, x1 int, y1 int, x2 int, y2 int, {SIZE}")
    return {r["field"]: (r["x1"], r["y1"], r["x2"], r["y2"]) for r in boxes.filter_boxes(df, "doc_id").collect()}


@pytest.mark.parametrize(
    ("claims", "want"),
    [
        ({"full_name": (100, 50, 400, 90)}, {"full_name": (200, 100, 800, 180)}),
        ({"full_name": (400, 90, 100, 50)}, {}),
        ({"full_name": (100, 50, 5000, 90)}, {}),
        ({"full_name": (700, 50, 1010, 90)}, {"full_name": (1400, 100, 2000, 180)}),
        ({"full_name": (0, 0, 1000, 600)}, {}),
        ({"full_name": (100, 50, 110, 300)}, {}),
        ({"full_name": (100, 50, 102, 52)}, {}),
        ({"eye_colour": (100, 50, 400, 90)}, {}),
        ({"full_name": (100, 50, 400, 90), "sex": (100, 50, 400, 90)}, {"full_name": (200, 100, 800, 180), "sex": (200, 100, 800, 180)}),
        ({"full_name": (100, 50, 400, 90), "sex": (100, 50, 400, 90), "id_number": (100, 50, 400, 90)}, {}),
        ({"full_name": (100, 50, 400, 90), "sex": (100, 50, 400, 90), "eye_colour": (100, 50, 400, 90)}, {"full_name": (200, 100, 800, 180), "sex": (200, 100, 800, 180)}),
    ],
)
def test_filter(spark, claims, want):
    assert kept(spark, claims) == want


def test_missing_and_bad_sizes(spark):
    assert kept(spark, {"sex": (200, 100, 800, 180)}, pw=None, ph=None) == {"sex": (200, 100, 800, 180)}
    assert kept(spark, {"sex": (200, 100, 800, 180)}, pw=0) == {}


def test_rescale_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 2, 1), (3, 2, 1), (5, 2, 1)], "x int, of int, to int")
    assert [r[0] for r in df.select(g.rescaled(F.col("x"), F.col("of"), F.col("to"))).collect()] == [0, 2, 2]


def test_overlap(spark):
    pairs = [((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (10, 0, 20, 10), 0.0), ((0, 0, 10, 10), (5, 0, 15, 10), 1 / 3)]
    names = ["x1", "y1", "x2", "y2"]
    for a, b, want in pairs:
        for p, q in ((a, b), (b, a)):
            df = spark.createDataFrame([(*p, *q)], ", ".join(f"a{n} int" for n in names) + ", " + ", ".join(f"b{n} int" for n in names))
            assert df.select(g.overlap([F.col(f"a{n}") for n in names], [F.col(f"b{n}") for n in names])).first()[0] == pytest.approx(want)


def results(spark, rows):
    return spark.createDataFrame(rows, "image string, field string, value string, value_ar string, status string")


def test_scoring(spark):
    truth = spark.createDataFrame([("a.jpg", f, f.upper(), "ذكر" if f == "sex" else None) for f in FIELDS], "image string, field string, want string, want_ar string")
    rows = [("a.jpg", f, f.upper(), None, "ok") for f in FIELDS if f not in ("sex", "id_number", "nationality")]
    rows += [("a.jpg", "sex", "sex ", "أنثى", "ok"), ("a.jpg", "id_number", "wrong", None, "ok"), ("a.jpg", "nationality", "wrong", None, "review")]
    compared = scoring.compare(results(spark, rows), truth)
    table = {r["field"]: r for r in scoring.per_field(compared).collect()}
    assert list(sorted(table)) == sorted(FIELDS) and table["sex"]["exact"] == 1 and table["nationality"]["review"] == 1 and table["id_number"]["exact"] == 0
    silent = {(r["field"], r["got"], r["expected"]) for r in scoring.silent_errors(compared).collect()}
    assert silent == {("sex_ar", "أنثى", "ذكر"), ("id_number", "wrong", "ID_NUMBER")}
    assert tuple(scoring.silent_error_rate(compared).first()) == (2, 6, pytest.approx(100 / 3))


def test_scoring_of_nothing(spark):
    truth = spark.createDataFrame([], "image string, field string, want string, want_ar string")
    compared = scoring.compare(results(spark, []), truth)
    assert scoring.per_field(compared).count() == 6 and tuple(scoring.silent_error_rate(compared).first()) == (0, 0, 0.0)
    with pytest.raises(KeyError):
        scoring.require_truth(results(spark, [("b.jpg", "sex", "M", None, "ok")]), truth)


@pytest.mark.parametrize(("ms", "want"), [([1, 2, 3, 4], (3, 4)), ([5], (5, 5)), ([1, 2, 3], (2, 3)), ([7, 7, 1, 1], (7, 7)), ([], (None, None))])
def test_latency_takes_the_upper_median(spark, ms, want):
    assert tuple(scoring.latency_summary(spark.createDataFrame([(m,) for m in ms], "elapsed_ms int")).first()) == want


def test_box_counts(spark):
    box = "struct<x1:int,y1:int,x2:int,y2:int>"
    rows = [((105, 102, 395, 138), (100, 100, 400, 140)), ((600, 400, 700, 440), (100, 100, 400, 140)), (None, (1, 1, 2, 2)), ((1, 1, 2, 2), None)]
    got = scoring.box_counts(spark.createDataFrame(rows, f"box {box}, true_box {box}")).first()
    assert (got["hits"], got["total"], got["expected"], got["hit_rate"]) == (1, 2, 3, 50.0)
    none = scoring.box_counts(spark.createDataFrame([], f"box {box}, true_box {box}")).first()
    assert (none["coverage"], none["hit_rate"]) == (None, None)


def test_report(spark):
    rows = [{"field": "sex", "ordinal": 5, "exact": 1, "n": 2, "ok": 1, "review": 1, "missing": 0}]
    rate, lost = {"n_silent": 0, "total": 2, "percent": 0.0}, {"hits": 0, "total": 0, "expected": 0, "coverage": None, "hit_rate": None}
    text = scoring.report_text(rows, [], rate, lost, {"median_ms": 3, "max_ms": 4}, self_consistency=False)
    assert text.startswith("WARNING") and "the truth has none" in text and "none returned" in text and "median 3 ms" in text


def test_sizes_and_display(spark):
    df = spark.createDataFrame([(3200, 100), (800, 100), (300, 200), (1000, 900)], "w int, h int")
    assert [tuple(r[2:]) for r in imaging.resize_policy(df).collect()] == [(0.5, 1600, 50), (1.125, 900, 113), (2.0, 600, 400), (1.0, 1000, 900)]
    shown = spark.createDataFrame([(90.0,), (70.0,), (10.0,), (None,)], "c double").select(display.confidence_class(F.col("c")), display.confidence_label(F.col("c"))).collect()
    assert [tuple(r) for r in shown] == [("ok", "90%"), ("mid", "70%"), ("low", "10%"), ("mid", "n/a")]
    assert spark.range(1).select(display.agreement_label(F.lit(0), F.lit(0)), display.seconds_label(F.lit(3180)), display.short_model(F.lit("a/b/c")), display.api_base(F.lit(""), F.lit("http://x//"))).first()[:] == ("—", "3.2s", "c", "http://x")
