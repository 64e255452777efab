"""The two-reading merge: order of the rules, agreement, values that are served."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldmark.functions import rules as r
from fieldmark.operators import merge
from fieldmark.schemas import CARD, CARD_KEYS, FIELDS

GOOD = dict(zip(CARD_KEYS, ("JOHN A SMITH", "جون سميث", "12345678", "1990-04-12", "2030-04-11", "OMANI", "عماني", "M", "ذكر")))


def merged(spark, pairs):
    rows = [(i, *[None if c is None else tuple(c.get(k) for k in CARD_KEYS) for c in p]) for i, p in enumerate(pairs)]
    card = ", ".join(f"{f.name}: string" for f in CARD)
    df = spark.createDataFrame(rows, f"doc_id long, a struct<{card}>, b struct<{card}>")
    got = {x["doc_id"]: ({f["field"]: f for f in x["fields"]}, x["agreement"]) for x in merge.merge_passes(df, "2026-01-01").collect()}
    return [got[i] for i in range(len(pairs))]


def one(spark, a, b):
    return merged(spark, [(a, b)])[0]


def test_equal_readings_are_ok(spark):
    fields, agreement = one(spark, GOOD, GOOD)
    assert {f["status"] for f in fields.values()} == {"ok"}
    assert tuple(agreement) == (6, 6, 6)
    assert fields["id_number"]["value_ar"] is None and fields["sex"]["value_ar"] == "ذكر"


def test_missing_comes_before_all(spark):
    gone = GOOD | {"id_number": None}
    for b in (gone, None):
        fields, _ = one(spark, gone, b)
        assert (fields["id_number"]["status"], fields["id_number"]["reason"], fields["id_number"]["value"]) == ("missing", None, None)
    fields, agreement = one(spark, GOOD | {"sex": None, "sex_ar": "ذكر"}, GOOD | {"sex": None, "sex_ar": "أنثى"})
    assert fields["sex"]["status"] == "missing" and fields["sex"]["value_ar"] is None and tuple(agreement) == (5, 5, 6)


def test_no_second_reading(spark):
    fields, agreement = one(spark, GOOD, None)
    assert {(f["status"], f["reason"]) for f in fields.values()} == {("review", merge.UNAVAILABLE)} and tuple(agreement) == (0, 0, 6)


@pytest.mark.parametrize(("key", "value", "field"), [("id_number", "12345679", "id_number"), ("id_number", None, "id_number"), ("full_name_ar", "جون سميثي", "full_name"), ("sex_ar", None, "sex")])
def test_disagreement(spark, key, value, field):
    for a, b in ((GOOD, GOOD | {key: value}), (GOOD | {key: value}, GOOD)):
        fields, agreement = one(spark, a, b)
        assert fields[field]["reason"] == merge.DISAGREED and agreement["matched"] == 5
        assert fields[field]["value"] == a[field]


def test_spacing_case_and_composition_agree(spark):
    noisy = GOOD | {"full_name": "  john a  smith ", "nationality": unicodedata.normalize("NFD", "Écossais")}
    fields, agreement = one(spark, noisy, GOOD | {"nationality": "éCOSSAIS"})
    assert agreement["matched"] == 6 and fields["full_name"]["value"] == "  john a  smith "
    fields, _ = one(spark, GOOD | {"full_name": "STRASSE X"}, GOOD | {"full_name": "Straße X"})
    assert fields["full_name"]["status"] == "ok"


def test_disagreement_outranks_format_and_agreement_counts_failures(spark):
    fields, _ = one(spark, GOOD | {"id_number": "1"}, GOOD | {"id_number": "2"})
    assert fields["id_number"]["reason"] == merge.DISAGREED
    fields, agreement = one(spark, GOOD | {"id_number": "1"}, GOOD | {"id_number": "1"})
    assert fields["id_number"]["reason"] == r.NOT_DIGITS and agreement["matched"] == 6
    wrong = GOOD | {"expiry_date": "1980-01-01"}
    assert one(spark, wrong, wrong)[0]["expiry_date"]["reason"] == r.BEFORE_BIRTH
    latin = GOOD | {"full_name_ar": "JOHN"}
    assert one(spark, latin, latin)[0]["full_name"]["reason"] == r.NOT_ARABIC


text = st.one_of(st.none(), st.sampled_from(["M", "m", "12345678", "1990-01-01", "OMANI", "ذكر", "  x "]))
card = st.fixed_dictionaries({k: text for k in CARD_KEYS})


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(card, st.one_of(st.none(), card)), min_size=1, max_size=20))
def test_invariants(spark, pairs):
    for fields, agreement in merged(spark, pairs):
        assert list(fields) == list(FIELDS)
        assert 0 <= agreement["matched"] <= agreement["compared"] <= agreement["total"] == 6
        for f in fields.values():
            assert f["status"] != "missing" or (f["value"], f["reason"]) == (None, None)
            assert (f["reason"] is None) == (f["status"] != "review")


def test_flat_cards_give_the_same(spark, sf):
    from fieldmark.sources.tables import card_pairs, card_structs

    pairs = card_pairs(spark, sf)
    flat = merge.long_fields(merge.merge_passes(pairs, "2026-01-01", flat=True), "doc_id")
    structs = merge.long_fields(merge.merge_passes(card_structs(pairs), "2026-01-01"), "doc_id")
    assert flat.count() == structs.count() and flat.exceptAll(structs).isEmpty()
