"""Vector codes against plain Lloyd's rounds over all rows at once."""

import hashlib

import numpy as np
import pytest

from fieldmark.llm import heaplloyd as h

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, rounds=2, entries=64):
    """code and error by row, and the hash, from full scans; rows: (vec_id, vector, label) in the order of vec_id."""
    z = np.array([np.floor(np.array(v, np.float64) * 256) for _, v, _ in rows]).astype(np.int64)
    x = z.reshape(len(z), 16, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def nearest():
        return np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(16)], 1)

    for _ in range(rounds):
        a = nearest()
        for p in range(16):
            for e in range(books.shape[1]):
                if (mine := x[a[:, p] == e, p]).size:
                    books[p, e] = mine.sum(0) // len(mine)
    a = nearest()
    off = x - books[np.arange(16)[None], a]
    return [bytes(r.astype(np.uint8)).hex() for r in a], (off**2).sum((1, 2)).tolist(), hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()


def vectors(n, size, seed, spread=0.2):
    dice = np.random.default_rng(seed)
    centres = dice.normal(size=(9, size))
    return [(i, [float(np.float32(v)) for v in centres[i % 9] + spread * dice.normal(size=size)], None if i % 11 == 0 else i % 4) for i in range(n)]


def frame(spark, rows, partitions=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


@pytest.mark.parametrize("size,spread", [(32, 0.2), (16, 1.0), (64, 0.001)])
def test_codes_are_those_of_full_scans(spark, size, spread):
    rows = vectors(700, size, size, spread)
    codes, errors, sha = plain(rows)
    got = {r["vec_id"]: r for r in h.digest(frame(spark, rows)).collect()}
    assert [got[i]["code"] for i in range(700)] == codes and [got[i]["error"] for i in range(700)] == errors
    assert {r["codebooks_sha256"] for r in got.values()} == {sha}
    by = {}
    for (_, _, lab), e in zip(rows, errors):
        by[lab] = by.get(lab, 0) + e
    assert all(got[i]["label_error"] == by[lab] for i, _, lab in rows)


def test_more_rounds_pop_fewer_parts(spark):
    rows = vectors(1500, 16, 3, 0.3)
    x = np.floor(np.array([v for _, v, _ in rows]) * 256).astype(np.int64).reshape(1500, 16, 1)
    books = x[:64].transpose(1, 0, 2).copy()
    moved = np.zeros((16, 64))
    heaps, popped = h.Heaps.built(x, books, moved), []
    for _ in range(6):
        nearest = heaps.nearest()
        assert (nearest == np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(16)], 1)).all()
        sums = h.sums_of(x, nearest, 64)
        after = np.where(sums[:, :, 1:] > 0, sums[:, :, :1] // np.maximum(sums[:, :, 1:], 1), books)
        moved, books = moved + h.moved_by(books, after), after
        popped.append(heaps.settled(x, books, moved))
        for p in range(16):  # every run is still a heap
            at = 0
            for n in heaps.sizes[p]:
                k = heaps.keys[p][at : at + n]
                assert all(k[(i - 1) // 2] <= k[i] for i in range(1, n))
                at += n
    assert popped[-1] < popped[0] and popped[-1] < 0.7 * x.shape[0] * 16
    codes, errors, _ = plain(rows, rounds=6)
    coded, _ = h.compress(frame(spark, rows), rounds=6)
    assert [r["code"] for r in coded.orderBy("id").collect()] == codes


def test_ties_go_to_the_lower_entry(spark):
    rows = [(i, [float(i % 3)] * 16, 0) for i in range(90)]
    codes, errors, sha = plain(rows)
    got = h.digest(frame(spark, rows)).orderBy("vec_id").collect()
    assert [r["code"] for r in got] == codes and got[0]["codebooks_sha256"] == sha


def test_rows_that_are_left_out(spark):
    good = vectors(70, 16, 9)
    bad = [(100, None, 1), (101, [None] * 16, 1), (102, [float("nan")] * 16, 1), (103, [float("inf")] * 16, 1), (104, [], 1), (105, [1.0] * 15, 1), (106, [1.0] * 32, 1), (107, [1e30] * 16, 1)]
    codes, errors, _ = plain(good)
    got = h.digest(frame(spark, good + bad)).orderBy("vec_id").collect()
    assert [(r["vec_id"], r["code"], r["error"]) for r in got] == [(i, c, e) for i, (c, e) in enumerate(zip(codes, errors))]
    shorter_first = h.digest(frame(spark, [(-1, [0.5] * 32, 1), *good])).collect()
    assert [r["vec_id"] for r in shorter_first] == [-1]


def test_few_rows_no_rows_and_repeats(spark):
    rows = vectors(5, 16, 2)
    assert [r["error"] for r in h.digest(frame(spark, rows)).collect()] == [0] * 5
    one = h.digest(frame(spark, [(7, [0.25] * 16, None)])).collect()
    assert [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in one] == [(7, "00" * 16, 0, 0)]
    none = h.digest(frame(spark, []))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    again = vectors(40, 16, 4) * 3
    codes, _, sha = plain(sorted(again, key=lambda r: r[0]))
    got = h.digest(frame(spark, again)).collect()
    assert sorted(r["code"] for r in got) == sorted(codes) and got[0]["codebooks_sha256"] == sha


def test_values_beyond_exact_doubles(spark):
    rows = [(i, [float(np.float32(60000 - 900 * ((i * 37) % 101) + k / 7)) for k in range(16 * 40)], 0) for i in range(80)]
    codes, errors, sha = plain(rows)
    got = h.digest(frame(spark, rows)).orderBy("vec_id").collect()
    assert [r["code"] for r in got] == codes and [r["error"] for r in got] == errors and got[0]["codebooks_sha256"] == sha


def test_many_labels_and_clashing_columns(spark):
    rows = vectors(200, 16, 6)
    df = frame(spark, rows).withColumn("id", h.F.lit("x")).withColumn("code", h.F.lit(3)).withColumn("vector", h.F.lit(1))
    codes, books = h.compress(df)
    salted = sorted(map(tuple, h.label_errors(codes, most_labels=2).collect()), key=str)
    assert salted == sorted(map(tuple, h.label_errors(codes).collect()), key=str)
    back = h.decoded(codes, books).orderBy("id").collect()
    off = np.array([r["vector"] for r in back]) - np.array([v for _, v, _ in rows])
    assert np.allclose((off**2).sum(1) * 65536, [r["error"] for r in back], rtol=0.1, atol=200)
