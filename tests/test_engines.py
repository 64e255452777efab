"""Bounded batches, devices, extraction as a stream, and counts taken on the way."""

import math
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from fieldmark.functions.geometry import Grid
from fieldmark.operators import devices, extract, inference, metrics
from fieldmark.plans import catalogue
from fieldmark.settings import Settings
from fieldmark.sources import writers
from fieldmark.streaming import watch


def skewed(n, seed):
    dice = random.Random(seed)
    return [int(2 ** dice.uniform(0, 14)) for _ in range(n)]


@pytest.mark.parametrize("bounds", [inference.Bounds(5, 4000, 10**9), inference.Bounds(1000, 20_000, 3_000_000), inference.Bounds(1, 1, 1)])
def test_planned_batches_keep_their_bounds(bounds):
    tokens, pixels = skewed(700, 1), [1000 * x for x in skewed(700, 2)]
    made = inference.planned(tokens, pixels, bounds)
    assert sorted(i for b in made for i in b) == list(range(700))
    for b in made:
        fits = len(b) <= bounds.requests and max(tokens[i] for i in b) * len(b) <= bounds.tokens and sum(pixels[i] for i in b) <= bounds.pixels
        assert fits or len(b) == 1
    assert inference.planned([], [], bounds) == []


def test_padding_is_less_than_in_the_order_of_keys():
    tokens, bounds = skewed(700, 3), inference.Bounds(24, 16_384, 1)
    padded = sum(max(tokens[i] for i in b) * len(b) for b in inference.planned(tokens, [0] * 700, bounds))
    by_key = sum(max(tokens[i : i + 24]) * len(tokens[i : i + 24]) for i in range(0, 700, 24))
    assert padded < 1.5 * sum(tokens) < by_key


def test_an_engine_asks_once_and_answers_in_order(spark):
    lengths = skewed(400, 5)
    asked = spark.createDataFrame([(i // 2, "AB"[i % 2], 1, "x" * 3 * n + f"#{i}") for i, n in enumerate(lengths)], "doc_id long, reading string, attempt int, prompt string").repartition(3)
    bounds = inference.Bounds(16, 9000, 1, window=100)

    def load():
        def model(batch, cap):
            call = uuid.uuid4().hex
            return [f"{call} {len(batch)} {max(inference.rough_tokens([q for q, _ in batch]))} {cap} {p.split('#')[1]}" for p, _ in batch]

        return model

    replies = inference.BatchEngine(load, "m", devices.Device("cpu"), bounds=bounds, most_new_tokens=64).generate(asked)
    placed = replies.withColumn("task", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).collect()
    assert len(placed) == 400
    calls = {}
    for r in placed:
        call, n, longest, cap, i = r["text"].split()
        assert int(i) == 2 * r["doc_id"] + "AB".index(r["reading"]) and cap == "64"
        assert int(n) <= 16 and (int(n) * int(longest) <= 9000 or n == "1")
        calls[call] = calls.get(call, 0) + 1
        assert calls[call] <= int(n)
    assert all(calls[r["text"].split()[0]] == int(r["text"].split()[1]) for r in placed)
    for task in {r["task"] for r in placed}:
        keys = [(r["doc_id"], r["reading"]) for r in sorted((r for r in placed if r["task"] == task), key=lambda r: r["at"])]
        assert keys == sorted(keys)


def test_no_device_is_a_refusal_before_any_work(spark, tmp_path):
    mark = tmp_path / "loaded"
    docs = spark.range(4).withColumnRenamed("id", "doc_id")

    def load(device):
        mark.write_text(device)
        return lambda batch: [device for _ in batch]

    auto = inference.BatchEngine(load, "m", devices.Device())
    with pytest.raises(devices.NoDevice, match="'cpu'"):
        auto.generate(inference.requests(docs))
    assert not mark.exists() and auto.ready(spark) == (False, None)
    info = inference.engine_info(spark, auto).first()
    assert info["device"] == "auto" and not info["loaded"]
    cpu = inference.BatchEngine(load, "m", devices.Device("cpu"))
    assert {r["text"] for r in cpu.generate(inference.requests(docs)).collect()} == {"cpu"} and mark.exists()
    assert {r["text"] for r in inference.BatchEngine(load, "m", devices.Device("npu:3")).generate(inference.requests(docs)).collect()} == {"npu:3"}


def test_profiles_ask_for_what_a_task_holds():
    made = devices.Device(per_task=0.5, cores=2, grow=True, per_executor=2, discovery="/opt/find").profile()
    assert made.taskResources["gpu"].amount == 0.5 and made.taskResources["cpus"].amount == 2
    assert made.executorResources["gpu"].amount == 2 and made.executorResources["gpu"].discoveryScript == "/opt/find" and made.executorResources["cores"].amount == 8
    assert devices.Device().profile().executorResources == {} and devices.Device("cpu").profile() is None


def test_the_peak_is_the_largest_of_all_tasks(spark):
    docs = spark.range(60).withColumnRenamed("id", "doc_id")

    def load():
        return lambda batch: ["a" for _ in batch]

    def used():
        from pyspark import TaskContext

        return 100 + TaskContext.get().partitionId()

    engine = inference.BatchEngine(load, "m", used_mb=used, tasks=5)
    assert engine.generate(inference.requests(docs)).count() == 180
    assert 100 < engine.peak_mb.value < 110 and inference.engine_info(spark, engine).first()["vram_mb"] == engine.peak_mb.value


def test_grid_sizes_as_plain_arithmetic(spark):
    grid, sizes = Grid(), [(w, h) for w in (1, 13, 28, 42, 300, 1000, 2500, 9000) for h in (1, 40, 41, 200, 999, 4000)] + [(0, 5), (None, 5), (-1, 9)]

    def plain(w, h):
        if not w or not h or min(w, h) <= 0 or max(w, h) / min(w, h) > 200:
            return w, h
        a, b = (max(28, round(x / 28) * 28) for x in (w, h))
        if a * b > grid.most:
            k = math.sqrt(w * h / grid.most)
            a, b = (max(28, math.floor(x / k / 28) * 28) for x in (w, h))
        elif a * b < grid.least:
            k = math.sqrt(grid.least / (w * h))
            a, b = (math.ceil(x * k / 28) * 28 for x in (w, h))
        return a, b

    df = spark.createDataFrame(sizes, "w int, h int")
    for r in df.select("w", "h", *[c.alias(n) for c, n in zip(grid.processed(F.col("w"), F.col("h")), ("pw", "ph"))]).collect():
        assert (r["pw"], r["ph"]) == plain(r["w"], r["h"]), r


def test_an_engine_with_a_grid_gives_boxes_in_the_image(spark):
    reply = lambda _: F.when(F.col("reading") == "C", '{"full_name": [100, 50, 400, 90]}').otherwise('{"full_name": "JO HAM"}')
    engine = inference.ExpressionEngine(reply)
    engine.grid = Grid()
    docs = spark.createDataFrame([(1, 2000, 1200)], "doc_id long, w int, h int")
    with writers.Stored(spark) as keep:
        box = extract.extract(docs, engine, keep=keep).select("fields.full_name.box.*").first()
    assert tuple(box) == tuple(round(x * s) for x, s in zip((100, 50, 400, 90), (2000 / 1288, 1200 / 756) * 2))


def _landing(spark, path, ids, part):
    spark.createDataFrame([(i, 1000, 600) for i in ids], "doc_id long, w int, h int").coalesce(1).write.mode("append").json(str(path))


def test_a_stream_goes_on_after_a_failure(spark, tmp_path):
    schema, landing, out, state = "doc_id long, w int, h int", tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    lines = lambda: sorted(r["value"] for r in spark.read.text(f"{out}/*").collect()) if os.path.exists(out) else []
    shared = writers.scratch(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    seen = []

    def engine(bad):
        said = F.when(F.col("doc_id") == bad, F.raise_error(F.lit("the model broke")).cast("string")).when((F.col("doc_id") % 3 == 0) & (F.col("attempt") == 1), "no card")
        return inference.ExpressionEngine(lambda _: said.otherwise(F.concat(F.lit('{"id_number": "'), (F.col("doc_id") + 10_000_000).cast("string"), F.lit('"}'))))

    def go(bad):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(landing))
        watch.extract_each(stream, engine(bad), out, state, Settings(), "2026-01-01", None, told=lambda n, counts: seen.append((n, counts["rows"]))).awaitTermination()

    _landing(spark, landing, range(5), 0)
    go(None)
    first = lines()
    assert len(first) == 5 and all('"10000' in x for x in first)
    _landing(spark, landing, range(10, 14), 1)
    with pytest.raises(Exception, match="the model broke"):
        go(12)
    assert lines() == first
    go(None)
    assert len(lines()) == 9 and set(first) < set(lines())
    go(None)
    assert len(lines()) == 9 and sum(n for _, n in seen) == 9 and len({n for n, _ in seen}) == len(seen)
    assert set(os.listdir(shared)) == before


def test_the_last_of_each_source(spark):
    df = spark.createDataFrame([("a", 1, "p"), ("a", 3, "q"), ("b", 2, "r"), ("a", 3, "z")], "camera string, modificationTime int, path string")
    assert {tuple(r) for r in watch.newest(df, "camera").select("camera", "path").collect()} == {("a", "z"), ("b", "r")}


def test_counts_are_taken_by_the_job_that_writes(spark, sf, tmp_path):
    responses = writers.stored(catalogue._responses(spark, sf))
    spark.sparkContext.setJobGroup("written", "")
    counts = writers.write_responses(responses, str(tmp_path / "out"))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("written")) == 1
    spark.sparkContext.setJobGroup("other", "")
    each = metrics.extraction_metrics(responses).agg(F.count("doc_id"), *[F.sum(c) for c in ("ok", "review", "missing", "matched", "compared")]).first()
    assert [counts[c] for c in ("rows", "ok", "review", "missing", "matched", "compared")] == list(each) and set(counts) <= {*metrics.ALLOWED}
    none = writers.write_responses(responses.limit(0), str(tmp_path / "none"))
    assert set(none.values()) == {0}


def test_extraction_stores_two_tables(spark, sf):
    made = []

    def keep(df):
        made.append(1)
        return writers.stored(df)

    docs, engine = catalogue._scripted(catalogue.card_pairs(spark, sf))
    assert extract.extract(docs, engine, keep=keep).count() == docs.count() and len(made) == 2
