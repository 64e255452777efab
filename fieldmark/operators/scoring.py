"""Results against ground truth: exact matches, silent errors, boxes, latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions import geometry as g
from fieldmark.functions.text import normalised
from fieldmark.operators.boxes import CORNERS
from fieldmark.schemas import ARABIC, FIELDS

HIT = 0.5  # fixed value: the overlap from which a box is a hit


def missing_truth(results: DataFrame, truth: DataFrame, key: str = "image") -> DataFrame:
    """Keys of results that the truth doesn't know; scoring asks for none."""
    return results.select(key).distinct().join(truth.select(key).distinct(), key, "left_anti")


def require_truth(results: DataFrame, truth: DataFrame, key: str = "image") -> None:
    if lost := missing_truth(results, truth, key).limit(5).collect():
        raise KeyError(f"no ground truth for {', '.join(str(r[0]) for r in lost)}")


def compare(results: DataFrame, truth: DataFrame, key: str = "image") -> DataFrame:
    """Long results (key, field, value, value_ar, status) beside want and want_ar, with correct and correct_ar.

    A document must be in the truth (an inner join; see require_truth); a field that isn't there is wanted null. Null
    counts as empty. An Arabic value is only compared where the truth has one, and only for the fields that have it.
    """
    known = truth.select(key).distinct()
    joined = results.join(known, key, "left_semi").join(truth.select(key, "field", "want", "want_ar"), [key, "field"], "left")
    empty = lambda c: F.coalesce(c, F.lit(""))
    joined = joined.withColumn("_n", normalised([empty(F.col(c)) for c in ("value", "want", "value_ar", "want_ar")]))
    n = F.col("_n")
    arabic = F.col("field").isin(*ARABIC) & F.col("want_ar").isNotNull()
    return joined.withColumns({"correct": n[0] == n[1], "correct_ar": F.when(arabic, n[2] == n[3])}).drop("_n")


def field_dimension(spark) -> DataFrame:
    return spark.createDataFrame([(i, f) for i, f in enumerate(FIELDS)], "ordinal int, field string")


def per_field(compared: DataFrame) -> DataFrame:
    """One row for every field, also without results: ordinal, field, exact, ok, review, missing, n."""
    count = lambda c: F.count_if(c)
    made = compared.groupBy("field").agg(
        count(F.col("correct")).alias("exact"), *[count(F.col("status") == s).alias(s) for s in ("ok", "review", "missing")], F.count(F.lit(1)).alias("n"),
    )
    all_fields = F.broadcast(field_dimension(compared.sparkSession))  # six rows
    return made.join(all_fields, "field", "right").select("ordinal", "field", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("exact", "ok", "review", "missing", "n")])


def silent_errors(compared: DataFrame, key: str = "image") -> DataFrame:
    """key, field (or field_ar), got, expected of every wrong value that was served as ok; one pass over the comparison."""
    row = lambda field, got, want, bad: F.when(bad, F.struct(field.alias("field"), F.coalesce(got, F.lit("")).alias("got"), F.coalesce(want, F.lit("")).alias("expected")))
    latin = row(F.col("field"), F.col("value"), F.col("want"), ~F.col("correct"))
    arabic = row(F.concat("field", F.lit("_ar")), F.col("value_ar"), F.col("want_ar"), ~F.col("correct_ar"))
    served = compared.where("status = 'ok' AND (NOT correct OR NOT coalesce(correct_ar, true))")
    return served.select(key, F.explode_outer(F.array_compact(F.array(latin, arabic))).alias("e")).where("e IS NOT NULL").select(key, "e.*")


def silent_error_rate(compared: DataFrame) -> DataFrame:
    """n_silent, total, percent. Arabic errors count above the line only, so it may pass 100; 0 without results."""
    bad = F.col("status") == "ok"
    n = F.count_if(bad & ~F.col("correct")) + F.count_if(bad & ~F.col("correct_ar"))
    made = compared.agg(n.alias("n_silent"), F.count(F.lit(1)).alias("total"))
    return made.withColumn("percent", F.coalesce(F.try_divide(F.col("n_silent") * 100.0, F.col("total")), F.lit(0.0)))


def box_counts(pairs: DataFrame) -> DataFrame:
    """Of rows with struct columns box and true_box: hits, total (both), expected (true), coverage and hit_rate in percent (null: none)."""
    corners = lambda b: [F.col(b)[c] for c in CORNERS]
    both = F.col("box").isNotNull() & F.col("true_box").isNotNull()
    made = pairs.agg(
        F.count_if(both & (g.overlap(corners("box"), corners("true_box")) >= HIT)).alias("hits"), F.count_if(both).alias("total"), F.count_if(F.col("true_box").isNotNull()).alias("expected"),
    )
    return made.withColumns({"coverage": F.try_divide(F.col("total") * 100.0, F.col("expected")), "hit_rate": F.try_divide(F.col("hits") * 100.0, F.col("total"))})


def latency_summary(times: DataFrame, ms: str = "elapsed_ms") -> DataFrame:
    """median_ms (the upper one) and max_ms.

    Times are counted by value first, and the middle is sought among whole seconds and then inside one of them, so neither
    ordered step runs over more than the seconds that a request may take, or a thousand values.
    """
    counts = times.where(F.col(ms).isNotNull()).groupBy(F.col(ms).alias("ms")).agg(F.count(F.lit(1)).alias("n")).withColumn("second", F.floor(F.col("ms") / 1000))
    before = lambda key: F.coalesce(F.sum("n").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seconds = counts.groupBy("second").agg(F.sum("n").alias("n"), F.max("ms").alias("most")).withColumn("before", before("second"))
    seconds = seconds.withColumns({"total": F.sum("n").over(Window.partitionBy()), "max_ms": F.max("most").over(Window.partitionBy())})
    middle = seconds.where("before <= floor(total / 2) AND before + n > floor(total / 2)").select("second", F.col("before").alias("_before"), "total", "max_ms")
    inside = counts.join(F.broadcast(middle), "second").withColumn("upto", F.col("_before") + before("ms") + F.col("n"))  # one row
    return inside.where("upto > floor(total / 2)").agg(F.min("ms").alias("median_ms"), F.max("max_ms").alias("max_ms"))


def summary(compared: DataFrame, pairs: DataFrame, times: DataFrame, self_consistency: bool = True) -> DataFrame:
    """One row of the whole report: silent errors, boxes, latency, and comparable: whether there was a second reading, without which silent errors compare with no normal run."""
    boxes = box_counts(pairs).select("hits", F.col("total").alias("boxes"), F.col("expected").alias("boxes_expected"), "coverage", "hit_rate")
    row = silent_error_rate(compared).crossJoin(F.broadcast(boxes)).crossJoin(F.broadcast(latency_summary(times)))  # one row each
    return row.withColumn("comparable", F.lit(self_consistency))


def report_text(per_field_rows: list, silent: list, rate, boxes, latency, self_consistency: bool = True) -> str:
    """A report for people, from collected rows of the frames above (a few rows each; silent: those to list)."""
    lines = []
    if not self_consistency:
        lines += ["WARNING: there was no second reading, so these silent errors compare with no normal run.", ""]
    lines.append(f"{'field':<16}{'exact':>12}{'ok':>8}{'review':>8}{'missing':>8}")
    lines += [f"{r['field']:<16}{r['exact']:>6}/{r['n']:<5}{r['ok']:>8}{r['review']:>8}{r['missing']:>8}" for r in sorted(per_field_rows, key=lambda r: r["ordinal"])]
    lines += ["", f"silent errors: {rate['n_silent']}/{rate['total']} ({rate['percent']:.1f}%)"]
    lines += [f"  {r[0]} {r['field']}: got {r['got']!r}, expected {r['expected']!r}" for r in silent]
    lines.append(f"boxes returned: {boxes['total']}/{boxes['expected']} ({boxes['coverage']:.1f}%)" if boxes["expected"] else "boxes returned: the truth has none")
    lines.append(f"box hits: {boxes['hits']}/{boxes['total']} ({boxes['hit_rate']:.1f}%) at an overlap of {HIT}" if boxes["total"] else "box hits: none returned")
    if latency["max_ms"] is not None:
        lines.append(f"latency: median {latency['median_ms']} ms, max {latency['max_ms']} ms")
    return "\n".join(lines)
