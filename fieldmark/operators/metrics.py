"""What may be logged of an extraction: timings, agreement and numbers of statuses, never values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fieldmark.schemas import STATUSES

ALLOWED = ("doc_id", "elapsed_ms", "matched", "compared", "total", "ok", "review", "missing", "status", "n", "model", "stage", "seconds", "rows")


def _with_status(status: str) -> Column:
    statuses = F.transform(F.map_values("fields"), lambda f: f["status"])
    return F.size(F.filter(statuses, lambda x: x == status))


def extraction_metrics(responses: DataFrame) -> DataFrame:
    return guarded(responses.select("doc_id", "elapsed_ms", "agreement.*", *[_with_status(s).alias(s) for s in STATUSES]))


def observed(responses: DataFrame) -> tuple[DataFrame, Observation]:
    """responses, and an observation that counts them while whatever writes them runs; no second pass, no other job.

    Its values once that job is done: rows, sums of ok, review, missing, matched, compared and elapsed_ms. They may all be
    logged. A retried task's rows count once, those of a job that runs again count in its last run.
    """
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = [whole(_with_status(s)).alias(s) for s in STATUSES] + [whole(F.col(f"agreement.{c}")).alias(c) for c in ("matched", "compared")]
    counts = [F.count(F.lit(1)).alias("rows"), *sums, whole(F.col("elapsed_ms")).alias("elapsed_ms")]
    seen = Observation()
    return responses.observe(seen, *counts), seen


def status_histogram(fields: DataFrame) -> DataFrame:
    return guarded(fields.groupBy("status").agg(F.count(F.lit(1)).alias("n")))


def guarded(metrics: DataFrame) -> DataFrame:
    """metrics, if all of its columns may be logged."""
    if bad := [c for c in metrics.columns if c not in ALLOWED]:
        raise ValueError(f"columns that may hold values can't be logged: {', '.join(bad)}")
    return metrics


def log_line(row) -> str:
    return f"extract elapsed_ms={row['elapsed_ms']} agreement={row['matched']}/{row['total']} ok={row['ok']} review={row['review']} missing={row['missing']}"


def log_lines(metrics: DataFrame) -> DataFrame:
    """doc_id and the line of each row, in the JVM."""
    c = [F.col(k) for k in ("elapsed_ms", "matched", "total", "ok", "review", "missing")]
    return guarded(metrics).select("doc_id", F.format_string("extract elapsed_ms=%d agreement=%d/%d ok=%d review=%d missing=%d", *c).alias("line"))
