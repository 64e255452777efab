"""The plain tables and the inputs derived from them, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.plans import fixtures
from fieldmark.schemas import CARD_KEYS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, sql: str, *tables: str, **frames: DataFrame) -> DataFrame:
    """The relation of a fixture; its tables' names become parameters, so that no view is left behind."""
    given = {t: table(spark, sf_dir, t) for t in tables} | frames
    sql = sql.replace("{", "{{").replace("}", "}}")  # braces of the text itself
    for name in given:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return spark.sql(sql, **given)


def truth_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, fixtures.TRUTH, "customer")


def card_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, a_<key>, b_<key>, b_present: both readings of a document beside each other, from one row, without a join."""
    return card_pairs_of(table(spark, sf_dir, "customer"))


def card_pairs_of(customer: DataFrame) -> DataFrame:
    """card_pairs of given customers."""
    spark, sf_dir = customer.sparkSession, ""
    first = derived(spark, sf_dir, fixtures.FIRST, t=derived(spark, sf_dir, fixtures.TRUTH, customer=customer))
    kept = ", ".join(f"{k} AS a_{k}" for k in CARD_KEYS)
    all_rows = fixtures.SECOND.replace(" WHERE doc_id % 73 <> 5", "").replace("SELECT doc_id,", f"SELECT doc_id, {kept},")
    second = derived(spark, sf_dir, all_rows, a=first)
    present = F.col("doc_id") % 73 != 5
    return second.select("doc_id", *[f"a_{k}" for k in CARD_KEYS], *[F.when(present, F.col(k)).alias(f"b_{k}") for k in CARD_KEYS], present.alias("b_present"))


def card_structs(pairs: DataFrame) -> DataFrame:
    """doc_id, a, b of card_pairs as structs; b is null where there was no second reading."""
    card = lambda x: F.struct(*[F.col(f"{x}_{k}").alias(k) for k in CARD_KEYS])
    return pairs.select("doc_id", card("a").alias("a"), F.when(F.col("b_present"), card("b")).alias("b"))
