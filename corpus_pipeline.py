"""The corpus pipeline: quality, near-duplicates, benchmark items, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents. A stage works on all rows that the one before
kept; a null text is kept as long as no stage's rule speaks against it.

Defined cases: a null text and an empty one have statistics of 0, no shingles, no personal data and no tokens; a row
without an id is judged by its text in the first stage, is kept by the two that remove by id, and goes through the last
two like any other; very long texts are read whole in every stage; of a group of near-duplicates the smallest id stays,
and of equal rows of one id one; an empty table gives an empty result. Further columns pass through all stages but the
last, whatever their names; the last one returns its own columns with lang and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import bpe, decontam, neardup, pii, quality
from fieldmark.llm.common import drop_table, materialize, of_ids, table, temporary, without_ids
from fieldmark.llm.queries import default_coder


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rule ensemble doesn't reject; it learns from the labels of rows that aren't held out."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id; shingles of five words, similar from 80 percent.

    Of equal rows of one id one stays; rows of one id that differ in any column all stay, as they are one document.
    Rows without an id aren't touched.
    """
    groups = neardup.near_duplicates(docs, words=5, percent=80)
    kept = without_ids(docs, materialize(groups.where(~F.col("kept")).select("doc_id").distinct(), "dropped"))
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    repeated = materialize(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    return without_ids(kept, repeated).unionByName(of_ids(kept, repeated).distinct())


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item."""
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without_ids(docs, materialize(found.select("doc_id").distinct(), "contaminated"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with each span of personal data replaced by its kind and n_chars counted anew."""
    return pii.redact_column(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and digests of the ids and of what they decode to."""
    return bpe.digest(docs, default_coder(), keep=("lang", "source"))


STAGES = [
    ("quality classifier", filter_quality),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", redact_personal_data),
    ("byte-level BPE", encode_tokens),
]

#: Trained rules, checksums and merges of ranks are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        with temporary(spark):
            read, docs = docs, materialize(stage(spark, docs, sf_dir), "stage", outer=True)
        if i:
            drop_table(read)
    return docs
