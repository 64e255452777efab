"""Benchmark decontamination: short test items inside long documents, in DataFrame functions only.

An item is contained in a document if at least ``contained`` of its distinct word shingles occur there. The search is
an asymmetric MinHash: of an item's shingles, each of some hash functions keeps the shingle with the least value,
and the share of these samples that occur in the document estimates the containment, however long the document is.
(Signatures on both sides can't do this: an item of 40 words in a document of 20,000 has a similarity of 0.002, which no
affordable number of bands finds.) Sizes are partitioned on both sides. Items: those with no more shingles than there are
samples give all of them, and as many must occur as the containment says, so none of these is missed; larger ones give
samples, of which so many must occur that an item with the containment sought is missed with a probability below
``MISSED`` (``sampling`` derives both numbers from the containment). Documents, by powers of two: one whose partition's
upper bound is below the part of the item that must occur is no candidate. Candidates are verified on exact sets.

Documents are read twice: once for the samples, a row for each shingle that meets a broadcast table (an exchange where
the samples are many), and once for the candidates' full sets. What is shuffled is matches alone.

Defined cases: null or blank texts and items have no shingles and match nothing; a text with fewer words than a shingle is
one shingle of all its words; repeated items and documents are judged by id, and rows without an id are not judged; very
long texts are searched whole; further columns are ignored, also where their names are used here; empty tables give an
empty result.
"""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import bind, if_few_bytes, if_small, materialize, runs_of, temporary, word_hashes

WORDS, CONTAINED, SAMPLES, MISSED = 5, 0.8, 24, 2e-7
#: Containments below this aren't sought: they would take thousands of samples.
LEAST_CONTAINED = 0.05
#: So many samples (some 40 bytes each), documents with their candidates' ids, or bytes of items' full sets at most are broadcast.
BROADCAST_SAMPLES, BROADCAST_LISTS, BROADCAST_ITEMS = 200_000, 16 << 20, 32 << 20


def shingle_set(text: Column, words: int = WORDS) -> Column:
    """Distinct 64-bit hashes of a text's word shingles."""

    def of_hashes(h: Column) -> Column:
        whole = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(h) >= words, runs_of(h, words)).otherwise(whole)

    return F.array_distinct(bind(word_hashes(text), of_hashes))


@cache
def sampling(contained: float, missed: float = MISSED) -> tuple[int, int]:
    """How many samples of an item are drawn, SAMPLES at least, and how many of them a document with that containment has but for a chance of ``missed``.

    A sample is any shingle alike, so hits are binomial. Samples are drawn until two fifths of those expected may be asked for.
    """
    if not LEAST_CONTAINED <= contained <= 1:
        raise ValueError(f"a containment from {LEAST_CONTAINED} to 1 can be sought")
    drawn = SAMPLES
    while True:
        chance, needed = 0.0, 0
        while needed < drawn and (chance := chance + math.comb(drawn, needed) * contained**needed * (1 - contained) ** (drawn - needed)) <= missed:
            needed += 1
        if needed >= max(2, 0.4 * contained * drawn):
            return drawn, needed
        drawn += 8


def min_samples(shingles: Column, samples: int = SAMPLES) -> Column:
    """The shingle with the least value under each hash function; one shingle may be least under several."""
    least = lambda i: F.array_min(F.transform(shingles, lambda x: F.struct(F.xxhash64(x, i).alias("v"), x.alias("x"))))["x"]
    return F.transform(F.sequence(F.lit(1), F.lit(samples)), least)


def _items(benchmark: DataFrame, words: int) -> DataFrame:
    sets = benchmark.select("item_id", shingle_set(F.col("text"), words).alias("item_set")).where("size(item_set) > 0")
    # several texts under one id are one item: all their shingles
    merged = sets.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("item_set"))).alias("item_set"))
    return materialize(merged.withColumn("item_n", F.size("item_set").cast("long")), "items")


def candidates(docs: DataFrame, items: DataFrame, words: int = WORDS, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id) that the samples and the size partitions admit."""
    samples, needed = sampling(contained)
    whole = F.col("item_n") <= samples
    asked = F.when(whole, F.ceil(contained * F.col("item_n") - 1e-9)).otherwise(needed).cast("long")
    drawn = items.select("item_id", "item_n", asked.alias("needed"), F.explode(F.when(whole, F.col("item_set")).otherwise(min_samples(F.col("item_set"), samples))).alias("h"))
    drawn = materialize(drawn.groupBy("h", "item_id", "item_n", "needed").agg(F.count(F.lit(1)).alias("weight")), "item-samples")
    rows = docs.select("doc_id", shingle_set(F.col("text"), words).alias("s"))
    rows = rows.select("doc_id", F.pow(F.lit(2), F.ceil(F.log2(F.size("s")))).alias("bound"), F.explode("s").alias("h"))
    met = rows.join(if_small(drawn, BROADCAST_SAMPLES), "h").where(F.col("bound") >= contained * F.col("item_n"))
    return met.groupBy("doc_id", "item_id", "needed").agg(F.sum("weight").alias("hits")).where(F.col("hits") >= F.col("needed")).select("doc_id", "item_id")


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, contained: float = CONTAINED) -> DataFrame:
    """doc_id, item_id, item_shingles, shared_shingles and containment of each item that a document contains, as a stored table."""
    with temporary(docs.sparkSession):
        return materialize(_contaminated(docs, benchmark, words, contained), "leaks", outer=True)


def _contaminated(docs: DataFrame, benchmark: DataFrame, words: int, contained: float) -> DataFrame:
    items = _items(benchmark, words)
    found = materialize(candidates(docs, items, words, contained), "leak-candidates")
    by_doc = materialize(found.groupBy("doc_id").agg(F.collect_set("item_id").alias("item_ids")), "leak-documents")
    sets = docs.select("doc_id", "text").join(if_few_bytes(by_doc, "item_ids", BROADCAST_LISTS), "doc_id").select("doc_id", "item_ids", shingle_set(F.col("text"), words).alias("s"))
    # the set once for each document, then its few items
    pairs = sets.select("doc_id", "s", F.explode("item_ids").alias("item_id")).join(if_few_bytes(items, "item_set", BROADCAST_ITEMS), "item_id")
    shared = F.size(F.array_intersect("item_set", "s")).cast("long")
    counted = pairs.select("doc_id", "item_id", F.col("item_n").alias("item_shingles"), shared.alias("shared_shingles"))
    # repeated rows of one id: the fullest counts
    best = counted.groupBy("doc_id", "item_id", "item_shingles").agg(F.max("shared_shingles").alias("shared_shingles"))
    share = F.col("shared_shingles") / F.col("item_shingles")
    return best.withColumn("containment", share).where(F.col("containment") >= contained)
