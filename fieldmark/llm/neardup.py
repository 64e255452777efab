"""Near-duplicates by MinHash with odd sketches.

Each document becomes the set of its distinct word shingles; documents with equal sets form a class, whose smallest id
goes on. A class has ``SAMPLES`` MinHash values. Bands of ``ROWS`` of them are bucket keys, and the values, each with its
position, are folded into a bitmap by parity: the odd sketch. The population count m of two sketches' XOR gives the
similarity 1 + BITS / (4 SAMPLES) * ln(1 - 2 m / BITS). A second bitmap folds the whole set: there m never exceeds the
symmetric difference, so it refutes pairs for certain. Bucket mates that both bitmaps admit are confirmed on full sets.

Before buckets are built, documents are left out that can be no near-duplicate: a shingle that no other class has
can't be shared, so a set with more than a fifth of such shingles (for 80 percent) is similar to no other. That is
counted on a hash sample of each set first, with a margin of ``SURE`` deviations, and then on the full sets of those
that are left; the same counts bound the overlap of a pair. A passage that many documents share ends here.

A bucket never gives all its pairs. Its members meet a leader first, the one with the fewest shingles of its own, links
become components, and after that only members of different components are compared, those outside the bucket's largest
component with all others, by the bitmaps and bounds inside the join. No pair is left out by a cap. Where these
comparisons would be many for each member, rounds with more leaders come before. Where many pairs for each document
are left to confirm, as in a group whose members are mostly just below the similarity sought, bitmaps of ``WIDE_BITS``
refute most of them, again for certain, before their texts are joined.

Two sets with similarity 0.8 share no band with a probability of (1 - 0.8 ** ROWS) ** (SAMPLES / ROWS) = 4e-7.

Defined cases: a null or blank text has no shingles and is linked with nothing; a text with fewer words than a
shingle is one shingle of all its words; rows with the same id count as one document; rows without an id take no
part in links and are kept (where several ids have the very set of theirs, they show the component of those); a very long
text is read whole, its set within one task; of equal sets and of a group the smallest id stays; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import drop_table, if_few_bytes, if_small, map_rows, materialize, of_ids, shuffles_go, temporary
from fieldmark.llm.components import components

SAMPLES, ROWS, BITS, SKETCH_CUT, WHOLE_BITS = 112, 4, 256, 0.5, 1024
#: A set's own hash sample has OWN to 2 OWN shingles (all of a small set); SURE is in standard deviations.
OWN, SURE = 32, 6
LEADER_ROUNDS, COMPARED_PER_MEMBER = 4, 1000
CACHE_ENTRIES, CACHE_BYTES = 150_000, 40
#: Pairs for each document beyond which wide bitmaps are built; bytes of sets and texts that a task of confirm() keeps.
PAIRS_PER_DOCUMENT, WIDE_BITS, CONFIRM_BYTES = 20, 4096, 32 << 20

_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(1, 2**63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, SAMPLES, np.uint64)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Distinct shingle hashes of texts; the words' hashes are kept in a cache of bounded size."""

    def __init__(self, words: int):
        self.words, self.cache = words, {}

    def _miss(self, word: bytes) -> bytes:
        found = xxhash.xxh64_digest(word)
        if len(word) <= CACHE_BYTES:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[word] = found
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles."""
        words, get = (text or "").encode().lower().split(), self.cache.get  # bytes: only A-Z, and the six ASCII spaces
        if not words:
            return np.empty(0, np.uint64)
        hashes = np.frombuffer(b"".join([get(w) or self._miss(w) for w in words]), ">u8").astype(np.uint64)
        n = min(self.words, len(words))
        sums = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            sums = sums * _STEP + hashes[i : len(words) - n + 1 + i]
        return np.unique(mixed(sums))


def minhashes(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[i : i + 2048] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.zeros(SAMPLES // ROWS, np.uint64)
    for i in range(ROWS):
        keys = mixed(keys * _STEP + least[i::ROWS])
    return mixed(keys + np.arange(len(keys), dtype=np.uint64) * _STEP).view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """BITS bits as 64-bit integers: each sample flips the bit of its position and value."""
    bits = mixed(least + np.arange(SAMPLES, dtype=np.uint64) * _STEP) % np.uint64(BITS)
    odd = np.bincount(bits.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parity_sketch(shingles: np.ndarray, bits: int = WHOLE_BITS) -> np.ndarray:
    """So many bits as 64-bit integers: each shingle flips one."""
    odd = np.bincount((mixed(shingles + _STEP) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch_similarity(a: np.ndarray, b: np.ndarray) -> float:
    m = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())  # of signed numbers it counts the absolute value
    return 1 + BITS / (4 * SAMPLES) * float(np.log(max(1e-9, 1 - 2 * m / BITS)))


def most_flips(cut: float = SKETCH_CUT) -> int:
    """The population count at which the estimate falls to the cut."""
    return int(BITS / 2 * (1 - np.exp((cut - 1) * 4 * SAMPLES / BITS)))


def hash_sample(shingles: np.ndarray) -> tuple[np.ndarray, int]:
    """The least hashes of a sorted set and how many of them are its own sample; the rest answers for sets half its size.

    The part of the hash range follows from the size's power of two, so similar sets sample the same part.
    """
    n = len(shingles)
    share = min(1.0, OWN / (1 << (n.bit_length() - 1)))
    upto = lambda part: n if part >= 1 else int(np.searchsorted(shingles, np.uint64(int(part * 2**64))))
    return shingles[: upto(2 * share)], upto(share)


SKETCH = "doc_id long, n_shingles long, class binary, mark long, bands array<long>, odd array<long>, whole array<long>, sample array<long>, own int"


def class_digest(shingles: np.ndarray) -> tuple[bytes, int]:
    """A digest of a set, and its mark: the first half as a number, which tells the texts of one id apart."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return digest, int.from_bytes(digest[:8], "little", signed=True)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, class (a digest of the set; null without shingles) and its mark, bands, both bitmaps and the hash sample."""
    names = [x.split()[0] for x in SKETCH.split(", ")][1:]

    def make():
        shingle = Shingler(words)

        def row(text) -> tuple:
            found = shingle(text)
            if not len(found):
                return (0, *[None] * 7)
            least = minhashes(found)
            sample, own = hash_sample(found)
            return (len(found), *class_digest(found), band_keys(least), odd_sketch(least), parity_sketch(found), sample.view(np.int64), own)

        def work(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("doc_id")} | dict(zip(names, zip(*[row(t.as_py()) for t in batch.column("text")])))

        return work

    return map_rows(docs, ["doc_id", "text"], SKETCH, make, "text", 1000)


def _flips(a: Column, b: Column, bits: int) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(bits // 64)])


def may_link(x: str, y: str, percent: int) -> Column:
    """Whether sizes, own shingles and both bitmaps of the rows x and y allow that similarity."""
    c = lambda k, n: F.col(f"{k}.{n}")
    sizes = c(x, "n") + c(y, "n")
    shared = F.least(c(x, "n") - c(x, "u"), c(y, "n") - c(y, "u"))
    bound = 100 * shared >= percent * (sizes - shared)
    whole = _flips(c(x, "whole"), c(y, "whole"), WHOLE_BITS) * (100 + percent) <= (100 - percent) * sizes
    return bound & whole & (_flips(c(x, "odd"), c(y, "odd"), BITS) <= most_flips(min(SKETCH_CUT, percent / 100 - 0.3)))


def refuted_out(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) without those that wide bitmaps refute, where there are many for each document.

    Ids with several texts have no wide bitmap, and their pairs stay.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = materialize(ids, "pair-ids")
    if pairs.count() <= PAIRS_PER_DOCUMENT * ids.count():
        return pairs

    def make():
        shingle = Shingler(words)

        def work(batch: pa.RecordBatch) -> dict:
            sets = [shingle(t.as_py()) for t in batch.column("text")]
            return {"doc_id": batch.column("doc_id"), "n": [len(s) for s in sets], "wide": [parity_sketch(s, WIDE_BITS) for s in sets]}

        return work

    single = of_ids(texts.where("NOT several").select("doc_id", "text"), ids)
    wide = map_rows(single, ["doc_id", "text"], "doc_id long, n int, wide array<long>", make, "text", 1000)
    wide = materialize(wide.groupBy("doc_id").agg(F.any_value("n").alias("n"), F.any_value("wide").alias("wide")), "wide-bitmaps")
    side = lambda k: if_few_bytes(wide.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("wide").alias(f"wide_{k}")), f"wide_{k}")
    flips = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda sum_, n: sum_ + n)
    admitted = flips * (100 + percent) <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return materialize(both.where(F.coalesce(admitted, F.lit(True))).select("a", "b"), "pairs")


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents whose full sets have that similarity."""
    side = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def make():
        shingle, sets, held = Shingler(words), {}, 0

        def set_of(text: str | None) -> np.ndarray:
            nonlocal held
            found = sets.get(text)
            if found is None:
                if held > CONFIRM_BYTES:
                    sets.clear()
                    held = 0
                sets[text] = found = shingle(text)
                held += found.nbytes + 4 * len(text or "")
            return found

        def work(batch: pa.RecordBatch) -> dict:
            a, b, out = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for i, (ta, tb) in enumerate(zip(batch.column("text_a"), batch.column("text_b"))):
                x, y = set_of(ta.as_py()), set_of(tb.as_py())
                same = len(np.intersect1d(x, y, assume_unique=True))
                if same and 100 * same >= percent * (len(x) + len(y) - same):
                    out.append(i)
            return {"a": [a[i] for i in out], "b": [b[i] for i in out]}

        return work

    return materialize(map_rows(both, ["a", "b", "text_a", "text_b"], "a long, b long", make, "text_b"), "confirmed")


def _singular(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, u): how many of each text's rows (doc_id, mark, h, own) that are its own no other text has."""
    once = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.min("mark").alias("mark"), F.min("own").alias("own")).where("n = 1 AND own")
    return once.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("u"))


def linkable(classes: DataFrame, percent: int) -> DataFrame:
    """(doc_id, mark) of the classes that may be similar to another, judged on hash samples."""
    own = (F.col("pos") < F.col("own")).alias("own")
    drawn = classes.select("doc_id", "mark", F.col("own"), F.posexplode("sample").alias("pos", "h")).select("doc_id", "mark", "h", own)
    share = 1 - percent / 100
    most = F.col("own") * share + SURE * F.sqrt(F.col("own") * share * (1 - share))
    # a sample that is the whole set needs no margin
    most = F.when(F.col("own") == F.col("n_shingles"), F.col("n_shingles") * share + 1e-9).otherwise(most)
    return classes.select("doc_id", "mark", "n_shingles", "own").join(_singular(drawn), ["doc_id", "mark"], "left").where(F.coalesce("u", F.lit(0)) <= most).select("doc_id", "mark")


def shingle_rows(texts: DataFrame, words: int) -> DataFrame:
    def make():
        shingle = Shingler(words)

        def work(batch: pa.RecordBatch) -> dict:
            sets = [shingle(t.as_py()).view(np.int64) for t in batch.column("text")]
            marks = [class_digest(s)[1] if one_of else 0 for s, one_of in zip(sets, batch.column("several").to_pylist())]
            ids, marks = (np.repeat(x, [len(s) for s in sets]) for x in (batch.column("doc_id").to_numpy(), np.array(marks, np.int64)))
            return {"doc_id": ids, "mark": marks, "h": np.concatenate(sets), "own": np.ones(len(ids), bool)}

        return work

    return map_rows(texts, ["doc_id", "text", "several"], "doc_id long, mark long, h long, own boolean", make, "text", 500)


def _tell_texts(rows: DataFrame, same_id: DataFrame | None) -> DataFrame:
    """rows with several: whether the id has different texts."""
    if same_id is None:
        return rows.withColumn("several", F.lit(False))
    return rows.join(if_small(same_id), "doc_id", "left").withColumn("several", F.coalesce("several", F.lit(False)))


ATTRIBUTES = ("id", "component", "n", "u", "odd", "whole")


def _led(members: DataFrame, leaders: int, percent: int) -> DataFrame:
    """Pairs of members of a bucket with its leaders that may be links; a leader has the least share of own shingles in its slot."""
    order = F.struct((F.col("u") / F.col("n")).alias("rank"), *ATTRIBUTES)
    slot = F.pmod(F.xxhash64("id"), F.lit(leaders)).alias("slot")
    led = members.groupBy("bucket", slot).agg(F.min(order).alias("l")).select("bucket", "l.*")
    led = materialize(led, "leaders").alias("y")
    meet = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") != F.col("y.component"))
    return members.alias("x").join(led, meet & may_link("x", "y", percent))


def _rest(members: DataFrame, main: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket's members in different components that may be links; one at least is outside the bucket's largest."""
    whose = materialize(members.join(main, "bucket"), "bucket-members")
    x, y = whose.where("component <> main").alias("x"), whose.alias("y")
    meet = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") != F.col("y.component"))
    once = (F.col("y.component") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    return x.join(y, meet & once & may_link("x", "y", percent))


def _split_buckets(members: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component."""
    several = members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    return materialize(members.join(materialize(several, "split-buckets"), "bucket", "left_semi"), "bucket-members")


def link_classes(nodes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, component) of the nodes (doc_id, n, u, bands, odd, whole) that are linked with others."""
    named = nodes.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component"), "n", "u", "odd", "whole", "bands")
    exploded = lambda df: df.select(*ATTRIBUTES, F.explode("bands").alias("bucket"))
    members = _split_buckets(exploded(named))
    links = labels = None
    for turn in range(1, LEADER_ROUNDS + 3):
        sizes = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
        main = materialize(sizes.agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top")).select("bucket", "all", F.col("top.component").alias("main"), F.col("top.n").alias("most")), "bucket-sizes")
        total, compared = main.agg(F.sum("all"), F.sum((F.col("all") - F.col("most")) * F.col("all"))).first()
        if not total:
            break
        final = turn > 1 and (compared <= COMPARED_PER_MEMBER * total or turn > LEADER_ROUNDS)
        pairs = _rest(members, main.select("bucket", "main"), percent) if final else _led(members, 4 ** (turn - 1), percent)
        pairs = materialize(pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), "pairs")
        found = confirm(refuted_out(pairs, texts, words, percent), texts, words, percent)
        links = found if links is None else links.unionByName(found)
        labels = materialize(components(links), "labels")
        if final:
            break
        # labels go to the nodes, which then deal out their bands again
        moved = named.drop("component").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        old, members = members, _split_buckets(exploded(moved))
        drop_table(old)
    return labels if labels is not None else nodes.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component")).limit(0)


def _labels(docs: DataFrame, all_docs: DataFrame, several: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, component) of the classes' documents that are linked with others."""
    by_id = all_docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi"), F.count("mark").alias("sets"), F.count(F.lit(1)).alias("n"))
    same_id = materialize(by_id.where("lo <> hi OR (sets > 0 AND sets < n)").select("doc_id", F.lit(True).alias("several")), "same-ids")
    same_id = None if same_id.isEmpty() else same_id
    # marks of ids with one text are 0, which the shuffles compress
    known = _tell_texts(all_docs.where("class IS NOT NULL AND doc_id IS NOT NULL"), same_id).withColumn("mark", F.when(F.col("several"), F.col("mark")).otherwise(0))
    classes = known.join(if_small(several), "class", "left").where(F.coalesce("first", "doc_id") == F.col("doc_id"))
    ids = materialize(linkable(classes, percent), "linkable")
    texts = materialize(_tell_texts(of_ids(docs, ids), same_id), "linkable-texts")
    singular = materialize(_singular(shingle_rows(texts, words)), "singular")
    u = F.coalesce("u", F.lit(0))
    nodes = known.join(if_small(ids), ["doc_id", "mark"], "left_semi").join(singular, ["doc_id", "mark"], "left").where(100 * u <= (100 - percent) * F.col("n_shingles"))
    nodes = materialize(nodes.select("doc_id", F.col("n_shingles").alias("n"), u.alias("u"), "bands", "odd", "whole"), "nodes")
    labels = link_classes(nodes, texts, words, percent)
    # one node for each id: different texts under one id, and texts without shingles, are one document
    if same_id is not None:
        firsts = of_ids(all_docs.select("doc_id", "class"), same_id).join(if_small(several), "class", "left").withColumn("id", F.coalesce("first", "doc_id"))
        extra = firsts.select(F.least("doc_id", "id").alias("a"), F.greatest("doc_id", "id").alias("b"))
        labels = materialize(components(labels.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(extra)), "labels")
    return labels


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of its group) and kept (it is that document) of every row.

    percent: from 80 on, as bands and samples are made for that; a lower one would lose links, so it is refused.
    """
    if not 80 <= percent <= 100 or words < 1:
        raise ValueError("links are found from 80 to 100 percent, of shingles of a word or more")
    docs = docs.select("doc_id", "text")
    all_docs = materialize(sketches(docs, words), "sketches")
    known = all_docs.where("class IS NOT NULL AND doc_id IS NOT NULL")
    # classes of several documents are few beside all; the others stand for themselves
    several = known.groupBy("class").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("class", "first")
    several = materialize(several, "classes")
    with temporary(docs.sparkSession), shuffles_go(docs.sparkSession):
        labels = materialize(_labels(docs, all_docs, several, words, percent), "labels", outer=True)
    named = several.select("class", "first")
    joined = all_docs.select("doc_id", "n_shingles", "class").join(if_small(named), "class", "left").withColumn("id", F.coalesce("first", "doc_id"))
    joined = joined.join(if_small(labels), "id", "left")
    component = F.coalesce("component", "id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
