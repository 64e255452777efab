"""Vector code compression: product codes whose codebooks come from Lloyd's rounds, with heaps that say which parts to look at.

Components become integers (floor(256 * x)) and vectors are cut into equal parts, each with a codebook of its own. In the
first round every part is compared with all entries of its codebook. The upper bound of a part is its distance to its
entry, the lower one that to the next best; their difference, lower minus upper, is how far entries may move before the
part has to be looked at again. Each partition of the data keeps a heap for each entry with these slacks, and every
codebook the sum of how far each entry and the one that moved most beside it have moved so far. A slack goes into
the heap plus the entry's sum at that time; a round then pops exactly those parts whose key isn't above the entry's sum
now, compares them with all entries and pushes them onto the heap of the nearest. Distances are of integers and exact;
keys are rounded down, so that a tie or a rounding error leads to a comparison and never to a missed move.

Blocks of vectors with their heaps are rows of a table, rewritten in the shared folder in each round by tasks that meet
no shuffle; beside them each task leaves one row of sums by entry, which Spark adds up. Only the codebooks (entries x
dimensions numbers) and the rows they start from pass through the driver.

Defined cases: rows whose vector is null, or holds null or components that aren't finite or beyond 65536 either way
(whose squares would leave the range of exact numbers) are left out; so are empty vectors and those that can't be cut
or differ in length from the first kept row (the smallest vec_id), as codebooks have one width; repeated rows each count
and are each an entry to start from; null vec_ids come last there; fewer rows than entries give fewer entries; null
labels are one label; an empty table, or one without a kept row, gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from fieldmark.llm.common import drop_table, if_small, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components beyond this are out of range.
LARGEST = 65536.0
#: Vectors in a block; rows of a block are numbered by 16 bits.
BLOCK = 2048
#: Salts of a label where totals are too many for a broadcast.
SALTS = 32


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, entry and component."""

    entries: np.ndarray
    scale: int = SCALE

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squared_distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries; by matrix product where all terms are exact as doubles."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * top * top * x.shape[1] < 2**53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None].astype(np.int64) - entries[None, :, k]) ** 2
    return out


def compared(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (the first of several), and its slack: the next best's distance less the nearest's."""
    far = squared_distances(x, entries)
    nearest = far.argmin(1)
    at = np.arange(len(x))
    upper = np.sqrt(far[at, nearest].astype(np.float64))
    if len(entries) == 1:
        return nearest, np.full(len(x), np.inf)
    far[at, nearest] = np.iinfo(np.int64).max if far.dtype == np.int64 else np.inf
    return nearest, np.sqrt(far.min(1).astype(np.float64)) - upper


def rounded_down(keys: np.ndarray) -> np.ndarray:
    return (keys - np.abs(np.where(np.isfinite(keys), keys, 0)) * 1e-6 - 1e-3).astype(np.float32)


class Heaps:
    """The heaps of a block: for each part and entry the keys and rows in heap order, one behind the other."""

    def __init__(self, sizes: np.ndarray, keys: np.ndarray, rows: np.ndarray):
        self.sizes, self.keys, self.rows = sizes, keys, rows

    @classmethod
    def built(cls, values: np.ndarray, books: np.ndarray, moved: np.ndarray) -> Heaps:
        """Heaps of parts that are all compared; a run in order of its keys is a heap."""
        n, parts = values.shape[:2]
        sizes, keys, rows = np.zeros(books.shape[:2], np.int32), [], []
        for p in range(parts):
            nearest, slack = compared(values[:, p], books[p])
            key = rounded_down(slack + moved[p][nearest])
            order = np.lexsort((key, nearest))
            sizes[p] = np.bincount(nearest, minlength=books.shape[1])
            keys.append(key[order])
            rows.append(order.astype(np.uint16))
        return cls(sizes, np.stack(keys), np.stack(rows))

    def settled(self, values: np.ndarray, books: np.ndarray, moved: np.ndarray) -> int:
        """Pop what entries' moves may have violated, compare it with all entries and push it; how many parts that were."""
        popped_in_all = 0
        for p in range(len(books)):
            ends = np.cumsum(self.sizes[p])
            starts = ends - self.sizes[p]
            due = [e for e in np.flatnonzero(self.sizes[p]) if self.keys[p][starts[e]] <= moved[p, e]]
            if not due:
                continue
            heaps = {e: list(zip(self.keys[p][starts[e] : ends[e]].tolist(), self.rows[p][starts[e] : ends[e]].tolist())) for e in due}
            popped = []
            for e in due:
                heap, most = heaps[e], moved[p, e]
                while heap and heap[0][0] <= most:
                    popped.append(heapq.heappop(heap)[1])
            nearest, slack = compared(values[popped, p], books[p])
            for row, e, key in zip(popped, nearest.tolist(), rounded_down(slack + moved[p][nearest]).tolist()):
                if e not in heaps:
                    heaps[e] = list(zip(self.keys[p][starts[e] : ends[e]].tolist(), self.rows[p][starts[e] : ends[e]].tolist()))
                heapq.heappush(heaps[e], (key, row))
            keys, rows = [], []
            for e in range(books.shape[1]):
                keys.append(np.array([k for k, _ in heaps[e]], np.float32) if e in heaps else self.keys[p][starts[e] : ends[e]])
                rows.append(np.array([r for _, r in heaps[e]], np.uint16) if e in heaps else self.rows[p][starts[e] : ends[e]])
            self.sizes[p] = [len(k) for k in keys]
            self.keys[p], self.rows[p] = np.concatenate(keys), np.concatenate(rows)
            popped_in_all += len(popped)
        return popped_in_all

    def nearest(self) -> np.ndarray:
        """Entries by row and part."""
        out = np.zeros((self.rows.shape[1], len(self.sizes)), np.int64)
        for p, sizes in enumerate(self.sizes):
            out[self.rows[p], p] = np.repeat(np.arange(len(sizes)), sizes)
        return out


def sums_of(values: np.ndarray, nearest: np.ndarray, entries: int) -> np.ndarray:
    """Component sums and, last, counts, by part and entry."""
    n, parts, wide = values.shape
    out = np.zeros((parts, entries, wide + 1), np.int64)
    for p in range(parts):
        np.add.at(out[p, :, :wide], nearest[:, p], values[:, p])
        out[p, :, wide] = np.bincount(nearest[:, p], minlength=entries)
    return out


def moved_by(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """By part and entry: how far it has moved, and how far the one that moved most beside it."""
    far = np.sqrt(((after - before).astype(np.float64) ** 2).sum(2))
    if far.shape[1] == 1:
        return far
    order = np.argsort(far, axis=1)
    most, next_most = order[:, -1:], order[:, -2:-1]
    beside = np.where(np.arange(far.shape[1])[None] == most, np.take_along_axis(far, next_most, 1), np.take_along_axis(far, most, 1))
    return far + beside


def _schema(ids, labels) -> StructType:
    made = StructType.fromDDL("width int, data binary, sizes binary, keys binary, rows binary, sums array<long>, compared long")
    return StructType().add("ids", ArrayType(ids)).add("labels", ArrayType(labels)).add(made["width"]).add(made["data"]).add(made["sizes"]).add(made["keys"]).add(made["rows"]).add(made["sums"]).add(made["compared"])


def _blocks(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """Blocks of vectors and their heaps, and behind a task's blocks the sums by entry."""
    schema = _schema(kept.schema["id"].dataType, kept.schema["label"].dataType)
    arrow = to_arrow_schema(schema)
    parts, entries, wide = books.shape
    still = np.zeros((parts, entries))

    def run(batches):
        sums, seen = np.zeros((parts, entries, wide + 1), np.int64), 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                x = piece.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                values = np.floor(x * SCALE).astype(np.int64).reshape(piece.num_rows, parts, wide)
                heaps = Heaps.built(values, books, still)
                sums += sums_of(values, heaps.nearest(), entries)
                seen += values.shape[0] * parts
                kind = np.int16 if np.abs(values).max() < 2**15 else np.int32
                row = {"ids": piece.column("id").to_pylist(), "labels": piece.column("label").to_pylist(), "width": kind(0).itemsize, "data": values.astype(kind).tobytes()}
                yield pa.RecordBatch.from_pylist([row | _packed(heaps)], arrow)
        if seen:
            yield pa.RecordBatch.from_pylist([{"sums": sums.ravel().tolist(), "compared": seen}], arrow)

    return kept.mapInArrow(run, schema)


def _packed(heaps: Heaps) -> dict:
    return {"sizes": heaps.sizes.tobytes(), "keys": heaps.keys.tobytes(), "rows": heaps.rows.tobytes()}


def _unpacked(row: dict, books: np.ndarray) -> tuple[np.ndarray, Heaps]:
    parts, entries, wide = books.shape
    values = np.frombuffer(row["data"], {2: np.int16, 4: np.int32}[row["width"]]).reshape(-1, parts, wide).astype(np.int64)
    sizes = np.frombuffer(row["sizes"], np.int32).reshape(parts, entries).copy()
    return values, Heaps(sizes, np.frombuffer(row["keys"], np.float32).reshape(parts, -1).copy(), np.frombuffer(row["rows"], np.uint16).reshape(parts, -1).copy())


def _round(blocks: DataFrame, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    """Blocks after a round: their heaps against the codebooks that have moved, and the sums by entry."""
    arrow = to_arrow_schema(blocks.schema)
    parts, entries, wide = books.shape

    def run(batches):
        sums, seen, any_block = np.zeros((parts, entries, wide + 1), np.int64), 0, False
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                values, heaps = _unpacked(row, books)
                seen += heaps.settled(values, books, moved)
                sums += sums_of(values, heaps.nearest(), entries)
                any_block = True
                yield pa.RecordBatch.from_pylist([row | _packed(heaps)], arrow)
        if any_block:
            yield pa.RecordBatch.from_pylist([{"sums": sums.ravel().tolist(), "compared": seen}], arrow)

    return blocks.where("data IS NOT NULL").mapInArrow(run, blocks.schema)


def _coded(blocks: DataFrame, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    """id, label, code and error of every vector, after a last round."""
    schema = StructType().add("id", blocks.schema["ids"].dataType.elementType).add("label", blocks.schema["labels"].dataType.elementType).add("code", "string").add("error", "long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                values, heaps = _unpacked(row, books)
                heaps.settled(values, books, moved)
                nearest = heaps.nearest()
                off = values - books[np.arange(books.shape[0])[None], nearest]
                codes = nearest.astype(np.uint8).tobytes().hex()
                wide = 2 * nearest.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], arrow.field(0).type), pa.array(row["labels"], arrow.field(1).type), pa.array([codes[k : k + wide] for k in range(0, len(codes), wide)]), pa.array((off * off).sum((1, 2)))], schema=arrow)

    return blocks.where("data IS NOT NULL").mapInArrow(run, schema)


def _new_books(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry as the floored mean of its parts; entries without parts stay."""
    parts, entries, wide = books.shape
    each = blocks.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    sums = np.zeros(parts * entries * (wide + 1), np.int64)
    for at, x in each.collect():  # one number for each entry and component
        sums[at] = x
    sums = sums.reshape(parts, entries, wide + 1)
    counts = sums[:, :, wide:]
    return np.where(counts > 0, sums[:, :, :wide] // np.maximum(counts, 1), books)


def kept_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, label and vector (doubles) of the rows whose vector can be coded, of whatever length."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) <= LARGEST))
    return df.select(F.col(id).alias("id"), F.col(label).alias("label"), x.alias("vector")).where(fine & (F.size("vector") > 0) & (F.size("vector") % PARTS == 0))


def compress(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code, error) of every kept row as a stored table, and the codebooks; no codebooks where no row is kept."""
    if not 0 < entries <= 256:
        raise ValueError("codes have one byte a part")
    kept = kept_vectors(df, id, vector, label)
    first = lambda rows: rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    seeds = first(kept)
    if not seeds:
        spark = df.sparkSession
        return spark.createDataFrame([], StructType().add("id", kept.schema["id"].dataType).add("label", kept.schema["label"].dataType).add("code", "string").add("error", "long")), None
    size = len(seeds[0][0])
    kept = kept.where(F.size("vector") == size)
    if any(len(s[0]) != size for s in seeds):
        seeds = first(kept)
    start = np.floor(np.array([s[0] for s in seeds]) * SCALE).astype(np.int64)
    books = start.reshape(len(seeds), PARTS, -1).transpose(1, 0, 2).copy()
    moved = np.zeros(books.shape[:2])
    blocks = materialize(_blocks(kept, books), "blocks")
    for left in range(rounds, 0, -1):
        after = _new_books(blocks, books)
        moved, books = moved + moved_by(books, after), after
        if left > 1:
            old, blocks = blocks, materialize(_round(blocks, books, moved), "blocks")
            drop_table(old)
    codes = materialize(_coded(blocks, books, moved), "codes")
    drop_table(blocks)
    return codes, Codebooks(books)


def label_errors(codes: DataFrame, most_labels: int | None = None) -> DataFrame:
    """codes with label_error, the error summed over equal labels; codes is a stored table."""
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    small = if_small(totals) if most_labels is None else if_small(totals, most_labels)
    if small is not totals:
        t = small.withColumnRenamed("label", "l")
        return codes.join(t, codes.label.eqNullSafe(t.l)).drop("l")
    # a label may hold a third of all rows, so each meets its total in many tasks
    t = totals.select(F.col("label").alias("l"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salted = codes.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(t, salted.label.eqNullSafe(t.l) & (salted.salt == t.s)).drop("l", "s", "salt")


def decoded(codes: DataFrame, books: Codebooks) -> DataFrame:
    """codes with ``vector``: what each code stands for, the middle of its integers' intervals."""
    entries, scale = books.entries, books.scale

    @F.pandas_udf("array<double>")
    def restored(code):
        import pandas as pd

        at = np.arange(len(entries))
        return pd.Series([((entries[at, np.frombuffer(bytes.fromhex(c), np.uint8)].ravel() + 0.5) / scale).tolist() for c in code])

    return codes.withColumn("vector", restored("code"))


def digest(df: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and the codebooks' hash of every kept row."""
    codes, books = compress(df)
    sha = F.lit(books.sha256() if books else None).cast("string")
    return label_errors(codes).select(F.col("id").alias("vec_id"), "code", "error", "label_error", sha.alias("codebooks_sha256"))
