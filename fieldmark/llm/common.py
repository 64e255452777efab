"""Helpers shared by the corpus operators: table access, shared scratch tables, Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Characters that separate words: space and the ASCII controls tab to carriage return.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Tables of up to this many rows of a few numbers (some 20 MB) are broadcast; larger ones are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Tables whose rows hold arrays are broadcast up to so many bytes.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, as a lambda's variable."""
    return F.transform(F.array(value), use)[0]


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's lower-cased words, in order; null text has none."""
    parts = F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), WORD_SPLIT), lambda w: w != "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def runs_of(hashes: Column, words: int) -> Column:
    """Hashes of all runs of so many words, given at least that many word hashes."""
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - words), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(words)]))


#: The temporary folder of a local session without a shared one.
_stand_in: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    A temporary folder stands in only where the setting is absent, as in tests in local mode.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or _stand_in.get("dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="fieldmark-")
    atexit.register(shutil.rmtree, made, True)
    _stand_in["dir"] = f"file://{made}"
    return _stand_in["dir"]


#: Folders of the runs that are under way, the innermost last.
_runs: ContextVar[tuple[str, ...]] = ContextVar("runs", default=())


@contextmanager
def temporary(spark: SparkSession):
    """Tables that materialize() writes meanwhile are deleted at the end, but for those made with outer=True."""
    run = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    mark = _runs.set((*_runs.get(), run))
    try:
        yield
    finally:
        _runs.reset(mark)
        _delete(spark, run)


def materialize(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage: what was computed survives the loss of executors, and the reader knows its size.
    """
    spark = df.sparkSession
    runs = _runs.get()[: -1 if outer else None]
    path = f"{runs[-1] if runs else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Has Spark delete an execution's shuffle files at its end; else they stay until the driver's garbage collection.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession):
    """Meanwhile the shuffle files of each write or action go once it has ended, as tables keep what it made.

    A lost executor's part is made again as ever: files go only after the last task. An action on the same frame twice
    makes its shuffles twice.
    """
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SHUFFLES_GO) if before is None else spark.conf.set(_SHUFFLES_GO, before)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote and nobody reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def if_small(few: DataFrame, most_rows: int = BROADCAST_IDS) -> DataFrame:
    """few, marked for broadcast if it has at most so many rows; it should be a stored table of narrow rows."""
    return F.broadcast(few) if few.count() <= most_rows else few


def if_few_bytes(few: DataFrame, array: str, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """few, marked for broadcast if its rows, each with an array of 8-byte numbers, take at most so many bytes."""
    size = few.agg(F.coalesce(F.sum(F.size(array) * 8 + 64), F.lit(0))).first()[0]
    return F.broadcast(few) if size <= most_bytes else few


def of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in ids: by broadcast where ids are few, by a shuffle otherwise."""
    return docs.join(if_small(ids), "doc_id", "left_semi")


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id isn't in ids, as of_ids; a null doc_id stays."""
    return docs.join(if_small(ids), "doc_id", "left_anti")


def first_by_hash(df: DataFrame, rows: int, *keys: str, of: int | None = None) -> DataFrame:
    """So many rows, the first by a hash of the keys, which should tell most rows apart.

    A plain sort with a limit has every task hand over so many rows; here a count finds the part of the hashes' range
    that holds about twice as many in all, and only rows in it are sorted. of: how many rows df has, if that is known.
    """
    n = df.count() if of is None else of
    order = [F.xxhash64(*keys), *keys]
    if n > 2 * rows:
        least = -(2**63)
        df = df.where(F.xxhash64(*keys) < least + int(2**64 * (2 * rows / n)))
    return df.orderBy(*order).limit(rows)


def small_batches(rows: int, column: str, most_bytes: int = 16 << 20):
    """A splitter of Arrow batches: pieces of at most so many rows, and of about so many bytes in one column."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, n = 0, batch.num_rows
            step = max(1, min(rows, int(n * most_bytes / max(1, batch.column(column).nbytes)))) if n else 1
            while start < n:
                yield batch.slice(start, step)
                start += step

    return split


def map_rows(df: DataFrame, columns: list[str], schema: str | StructType, make: Callable[[], Callable], text: str | None = None, rows: int = 2000, most_bytes: int = 16 << 20) -> DataFrame:
    """mapInArrow over the given columns. make() runs once a task and returns batch -> dict of lists, or an iterator of them."""
    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)
    split = small_batches(rows, text or columns[0], most_bytes)

    def run(batches):
        work = make()
        for batch in split(batches):
            made = work(batch)
            for part in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays([pa.array(part[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, out)
