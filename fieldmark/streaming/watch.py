"""Landing folders as streams: each image or reply is independent, so the batch operators run on micro-batches as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldmark.operators.extract import extract
from fieldmark.operators.inference import Engine
from fieldmark.settings import Settings
from fieldmark.sources import writers
from fieldmark.sources.readers import IMAGE_GLOB

INTERVAL = "2.5 seconds"
FILE = "path string, modificationTime timestamp, length long, content binary"
REPLY = "doc_id long, reading string, attempt int, text string"


def image_stream(spark: SparkSession, path: str, glob: str = IMAGE_GLOB, most_files: int = 100) -> DataFrame:
    """path, content of image files as they arrive, so many at once at most."""
    return spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", most_files).load(path).select("path", "length", "content")


def reply_stream(spark: SparkSession, path: str, schema: str = REPLY) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def newest(batch: DataFrame, *source: str, by: str = "modificationTime") -> DataFrame:
    """Of each source (a camera, say) the last row of a micro-batch: what a scan would see that was busy meanwhile."""
    return batch.groupBy(*source).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in source]), F.struct(by, *[c for c in ("path",) if c in batch.columns])).alias("_last")).select(*source, "_last.*")


def extract_each(
    stream: DataFrame, engine: Engine | Callable[[DataFrame], Engine], out: str, checkpoint: str, settings: Settings = Settings(), as_of=None, interval: str | None = INTERVAL,
    docs: Callable[[DataFrame], DataFrame] = lambda batch: batch, told: Callable[[int, dict], None] = lambda number, counts: None,
) -> StreamingQuery:
    """The whole extraction of every micro-batch, the retry of what couldn't be parsed included, as JSON lines under out/batch=<number>.

    stream: rows that docs() turns into documents (doc_id, w, h, ...); engine may be made for each batch. A batch that runs
    again after a failure writes its folder anew, so out holds each document once whatever happens, and what its
    rounds stored is deleted at its end. A trigger that is due while a batch runs is skipped; the next batch then has all
    rows that came meanwhile (or, through newest() in docs, the last of each source). told gets each batch's counts.
    """
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with writers.Stored(spark) as keep:
            given = keep(docs(batch))  # read more than once, and a stream's batch would be computed each time
            asked = engine if hasattr(engine, "generate") else engine(given)
            counts = writers.write_responses(extract(given, asked, settings, as_of, keep), f"{out}/batch={number}", mode="overwrite")
        told(number, counts)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def each_batch(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, interval: str | None = INTERVAL) -> StreamingQuery:
    """Write handle(batch) of every micro-batch as Parquet, partitioned by the batch; without an interval, what is there and then stop.

    Micro-batches never overlap, so a scan that is due while one runs waits. A batch that runs again after a failure
    replaces its own output.
    """
    def run(batch: DataFrame, number: int) -> None:
        handle(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
