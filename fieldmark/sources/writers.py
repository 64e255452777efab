"""Sinks: responses and manifests as JSON with nulls kept, health rows, and no images."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators.metrics import observed
from fieldmark.settings import Settings

_stand_in: list[str] = []
KEEP_NULLS = {"ignoreNullFields": "false"}


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one stands in for it in local sessions without the setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _stand_in:
        made = tempfile.mkdtemp(prefix="fieldmark-")
        atexit.register(shutil.rmtree, made, True)
        _stand_in.append(f"file://{made}")
    return _stand_in[0]


def passing(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for what the session needs no longer than it lasts: deleted when its application ends.

    A frame may be read for as long as its session lives, so nothing shorter is safe; ``Stored`` deletes where an owner knows.
    """
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(at)  # what isn't there can't be marked
    system.deleteOnExit(at)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: computed once, also if executors are lost. It goes with the session."""
    path = passing(df.sparkSession, "stored")
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Stored:
    """stored() for a while: its tables lie in one folder, which is deleted at the end of the with block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{scratch(spark)}/stored-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Stored:
        return self

    def __exit__(self, *error) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def response_json(responses: DataFrame) -> DataFrame:
    """doc_id and json; boxes are lists of four numbers there, and nulls are kept."""
    def edge(f):
        b = f["box"]
        return F.struct(f["value"].alias("value"), f["value_ar"].alias("value_ar"), f["status"].alias("status"), f["reason"].alias("reason"), F.when(b.isNotNull(), F.array(b["x1"], b["y1"], b["x2"], b["y2"])).alias("box"))

    fields = F.transform_values("fields", lambda k, v: edge(v))
    row = F.struct(fields.alias("fields"), "raw_text", "agreement", "elapsed_ms", "model")
    return responses.select("doc_id", F.to_json(row, KEEP_NULLS).alias("json"))


def write_responses(responses: DataFrame, path: str, mode: str = "errorifexists") -> dict[str, int]:
    """Write the responses as JSON, a line each; what may be logged of them is counted by the same job and returned."""
    counted, seen = observed(responses)
    response_json(counted).select(F.col("json").alias("value")).write.mode(mode).text(path)
    return seen.get


def manifest_json(manifest: DataFrame, indent: int = 2) -> DataFrame:
    """One row, json: an object of all images in the order of their names, over several lines, in UTF-8.

    One text of all rows, as the format is one object; a manifest is a small table that people write.
    """
    pad, inner = " " * indent, {"pretty": "true"}
    # Spark's pretty JSON has two spaces a level; what lies inside an image moves by one level
    body = F.regexp_replace(F.to_json(F.struct("fields", "boxes"), inner), r"\n", "\n" + pad)
    one = F.struct("image", F.concat(F.lit(pad), F.to_json(F.array("image")).substr(F.lit(2), F.char_length(F.to_json(F.array("image"))) - 2), F.lit(": "), body).alias("text"))
    each = manifest.select(one.alias("e")).agg(F.array_sort(F.collect_list("e")).alias("e"))
    return each.select(F.concat(F.lit("{\n"), F.array_join(F.transform("e", lambda x: x["text"]), ",\n"), F.lit("\n}")).alias("json"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The manifest as one JSON object in one file of a folder."""
    manifest_json(manifest).coalesce(1).select(F.col("json").alias("value")).write.text(path)


def write_manifest_lines(manifest: DataFrame, path: str) -> None:
    """The manifest as JSON objects of one image each, a line each, written by as many tasks as it has partitions."""
    one = F.map_from_arrays(F.array("image"), F.array(F.struct("fields", "boxes")))
    manifest.select(F.to_json(one).alias("value")).write.text(path)


def write_files(files: DataFrame, path: str, tasks: int | None = None) -> None:
    """name, content: each row as a file part-* in the folder name=<name>, through Spark's committer, so that a task that
    runs again or a job that fails leaves no half of a file.

    A byte 10 stands behind each content, which readers of images pass over. Rows of one name are several files; a row
    without content is an empty file. Rows are dealt to so many tasks, as many as the session shuffles to by default,
    as a file costs more than its bytes say.
    """
    tasks = tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = files.select("name", F.coalesce("content", F.lit(b"")).cast("string").alias("value"))
    text.repartition(tasks, "name").write.partitionBy("name").text(path)


def write_debug_images(images: DataFrame, path: str, settings: Settings) -> None:
    """Images of cards are never kept by default, and there is no encoder here: this refuses, whatever the settings."""
    if not settings.debug_save_images:
        raise PermissionError("images are only written with debug_save_images")
    raise NotImplementedError("no encoder for images is installed")
