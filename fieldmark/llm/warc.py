r"""WARC archives compressed record by record with a shared Zstandard dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself compressed; each
record follows as a frame of its own, so that any record can be read alone. The dictionary is trained on the
driver from a bounded sample of records (``SAMPLE_ROWS`` and ``SAMPLE_BYTES``); every record is archived.

Archives are binary values in rows of a table in the shared folder, which Spark's committer makes safe against
lost executors; ``export_archives`` puts them as .warc.zst files into a mounted folder.

Of records with equal payloads of ``REVISIT_BYTES`` or more, that with the largest page id is the response and the
others revisit it. Defined cases: null html is an empty payload, a null url an empty target; repeated rows with the
largest page id are all responses; a null page id never is the largest unless all are null; very large pages are archived
whole, each in one record, and give the dictionary a piece; further columns are ignored, whatever their names; an empty
table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import first_by_hash, map_rows, materialize

MAGIC = 0x184D2A5D
REVISIT_BYTES = 1000
SAMPLE_ROWS, SAMPLE_BYTES, DICT_BYTES = 2000, 8 << 20, 64 << 10
ARCHIVE_BYTES, LEVEL = 8 << 20, 3
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id) -> str:
    """The same page always has the same record id, so a task that runs again writes the same bytes."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id, url: str, payload: bytes, refers_to=None, is_revisit: bool = False) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {''.join(c for c in url if c not in chr(13) + chr(10))}", "Content-Type: application/http;msgtype=response"]
    head += [f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Length: {len(payload)}"]
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict, bytes]:
    """(headers, payload) of one record; ValueError if its lengths or its digest don't hold."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError("a record's length is wrong")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if fields["WARC-Payload-Digest"] != f"sha1:{digest}" or int(fields["WARC-Payload-Length"]) != len(payload):
            raise ValueError("a record's payload digest is wrong")
    return fields, payload


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", MAGIC, len(packed)) + packed


def read_archive(data: bytes):
    """(headers, payload) of each record of an archive."""
    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == MAGIC:
        at = 8 + struct.unpack("<I", data[4:8])[0]
        body = data[8:at]
        if body[:4] == b"\x28\xb5\x2f\xfd":
            body = zstandard.ZstdDecompressor().decompress(body)
        dictionary = zstandard.ZstdCompressionDict(body) if body else None
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(view):
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a record")
            step = view[at : at + (16 << 10)]
            parts.append(frame.decompress(step))
            at += len(step) - len(frame.unused_data)
        yield parse_record(b"".join(parts))


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary of the samples; few or uniform samples, which Zstandard can't train on, become a raw-content one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def sample_records(pages: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> list[bytes]:
    """Records of at most so many pages, the first by a hash of the page id, and of at most about so many bytes in all.

    Of a page beyond its share of the bytes a piece of that length is taken: where it begins, as all records begin without
    a history, for one page in two, and somewhere within it for the others. Nothing else of the archive is cut.
    """
    share = most_bytes // rows
    html = F.coalesce("html", F.lit(""))
    at = F.xxhash64("page_id", "url")
    inside = 1 + F.pmod(at, F.greatest(F.lit(1), F.char_length(html) - share).cast("long")).cast("int")
    # characters, of which some take several bytes: the sum below keeps to the bytes
    piece = F.when(F.octet_length(html) <= share, html).otherwise(F.substring(html, F.when(at % 2 == 0, 1).otherwise(inside), F.lit(share)))
    picked = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), piece.alias("html"))
    got, total = [], 0
    for page_id, url, body in first_by_hash(picked, rows, "page_id", "url", "html").collect():
        record = make_record(page_id, url, body.encode())
        total += len(record)
        if total > most_bytes and got:
            break
        got.append(record)
    return got


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, is_revisit and refers_to, by the payload's digest.

    The groups' largest ids come from a pre-aggregated table that holds only digests seen twice or more, so
    a payload with a third of all rows meets one row there, and the join may split it.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    long = F.octet_length("html") >= least
    digest = F.when(long, F.sha1(F.encode("html", "UTF-8"))).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "html").cast("string")))
    rows = rows.withColumn("digest", digest)
    groups = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.where("n > 1").select("digest", "largest"), "warc-groups")
    joined = rows.join(groups, "digest", "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("largest")) & F.col("largest").isNotNull(), F.lit(False))
    return joined.select("page_id", "url", "html", revisit.alias("is_revisit"), F.when(revisit, F.col("largest")).alias("refers_to"))


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives as rows (name, archive, records), written to the shared folder."""
    dictionary = train_dictionary(sample_records(pages))
    head = dictionary_frame(dictionary)
    columns = ["page_id", "url", "html", "is_revisit", "refers_to"]
    from fieldmark.llm.common import small_batches

    split = small_batches(1000, "html")

    def run(batches):
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        parts, size, first, n = [head], len(head), None, 0

        def archive():
            name = hashlib.sha1(f"{first}:{n}:{size}".encode()).hexdigest()[:20] + ".warc.zst"
            return pa.RecordBatch.from_pydict({"name": [name], "archive": pa.array([b"".join(parts)], pa.binary()), "records": pa.array([n], pa.int64())})

        for whole in batches:
            for batch in split([whole]):
                for page_id, url, html, is_revisit, refers_to in zip(*(batch.column(c).to_pylist() for c in columns)):
                    frame = press.compress(make_record(page_id, url, html.encode(), refers_to, is_revisit))
                    parts.append(frame)
                    size, n, first = size + len(frame), n + 1, page_id if first is None else first
                    if size >= archive_bytes:
                        yield archive()
                        parts, size, first, n = [head], len(head), None, 0
        if n:
            yield archive()

    return materialize(with_revisits(pages).select(*columns).mapInArrow(run, "name string, archive binary, records long"), "warc")


def export_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Put archives as files into a folder that all executors mount; a file appears whole or not at all. Lazy: (name, bytes).

    The folder must be there: one that a task made itself would be its own machine's.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            if not os.path.isdir(folder):
                raise FileNotFoundError(f"{folder} isn't there; is it mounted?")
            for name, data in zip(batch.column("name").to_pylist(), batch.column("archive")):
                draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with open(draft, "wb") as out:
                    out.write(data.as_buffer())
                os.replace(draft, f"{folder}/{name}")
            return {"name": batch.column("name"), "bytes": [len(x.as_buffer()) for x in batch.column("archive")]}

        return work

    return map_rows(archives, ["name", "archive"], "name string, bytes long", make, "archive", 8)


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per archived record, read from the archives' bytes alone."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def make():
        def work(batch: pa.RecordBatch):
            for data in batch.column("archive"):
                rows = []
                for fields, payload in read_archive(data.as_py()):
                    sha1 = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                    page, other = fields["WARC-Page-ID"], fields.get("WARC-Refers-To-Page-ID")
                    rows.append((int(page) if page else None, fields["WARC-Target-URI"], int(fields["WARC-Payload-Length"]), sha1, fields["WARC-Type"], int(other) if other else None))
                yield dict(zip((x.split()[0] for x in schema.split(", ")), zip(*rows)))

        return work

    return map_rows(archives, ["archive"], schema, make, "archive", 4)
