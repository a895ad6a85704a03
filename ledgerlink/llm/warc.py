"""Operator 5: WARC archives, index first.

Writing: each task appends compressed records to an archive of its own in the
shared folder and notes archive, offset, length, URL and digest of each; these
notes are the index, a table.  Reading: records are selected in the index; each
archive's byte ranges are sorted, neighbouring ones are joined into one read,
and the records are parsed from it.

Of records with equal payloads the one with the least id is a response, the
others are revisits that name it.  Payloads shorter than ``min_bytes`` are
always responses.  Null payloads count as empty.  Null ids come after all
others; if all of a payload's ids are null, all its records are responses, as
are rows that repeat the least id.  Line ends in a URL are percent-encoded; a
null URL is written as an empty one.

Every archive begins with a warcinfo record, which the index does not list.
Record ids are made of page ids, so they are unique where these are.  Reading
compares each record with the index, the record that a revisit names included.
How many tasks read follows from the bytes that the index selects.

An empty table gives an empty index and no archive; a payload of any length is
one record, held by one task while it is written or read; other columns, whatever
their names, are not looked at.

Archives are reached through ``pyarrow.fs`` by URI, so the shared folder may be
in any store that it knows.  A failed attempt leaves a file that no index names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlink.llm.batches import slices
from ledgerlink.staging import new_path, stage

ARCHIVE_BYTES = 256_000_000
READ_BYTES = 8_000_000
GAP_BYTES = 64_000
#: Compressed bytes for one reading task; where all cores are not yet busy, as little as LEAST_BYTES.
TASK_BYTES, LEAST_BYTES = 64_000_000, 2_000_000
LEVEL = 1


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(uri: str):
    """The file system of a URI, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record, compressed by itself."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url.replace('\r', '%0D').replace('\n', '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return zlib.compress(data, LEVEL, 31)


def opening(name: str) -> bytes:
    """The warcinfo record of an archive."""
    block = b"software: ledgerlink\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return zlib.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, 31)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one compressed record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def first_copies(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Payloads that stand in several rows: their key and least id, staged."""
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    keys = pages.select(F.col(id_col).alias("__first"), F.sha2(text, 256).alias("__key")).filter(F.octet_length(text) >= min_bytes)
    return stage(keys.groupBy("__key").agg(F.min("__first").alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n"), "copies")


def index_schema(id_type: T.DataType, id_col: str = "page_id") -> T.StructType:
    s, n = T.StringType(), T.LongType()
    return T.StructType([T.StructField(c, t) for c, t in (("archive", s), ("offset", n), ("length", n), ("url", s), ("payload_digest", s), (id_col, id_type), ("record_type", s), ("refers_to", id_type))])


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the archives; return the index, staged."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    plain = pages.select(F.col(id_col).alias("__id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("__url"), text.alias("__text"))
    copies = first_copies(pages, id_col, payload_col, min_bytes)
    # a table, not an aggregate, so that a payload held by a third of the rows can be split when joined
    found = plain.withColumn("__key", F.when(F.octet_length("__text") >= min_bytes, F.sha2("__text", 256))).join(copies, "__key", "left")
    refers = F.when(F.col("__first").isNotNull() & ~F.col("__first").eqNullSafe(F.col("__id")), F.col("__first"))
    rows = found.select("__id", "__url", "__text", refers.alias("__refers"))
    schema = index_schema(plain.schema["__id"].dataType, id_col)
    arrow = to_arrow_schema(schema)

    def run(batches):
        where, base = _open(folder)
        where.create_dir(base, recursive=True)
        sink, name, at = None, "", 0
        for batch in slices(batches):
            notes = []
            for i, url, text, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None or at >= ARCHIVE_BYTES:
                    if sink is not None:
                        sink.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    sink = where.open_output_stream(f"{base}/{name}", compression=None)
                    info = opening(name)
                    sink.write(info)
                    at = len(info)
                payload = text.encode("utf-8", "replace")
                digest = digest32(payload)
                data = record(i, url, payload, digest, refers_to)
                sink.write(data)
                notes.append((f"{folder}/{name}", at, len(data), url, digest, i, "response" if refers_to is None else "revisit", refers_to))
                at += len(data)
            if notes:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*notes, strict=True), arrow, strict=True)], schema=arrow)
        if sink is not None:
            sink.close()

    return stage(rows.mapInArrow(run, schema), "warc-index")


def _ranges(rows: list[dict]):
    """Runs of sorted records of one archive that one read fetches."""
    run: list[dict] = []
    for row in rows:
        if run and (row["archive"] != run[0]["archive"] or row["offset"] > run[-1]["offset"] + run[-1]["length"] + GAP_BYTES or row["offset"] + row["length"] - run[0]["offset"] > READ_BYTES):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def read(index: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The index's rows with payload_bytes, the record's own digest and type, and the payload (null for revisits)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    n = T.LongType()
    schema = T.StructType([index.schema[id_col], T.StructField("payload_bytes", n), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", index.schema["refers_to"].dataType), T.StructField("payload", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        name, source = None, None
        for batch in batches:
            for span in _ranges(batch.to_pylist()):
                if span[0]["archive"] != name:
                    if source is not None:
                        source.close()
                    name = span[0]["archive"]
                    where, path = _open(name)
                    source = where.open_input_file(path)
                begin = span[0]["offset"]
                data = source.read_at(span[-1]["offset"] + span[-1]["length"] - begin, begin)
                done = []
                for row in span:
                    headers, payload = parse(data[row["offset"] - begin : row["offset"] - begin + row["length"]])
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(headers["WARC-Payload-Length"])
                    refers = None if row["refers_to"] is None else f"<urn:page:{row['refers_to']}>"
                    sound = headers["WARC-Record-ID"] == f"<urn:page:{row[id_col]}>" and kind == row["record_type"] and headers.get("WARC-Refers-To") == refers
                    if not sound or kind == "response" and (digest32(payload) != digest or len(payload) != size):
                        raise ValueError(f"{name} at {row['offset']}: the record is not what the index says")
                    done.append((row[id_col], size, digest, kind, row["refers_to"], payload if kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
        if source is not None:
            source.close()

    need = index.select("archive", "offset", "length", id_col, "record_type", "refers_to")
    total = need.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    cores = index.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-total // TASK_BYTES), min(cores, -(-total // LEAST_BYTES)))
    # ranges of one archive's records lie side by side, and an archive may be read by several tasks
    return need.repartitionByRange(int(tasks), "archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(run, schema)
