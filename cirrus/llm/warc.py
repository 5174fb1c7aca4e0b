"""WARC archives in seekable Zstandard bundles (operator 10).

Each task writes bundles of records. A bundle is a run of independent Zstandard
frames, each holding whole records up to `frame_bytes`, and ends with the seek
table of the public seekable format (a skippable frame of compressed and plain
sizes). The index maps a record's id to its bundle, frame and place in the frame,
so one record is read by decompressing one frame. Bundles carry a name of their
own for each attempt of a task and count only if the index names them: a task that
is lost or run twice leaves at most a file that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 64 << 20, 3
#: Fixed values of the formats.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("bundle", T.StringType()),
    T.StructField("frame", T.IntegerType()), T.StructField("frame_at", T.LongType()), T.StructField("frame_bytes", T.LongType()),
    T.StructField("at", T.LongType()), T.StructField("bytes", T.LongType()),
])
RECORDS = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("record_type", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()),
])


def plan_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """One row per page: page_id, url, payload (null for a revisit), payload_bytes,
    payload_digest (SHA-1, hex) and refers_to. Among equal payloads (SHA-256 and length) of at
    least `min_bytes`, rows with the smallest page_id are responses, the others revisits
    of it; a null page_id counts as the largest and is never referred to."""
    payload = F.coalesce(base.quoted(html).cast("binary"), F.lit(b""))
    rows = pages.select(base.quoted(page_id).cast("long").alias("page_id"), base.quoted(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload"), "_same": F.sha2("payload", 256)})
    first = rows.groupBy("_same").agg(F.min("page_id").alias("_first"))
    again = (F.col("payload_bytes") >= min_bytes) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(first, "_same").select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(again, F.col("_first")).alias("refers_to"))


def record_bytes(row: dict, date: str) -> tuple[str, bytes]:
    """Id and bytes of the record of one planned page."""
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    page, url = row["page_id"], urllib.parse.quote(row["url"] or "", safe="".join(map(chr, range(0x21, 0x7F))).replace("%", ""))
    record_id = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url} {digest}')}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    revisit = row["refers_to"] is not None
    body = http if revisit else http + row["payload"]
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {url}"] if row["url"] is not None else []
    head += [f"X-Page-Id: {page}"] if page is not None else []
    head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {row['refers_to']}"] if revisit else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return record_id, "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def open_store(uri: str):
    """File system and path of a URI of the shared folder (file:, s3:, gs:, hdfs:)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urllib.parse.unquote("/" + uri[5:].lstrip("/"))
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_bundles(planned: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write the planned records as bundles below `folder` and return the index, held."""
    base.ready(planned.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=level, write_checksum=True)
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        state: dict = {}

        def begin() -> None:
            name = f"{uuid.uuid4().hex}.warc.zst"
            state.update(name=f"{folder}/{name}", out=store.open_output_stream(f"{root}/{name}", compression=None), at=0, sizes=[], rows=[], frame=[], plain=0)

        def frame() -> None:
            if state["frame"]:
                data = press.compress(b"".join(x for _, _, x in state["frame"]))
                at = 0
                for record_id, page, x in state["frame"]:
                    state["rows"].append((record_id, page, state["name"], len(state["sizes"]), state["at"], len(data), at, len(x)))
                    at += len(x)
                state["out"].write(data)
                state["sizes"].append((len(data), at))
                state["at"] += len(data)
                state["frame"], state["plain"] = [], 0

        def end() -> pa.RecordBatch:
            frame()
            table = b"".join(struct.pack("<II", *s) for s in state["sizes"]) + struct.pack("<IBI", len(state["sizes"]), 0, SEEKABLE_MAGIC)
            state["out"].write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
            state["out"].close()
            columns = list(zip(*state["rows"]))
            state["out"] = None
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=INDEX.names)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}
                record_id, data = record_bytes(row, date)
                if not state.get("out"):
                    begin()
                if state["plain"] and state["plain"] + len(data) > frame_bytes:
                    frame()
                state["frame"].append((record_id, row["page_id"], data))
                state["plain"] += len(data)
                if state["at"] + state["plain"] >= bundle_bytes:
                    yield end()
        if state.get("out"):
            yield end()

    return base.hold(planned.mapInArrow(run, INDEX), "warc-index")


#: Frames that a reading task has on average, and the most tasks of a read.
FRAMES, MOST_TASKS = 8, 100_000


def seek_table(file) -> list[tuple[int, int, int]]:
    """(place, compressed size, plain size) of each frame, from the footer."""
    size = file.size()
    count, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table at the end of the bundle")
    raw, at, out = file.read_at(8 * count, size - 9 - 8 * count), 0, []
    for i in range(count):
        packed, plain = struct.unpack_from("<II", raw, 8 * i)
        out.append((at, packed, plain))
        at += packed
    return out


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of a frame; a response's digest is taken from its payload and must agree."""
    at = 0
    while at < len(data):
        to = data.index(b"\r\n\r\n", at)
        lines = data[at:to].decode().split("\r\n")
        head = dict(line.split(": ", 1) for line in lines[1:])
        n = int(head["Content-Length"])
        body = data[to + 4 : to + 4 + n]
        at = to + 4 + n + 4
        http, _, payload = body.partition(b"\r\n\r\n")
        said = head["WARC-Payload-Digest"].removeprefix("sha1:")
        length = int(re.search(rb"Content-Length: (\d+)", http)[1])
        revisit = head["WARC-Type"] == "revisit"
        if not revisit and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != said or len(payload) != length):
            raise ValueError(f"{head['WARC-Record-ID']}: the payload does not match its digest")
        number = lambda k: int(head[k]) if k in head else None
        url = urllib.parse.unquote(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None
        yield {"record_id": head["WARC-Record-ID"].strip("<>"), "page_id": number("X-Page-Id"), "record_type": head["WARC-Type"], "url": url, "payload_bytes": length, "payload_digest": said, "refers_to": number("X-Refers-To-Page"), "payload": None if revisit else payload}


def read_bundles(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles that `index` names: their seek tables are read, then their
    frames, dealt to tasks one by one, so that neither a bundle nor a few of them are one
    task's work."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, path = open_store(name)
                with store.open_input_file(path) as file:
                    frames = seek_table(file)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(frames), pa.string()), *(pa.array([f[k] for f in frames], pa.int64()) for k in range(3))], names=["bundle", "_at", "_packed", "_plain"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        plain = zstandard.ZstdDecompressor()
        now, file = None, None
        for batch in batches:
            for name, at, packed, size in zip(*(c.to_pylist() for c in batch.columns)):
                if name != now:
                    if file is not None:
                        file.close()
                    store, path = open_store(name)
                    now, file = name, store.open_input_file(path)
                yield records_batch(list(parse_records(plain.decompress(file.read_at(packed, at), max_output_size=size))), payloads)
        if file is not None:
            file.close()

    count = index.agg(F.count_distinct("bundle"), F.count_distinct("bundle", "frame_at")).first()
    # a name is a few bytes here and megabytes to read, so tasks go by number; the hash keeps the
    # planner from taking the deal for one that it has made already and merging its tasks
    bundles = index.select("bundle").distinct().repartition(min(max(1, count[0]), MOST_TASKS), F.xxhash64("bundle"))
    frames = bundles.mapInArrow(tables, "bundle string, _at long, _packed long, _plain long")
    tasks = min(max(1, count[0], -(-count[1] // FRAMES)), MOST_TASKS)
    dealt = frames.repartition(tasks, F.xxhash64("bundle", "_at")).sortWithinPartitions("bundle", "_at")
    return dealt.mapInArrow(run, RECORDS if payloads else T.StructType(RECORDS.fields[:-1]))


def records_batch(rows: list[dict], payloads: bool = True) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = RECORDS.names if payloads else RECORDS.names[:-1]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)


def fetch_records(index: DataFrame) -> DataFrame:
    """The records of the given rows of an index, each by one ranged read of its frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["bundle"])
                with store.open_input_file(path) as file:
                    data = plain.decompress(file.read_at(row["frame_bytes"], row["frame_at"]))
                yield records_batch(list(parse_records(data[row["at"] : row["at"] + row["bytes"]])))

    return index.select(*INDEX.names).mapInArrow(run, RECORDS)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write `pages` and return the index; the folder is one of the shared checkpoint folder by default."""
    folder = folder or base.scratch_path(base.ready(spark), "warc")
    return write_bundles(plan_records(pages), folder)
