"""WARC archives: write pages, and turn archives that are one gzip stream into archives with a member per record.

An archive compressed as a whole can only be read from its start.  The
normaliser inflates such a stream once, writes every record again as a gzip
member of its own, and writes a sidecar index (one JSON line per record: where
the member starts and how long it is), so that readers open single records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom.llm.common import Batches, cut_lineage, narrow_batches
from leadloom.llm.files import file_system, new_folder

#: Bytes of payload after which a new archive is begun.
ARCHIVE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31
LEVEL = 5
INDEX = "archive string, offset long, length long, page_id long, record_type string"
Fields = dict[str, str]


# --- records -----------------------------------------------------------------

def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _line(value: str) -> str:
    """A value that fits a header line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(fields: Fields, block: bytes) -> bytes:
    head = "".join(f"{k}: {_line(v)}\r\n" for k, v in {**fields, "Content-Length": str(len(block))}.items())
    return b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def response_record(page_id: int | None, url: str | None, payload: bytes) -> tuple[Fields, bytes]:
    fields = {"WARC-Type": "response", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE,
              "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}"}
    if url:
        fields["WARC-Target-URI"] = url
    if page_id is not None:
        fields["Page-ID"] = str(page_id)
    return fields, _http(len(payload)) + payload


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def revisit_of(fields: Fields, block: bytes, page_id: int) -> tuple[Fields, bytes]:
    """The record as a revisit of an equal payload: its HTTP head stays, the payload goes."""
    head, _, _ = block.partition(b"\r\n\r\n")
    changed = {**fields, "WARC-Type": "revisit", "WARC-Profile": REVISIT, "WARC-Refers-To": record_id(page_id), "Refers-To-Page-ID": str(page_id)}
    return changed, head + b"\r\n\r\n"


def inflated(source: BinaryIO, size: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file in pieces, whether it is one member or many; plain files as they are."""
    data = source.read(size)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = source.read(size)
        return
    engine = zlib.decompressobj(GZIP)
    while data:
        out = engine.decompress(data, size)
        if out:
            yield out
        data = engine.unconsumed_tail
        if engine.eof:
            data, engine = engine.unused_data.lstrip(b"\0"), zlib.decompressobj(GZIP)
        data = data or source.read(size)


def records(pieces: Iterable[bytes]) -> Iterator[tuple[Fields, bytes]]:
    """(fields, block) of the records of an inflated archive, one at a time."""
    pieces, held = iter(pieces), bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        searched = 0
        while (end := held.find(b"\r\n\r\n", max(0, searched - 3))) < 0 or not held[:end].strip():
            if end >= 0:  # empty lines before a record
                del held[: end + 4]
                searched = 0
                continue
            searched = len(held)
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a record's head")
                return
        lines = held[:end].decode("utf-8", "replace").strip().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(fields.pop("Content-Length"))
        while len(held) < end + 4 + size and more():
            pass
        if len(held) < end + 4 + size:
            raise ValueError("the archive ends within a record's block")
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]
        yield fields, block


def member(data: bytes) -> bytes:
    engine = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    return engine.compress(data) + engine.flush()


def normalise(source: BinaryIO, archive: BinaryIO, revisits: dict[int, int] | None = None) -> Iterator[dict]:
    """Write the records of ``source`` to ``archive``, a member each; yields their index entries.

    The stream is inflated once, a piece at a time.  ``revisits`` gives for
    records (by their number) the page that they repeat.
    """
    offset = 0
    for number, (fields, block) in enumerate(records(inflated(source))):
        if revisits and number in revisits:
            fields, block = revisit_of(fields, block, revisits[number])
        data = member(record_bytes(fields, block))
        archive.write(data)
        page = fields.get("Page-ID")
        yield {"offset": offset, "length": len(data), "page_id": int(page) if page else None, "record_type": fields["WARC-Type"]}
        offset += len(data)


# --- Spark -------------------------------------------------------------------

def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def write_streams(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write each page as a response record, archives compressed as a whole; returns a row per record.

    The rows have archive, number (place in the archive), page_id,
    payload_bytes and payload_digest.  Pages are not shuffled: every task
    writes archives of its own, named by task and number.
    """
    narrow_batches(pages.sparkSession)
    schema = pa.schema([("archive", pa.string()), ("number", pa.int32()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def run(batches: Batches) -> Batches:
        system, root = file_system(folder)
        context = TaskContext.get()
        part, number, rows, filled, out = context.partitionId(), 0, [], 0, None

        def close() -> None:
            out.write(engine.flush())
            out.close()
            system.move(temporary, f"{root}/{name}")

        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"part-{part:06d}-{number:06d}.warc.gz"
                    temporary = f"{root}/_{name}-{context.taskAttemptId()}"
                    out, engine = system.open_output_stream(temporary, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                payload = (html or "").encode("utf-8", "replace")
                fields, block = response_record(page_id, url, payload)
                out.write(engine.compress(record_bytes(fields, block)))
                rows.append((name, len(rows), page_id, len(payload), fields["WARC-Payload-Digest"].removeprefix("sha1:")))
                filled += len(payload)
                if filled >= archive_bytes or len(rows) >= 50_000:
                    close()
                    yield _batch(rows, schema)
                    number, rows, filled, out = number + 1, [], 0, None
        if out is not None:
            close()
            yield _batch(rows, schema)

    chosen = pages.select(F.col("page_id").cast("long"), "url", "html")
    return cut_lineage(chosen.mapInArrow(run, "archive string, number int, page_id long, payload_bytes long, payload_digest string"))


def mark_revisits(written: DataFrame, min_bytes: int = 0) -> DataFrame:
    """archive and its revisits (number, page_id they refer to) of the records of ``write_streams``.

    Of records with equal payloads of at least ``min_bytes`` bytes, those with
    the smallest page_id stay responses (all of them, if its row is
    repeated; null ids only if all are null).
    """
    keys = ["payload_digest", "payload_bytes"]
    # written out before the join, so that a payload with very many pages can be split there
    first = cut_lineage(
        written.filter(F.col("payload_bytes") >= min_bytes).groupBy(*keys)
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n"))
    joined = written.join(first, keys, "left")
    repeats = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.groupBy("archive").agg(
        F.collect_list(F.when(repeats, F.struct("number", F.col("first").alias("page_id")))).alias("revisits"))


def normalise_archives(archives: DataFrame, source: str, folder: str) -> DataFrame:
    """Rewrite archives of the folder ``source`` into ``folder``; returns archive and records of each.

    ``archives`` has archive (a file name) and revisits (an array of number
    and page_id, may be empty).  Next to each archive goes
    ``index/<name>.json``.
    """
    spark = archives.sparkSession
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64())])

    def run(batches: Batches) -> Batches:
        (old, old_root), (new, new_root) = file_system(source), file_system(folder)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for name, revisits in zip(*(c.to_pylist() for c in batch.columns)):
                first, side = f"{new_root}/_{name}-{attempt}", f"{new_root}/index/_{name}-{attempt}"
                n = 0
                with old.open_input_stream(f"{old_root}/{name}", compression=None) as stream, \
                        new.open_output_stream(first, compression=None) as out, new.open_output_stream(side) as index:
                    for entry in normalise(stream, out, {r["number"]: r["page_id"] for r in revisits}):
                        index.write(json.dumps({"archive": name, **entry}).encode() + b"\n")
                        n += 1
                new.move(first, f"{new_root}/{name}")
                new.move(side, f"{new_root}/index/{name}.json")
                yield _batch([(name, n)], schema)

    system, root = file_system(folder)
    system.create_dir(f"{root}/index", recursive=True)
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cut_lineage(archives.repartition(spread).mapInArrow(run, "archive string, records long"))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar indexes of the archives of a folder."""
    return spark.read.schema(INDEX).json(f"{folder}/index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload (null for a revisit), payload_bytes and payload_digest of indexed records.

    Each record is read by its offset and length and inflated on its own.
    """
    spark = index.sparkSession
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def one(fields: Fields, block: bytes) -> tuple:
        head, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        page, other, digest = fields.get("Page-ID"), fields.get("Refers-To-Page-ID"), fields["WARC-Payload-Digest"].removeprefix("sha1:")
        whole = fields["WARC-Type"] == "response"
        if whole and (len(payload), payload_digest(payload)) != (size, digest):
            raise ValueError(f"damaged record of page {page}")
        return (int(page) if page else None, fields.get("WARC-Target-URI"), fields["WARC-Type"], int(other) if other else None,
                payload if whole else None, size, digest)

    def run(batches: Batches) -> Batches:
        system, root = file_system(folder)
        open_name, source = None, None
        for batch in batches:
            rows, held = [], 0
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if name != open_name:
                    if source:
                        source.close()
                    open_name, source = name, system.open_input_file(f"{root}/{name}")
                source.seek(offset)
                rows.append(one(*next(records([zlib.decompress(source.read(length), GZIP)]))))
                held += rows[-1][5]
                if held > 16 << 20:
                    yield _batch(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, schema)
        if source:
            source.close()

    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = index.select("archive", "offset", "length").repartition(spread, "archive").sortWithinPartitions("archive", "offset")
    return found.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def archive_pages(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per page, normalise the archives, and read every record back by the index.

    Columns as in ``read_records``.  A null html is an empty payload, a null
    url is left out; a null page_id stays null; repeated rows get a record
    each; other columns are ignored.  An empty table gives no archives and no
    rows.  Files go to new folders under the checkpoint folder.
    """
    spark = pages.sparkSession
    streams, folder = new_folder(spark, "warc-streams"), new_folder(spark, "warc")
    written = write_streams(pages, streams, archive_bytes)
    normalise_archives(mark_revisits(written, min_bytes), streams, folder)
    return read_records(read_index(spark, folder), folder)
