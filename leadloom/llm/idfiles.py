"""Token ids in compressed files: Re-Pair grammars per shard, readable at any place.

A shard holds the ids of consecutive documents.  Frequent pairs of neighbours
are replaced by new symbols, round after round; the rules and the expansion
length of every symbol are stored, and where every thousandth symbol starts,
so that any range of ids is decoded without the rest.

File: the magic, the length of a JSON head, the head (names, types and sizes
of the arrays), then the arrays.  ``symbols`` is the shortened sequence;
symbol base + i stands for rules ``left[i] right[i]``.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from leadloom.llm.common import Batches, cut_lineage, narrow_batches
from leadloom.llm.files import file_system, new_folder
from leadloom.llm.tokens import encoder, word_tokenizer

MAGIC = b"LLIDS\x00\x01\n"
END = 1
#: Ids in a shard, about; a document is never cut.
SHARD_IDS = 2_000_000
MARK_EVERY = 1024
#: Symbols are stored in 16 bits: ids of the vocabulary and rules together.
SYMBOLS = 1 << 16


# --- grammar -----------------------------------------------------------------

def compress(ids: np.ndarray, least: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(symbols, left, right, base): the grammar of ``ids``.

    Each round takes the exact counts of all pairs of neighbours and replaces,
    from left to right, those that come at least half as often as the most
    frequent one; a rule that overlaps leave with fewer than ``least`` / 2
    places waits.  Rounds go on until no pair comes ``least`` times or all
    symbols of 16 bits are in use; ids at or above 2^16 need 32 bits, and then
    rules have no limit.

    Every place keeps the number of its pair, 0 for a pair that does not come
    ``least`` times.  A pair can only become rarer, unless it holds a symbol
    made in the last round, so after a round only the pairs beside replaced
    places are numbered anew.
    """
    symbols = ids.astype(np.uint32)
    base = int(ids.max(initial=0)) + 1
    left, right = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)]
    made, room = 0, SYMBOLS - base if base <= SYMBOLS else len(ids)
    values = np.zeros(1, np.uint64)
    code = np.zeros(len(symbols), np.intp)
    near = np.arange(max(0, len(symbols) - 1))
    while made < room:
        pairs = (symbols[near].astype(np.uint64) << np.uint64(32)) | symbols[near + 1]
        code[near], found = _numbered(pairs, least, len(values))
        values = np.concatenate([values, found])
        counts = np.bincount(code, minlength=len(values))
        counts[0] = 0
        most = int(counts.max())
        if most < least:
            break
        chosen = np.flatnonzero(counts >= max(least, most // 2))
        chosen = chosen[np.lexsort((values[chosen], -counts[chosen]))][: room - made]
        owner = chosen[np.argsort(values[chosen])]
        at, rule = _places(code, owner, len(values))
        enough = np.bincount(rule, minlength=len(owner)) >= max(1, least // 2)
        if not enough.any():  # overlaps took them all: the most frequent pair alone
            owner = chosen[:1]
            at, rule = _places(code, owner, len(values))
            enough = np.ones(1, bool)
        stay = enough[rule]
        at, rule = at[stay], (np.cumsum(enough) - 1)[rule[stay]]
        symbols[at] = (base + made + rule).astype(np.uint32)
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        symbols, code = symbols[stays], code[stays]
        at -= np.arange(len(at))  # places after those before them have closed up
        beside = np.zeros(len(symbols), bool)
        beside[at] = True
        beside[at[at > 0] - 1] = True
        beside[-1], code[-1] = False, 0
        near = np.flatnonzero(beside)
        pair = values[owner[enough]]
        left.append((pair >> np.uint64(32)).astype(np.uint32))
        right.append((pair & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        made += int(enough.sum())
    return symbols, np.concatenate(left), np.concatenate(right), base


def _numbered(pairs: np.ndarray, least: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from ``first`` on for the pairs that come ``least`` times, 0 for the others; and the pairs numbered."""
    number, found = pd.factorize(pairs)
    often = np.bincount(number, minlength=len(found)) >= least
    return np.where(often, np.cumsum(often) + (first - 1), 0)[number], found[often]


def _places(code: np.ndarray, owner: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the pairs of ``owner`` are replaced, and by which: of neighbours in a run, which overlap, every other one."""
    wanted = np.full(n_codes, -1, np.int32)
    wanted[owner] = np.arange(len(owner), dtype=np.int32)
    number = wanted.take(code)
    at = np.flatnonzero(number >= 0)
    number = number[at]
    first = np.ones(len(at), bool)
    first[1:] = np.diff(at) > 1
    run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
    free = (np.arange(len(at)) - run) % 2 == 0
    return at[free], number[free]


def sizes_of(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Expansion length of each rule; rules only use symbols made before them."""
    sizes = np.ones(len(left), np.int64)

    def size(symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols >= base, sizes[np.maximum(symbols.astype(np.int64) - base, 0)], 1)

    while True:  # once per nesting level
        now = size(left) + size(right)
        if (now == sizes).all():
            return sizes
        sizes = now


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for; each pass opens one level of rules."""
    while (open_ := symbols >= base).any():
        at = np.flatnonzero(open_)
        rule = symbols[at] - base
        out = np.repeat(symbols, 1 + open_)
        at = at + np.arange(len(at))
        out[at], out[at + 1] = left[rule], right[rule]
        symbols = out
    return symbols


# --- files -------------------------------------------------------------------

class Shard:
    """Documents of one file: their ids, lengths and the grammar."""

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @staticmethod
    def of(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> Shard:
        symbols, left, right, base = compress(ids)
        sizes = sizes_of(left, right, base)
        starts = np.cumsum(Shard._spans(symbols, sizes, base))
        marks = np.concatenate([[0], starts[MARK_EVERY - 1 :: MARK_EVERY]]).astype(np.int64)
        narrow = np.uint16 if base + len(left) <= SYMBOLS else np.uint32
        known = np.array([d is not None for d in doc_ids], np.uint8)
        return Shard(doc_ids=np.array([d or 0 for d in doc_ids], np.int64), known=known, lengths=np.array(lengths, np.int64),
                     left=left, right=right, sizes=sizes, marks=marks, base=np.array([base], np.int64), symbols=symbols.astype(narrow))

    @staticmethod
    def _spans(symbols: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        return np.concatenate([np.ones(base, np.int64), sizes])[symbols]

    def to_bytes(self) -> bytes:
        arrays = {k: np.ascontiguousarray(v) for k, v in self.__dict__.items()}
        head = json.dumps([[k, v.dtype.newbyteorder("<").str, len(v)] for k, v in arrays.items()]).encode()
        return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *(v.astype(v.dtype.newbyteorder("<")).tobytes() for v in arrays.values())])

    @staticmethod
    def from_bytes(data: bytes) -> Shard:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of token ids")
        at = len(MAGIC) + 4
        size = int.from_bytes(data[at - 4 : at], "little")
        arrays, at, head = {}, at + size, json.loads(data[at : at + size])
        for name, kind, n in head:
            arrays[name] = np.frombuffer(data, kind, n, at)
            at += arrays[name].nbytes
        return Shard(**arrays)

    def ids(self, start: int = 0, n: int | None = None) -> np.ndarray:
        """``n`` ids from ``start`` on; only the symbols around them are opened."""
        base = int(self.base[0])
        stop = int(self.lengths.sum()) if n is None else start + n
        first = int(np.searchsorted(self.marks, start, side="right")) - 1
        last = int(np.searchsorted(self.marks, stop, side="left"))
        part = self.symbols[first * MARK_EVERY : last * MARK_EVERY].astype(np.uint32)
        offset = start - int(self.marks[first])
        return expand(part, self.left, self.right, base)[offset : offset + stop - start]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.lengths[:i].sum()), int(self.lengths[i]))


# --- Spark -------------------------------------------------------------------

def write_ids(documents: DataFrame, folder: str, tokenizer: str | None = None, end: int = END, shard_ids: int = SHARD_IDS,
              partitions: int | None = None) -> DataFrame:
    """Write the ids of every text, each document closed by ``end``, in files of ``folder``; returns the list of files.

    Documents are in ascending order of doc_id (null first), then text, over
    all files: partition, then file number.  The list has partition, number,
    path, n_documents and n_ids.  A file's name and content depend on its
    rows only, so a task that runs again writes the same files again.
    """
    spark = documents.sparkSession
    narrow_batches(spark)
    tokenizer = tokenizer or word_tokenizer()
    ddl = "partition int, number int, path string, n_documents long, n_ids long"
    schema = pa.schema([("partition", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_documents", pa.int64()), ("n_ids", pa.int64())])
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Batches) -> Batches:
        made, last, part = encoder(tokenizer), end.to_bytes(4, "little"), TaskContext.get().partitionId()
        doc_ids, held, lengths, number, waiting = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            system, root = file_system(folder)
            path = f"part-{part:06d}-{number:06d}.ids"
            data = Shard.of(doc_ids, lengths, np.frombuffer(b"".join(held), "<u4")).to_bytes()
            temporary = f"{root}/_{path}-{TaskContext.get().taskAttemptId()}"
            with system.open_output_stream(temporary) as out:
                out.write(data)
            system.move(temporary, f"{root}/{path}")
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
                (part, number, path, len(lengths), waiting), schema.types)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = made.ids(text) + last
                if waiting and waiting + len(ids) // 4 > shard_ids:
                    yield flush()
                    doc_ids, held, lengths, number, waiting = [], [], [], number + 1, 0
                doc_ids.append(doc_id)
                held.append(ids)
                lengths.append(len(ids) // 4)
                waiting += len(ids) // 4
        if lengths:
            yield flush()

    return cut_lineage(ordered.mapInArrow(run, ddl))


def read_ids(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, decoded from the files in the list of ``write_ids``.

    ``start`` counts the ids of all documents before: totals of the
    partitions (as many rows as partitions) are summed, then those of the
    files of a partition, then those within a file.
    """
    totals = files.groupBy("partition").agg(F.sum("n_ids").alias("n_ids"))
    before = F.sum("n_ids").over(W.orderBy("partition").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_ids")
    totals = totals.select("partition", before.alias("before"))
    within = F.sum("n_ids").over(W.partitionBy("partition").orderBy("number").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_ids")
    placed = files.withColumn("within", within).join(F.broadcast(totals), "partition")
    placed = placed.select("path", (F.col("before") + F.col("within")).alias("before"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, root = file_system(folder)
                with system.open_input_stream(f"{root}/{path}") as source:
                    shard = Shard.from_bytes(source.read())
                data = memoryview(shard.ids().astype("<u4").tobytes())
                stops = np.cumsum(shard.lengths)
                starts = stops - shard.lengths
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
                known = shard.known.astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64(), mask=~known), pa.array(before + starts), pa.array(shard.lengths, pa.int64()),
                     pa.array(crcs, pa.int64())], schema=schema)

    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(spread).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(documents: DataFrame, tokenizer: str | None = None, end: int = END, **options) -> DataFrame:
    """Write all documents to files in a new folder under the checkpoint folder and read them back.

    A row per document: doc_id, start, n_tokens (with the end id) and
    ids_crc32.  A null or empty text is the end id alone; rows with equal ids
    all count, in the order of their texts; a null id comes first.  An empty
    table gives no files and no rows.  Other columns are ignored.
    """
    spark = documents.sparkSession
    folder = new_folder(spark, "ids")
    return read_ids(spark, folder, write_ids(documents, folder, tokenizer, end, **options))
