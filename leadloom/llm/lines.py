"""Lines that many documents share, found with two Bloom filters.

One pass over the documents fills two bit sets: hashes of lines seen at least
once, and of lines seen at least twice.  The sets of two tasks combine into
the sets of both (twice = twice | twice | once & once), bit by bit, so they
are merged by pieces on the executors.  Only lines in the twice-seen set are
suspects; their digests are shuffled, counted exactly, and the documents that
hold a line to be dropped are rewritten.  A bit set that is too small for the
corpus makes more lines suspects, never other results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from leadloom.llm.common import Batches, cut_lineage, fresh, may_hold, narrow_batches

BLANKS = b" \t\n\x0b\x0c\r"
#: Bits of each filter; the twice-seen one (BITS / 8 bytes) is what every executor gets.
BITS = 1 << 28
PIECE = 1 << 16
HASHES = 2
FLUSH = 1 << 18
#: Up to so many keys to be dropped are sent to every worker (about 150 bytes each there); more are joined by document.
SENT_KEYS = 200_000


def line_key(line: bytes) -> bytes:
    """What counts as the same line: blanks stripped at both ends, A-Z in lower case."""
    return line.strip(BLANKS).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode("utf-8", "replace")) >= least)


def keys_of(text: str | None, least: int) -> list[bytes]:
    """The key of each line, None's text counting as one empty line; keys below the least length are empty."""
    return [k if _long_enough(k := line_key(x), least) else b"" for x in (text or "").encode("utf-8", "replace").split(b"\n")]


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class TwoFilters:
    """Bits of the hashes seen, and of those seen again.

    Up to ``bits`` / 256 hashes are kept as they are, an eighth of the room at
    most that the bits would take; with more the bits are made.
    """

    def __init__(self, bits: int):
        self.bits = bits
        self.hashes, self.times = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.once = self.twice = None

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
        """Bit numbers of each hash; the second comes from the hash's upper half."""
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return [((hashes + np.uint64(i) * step) % np.uint64(bits)).astype(np.int64) for i in range(HASHES)]

    @staticmethod
    def holds(filled: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
        found = np.ones(len(places[0]), bool)
        for at in places:
            found &= (filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found

    def add(self, hashes: np.ndarray) -> None:
        """Add hashes; one that comes several times here, or came before, is seen again."""
        hashes, times = np.unique(hashes, return_counts=True)
        if self.once is None:
            self.hashes, at = np.unique(np.concatenate([self.hashes, hashes]), return_inverse=True)
            self.times = np.bincount(at, np.concatenate([self.times, times]), len(self.hashes)).astype(np.int64)
            if len(self.hashes) <= self.bits // 256:
                return
            hashes, times = self.hashes, self.times
            self.hashes = self.times = None
            self.once, self.twice = np.zeros(self.bits // 8, np.uint8), np.zeros(self.bits // 8, np.uint8)
        places = self.places(hashes, self.bits)
        again = self.holds(self.once, places) | (times > 1)
        for at in places:
            bit = np.left_shift(np.uint8(1), (at & 7).astype(np.uint8))
            np.bitwise_or.at(self.once, at >> 3, bit)
            np.bitwise_or.at(self.twice, at[again] >> 3, bit[again])

    def pieces(self):
        """(number, once, twice) of the pieces that hold a bit."""
        if self.once is None:
            once, twice = (np.unique(np.concatenate(self.places(h, self.bits))) for h in (self.hashes, self.hashes[self.times > 1]))
            for i in np.unique(once // PIECE).tolist():
                yield i, *(packed((at[slice(*np.searchsorted(at, [i * PIECE, (i + 1) * PIECE]))]) - i * PIECE) for at in (once, twice))
            return
        width = PIECE // 8
        once, twice = self.once.reshape(-1, width), self.twice.reshape(-1, width)
        for i in np.flatnonzero(once.any(axis=1)):
            yield int(i), *(packed(np.flatnonzero(np.unpackbits(x[i], bitorder="little"))) for x in (once, twice))


def packed(at: np.ndarray) -> bytes:
    """A piece of a bit set: the places of its bits if they are few, else the bits."""
    if 2 * len(at) < PIECE // 8:
        return at.astype("<u2").tobytes()
    bits = np.zeros(PIECE, np.uint8)
    bits[at] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if len(data) == PIECE // 8:
        return np.frombuffer(data, np.uint8).copy()
    bits = np.zeros(PIECE, np.uint8)
    bits[np.frombuffer(data, "<u2")] = 1
    return np.packbits(bits, bitorder="little")


def seen_twice(documents: DataFrame, least: int = 1, bits: int = BITS) -> bytes:
    """The filter of lines that are in two documents or more; ``bits`` / 8 bytes."""
    spark = documents.sparkSession
    narrow_batches(spark)
    schema = pa.schema([("piece", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    ddl = "piece int, once binary, twice binary"

    def scan(batches: Batches) -> Batches:
        filters, waiting = None, []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                waiting.extend(map(xxhash.xxh3_64_intdigest, set(keys_of(text, least)) - {b""}))
                if len(waiting) >= FLUSH:
                    filters = filters or TwoFilters(bits)
                    filters.add(np.array(waiting, np.uint64))
                    waiting.clear()
        if waiting:
            filters = filters or TwoFilters(bits)
            filters.add(np.array(waiting, np.uint64))
        rows = []
        for row in filters.pieces() if filters else ():
            rows.append(row)
            if len(rows) == 256:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def merge(batches: Batches) -> Batches:
        have: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for piece, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
                o, t = unpacked(once), unpacked(twice)
                if piece in have:
                    mine = have[piece]
                    mine[1] |= t | (mine[0] & o)
                    mine[0] |= o
                else:
                    have[piece] = [o, t]
        for piece, (_, twice) in have.items():
            if twice.any():
                yield batch_of([(piece, b"", packed(np.flatnonzero(np.unpackbits(twice, bitorder="little"))))])

    parts = documents.select("text").mapInArrow(scan, ddl)
    merged = parts.repartition("piece").mapInArrow(merge, ddl).select("piece", "twice")
    filled = np.zeros((bits // PIECE, PIECE // 8), np.uint8)
    for piece, twice in merged.toLocalIterator():
        filled[piece] = unpacked(bytes(twice))
    return filled.tobytes()


def drop_repeated_lines(documents: DataFrame, min_documents: int = 10, min_chars: int = 1, keep_first: bool = False,
                        bits: int = BITS, sent_keys: int = SENT_KEYS, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``documents`` with the lines dropped whose key is in at least ``min_documents`` documents.

    A line's key is the line without blanks at its ends and with A-Z in lower
    case; keys shorter than ``min_chars`` code points never drop.  The lines
    that stay keep their own form and order.  With ``keep_first`` the first
    line of each key stays, by smallest doc_id (a null id comes last), then
    place in the text.

    Each row counts as one document, repeated ids and equal rows included; a
    null text is one empty line and becomes the empty text.  All columns stay
    and two are added: the number of lines before, and of those dropped
    (names that clash with a column of the input get a ``_`` at the end).

    If there are at most ``sent_keys`` keys to drop, every worker gets them
    and no text is shuffled; otherwise the documents that hold one are joined
    with their keys.  The result is the same.
    """
    spark = documents.sparkSession
    names = documents.columns
    added = [fresh(n_lines, names), fresh(n_dropped, names)]
    filled = spark.sparkContext.broadcast(seen_twice(documents, min_chars, bits))

    def suspects(batches: Batches) -> Batches:
        twice = np.frombuffer(filled.value, np.uint8)
        schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("line", pa.int32())])
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first: dict[bytes, int] = {}
                for i, key in enumerate(keys_of(text, min_chars)):
                    if key:
                        first.setdefault(key, i)
                rows += [(doc_id, key, i) for key, i in first.items()]
            if rows:
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(r[1]) for r in rows), np.uint64, len(rows))
                again = np.flatnonzero(TwoFilters.holds(twice, TwoFilters.places(hashes, bits)))
                ids, keys, at = ([rows[i][c] for i in again] for c in range(3))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(map(digest, keys), pa.binary()), pa.array(at, pa.int32())], schema=schema)

    hits = cut_lineage(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(suspects, "doc_id long, digest binary, line int"))
    # the count is written out before the join, so that a digest with very many rows can be split there
    repeated = cut_lineage(
        hits.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "line")).alias("first"))
        .filter(F.col("n") >= min_documents).select("digest", "first"))
    at = names.index("text")
    schema = T.StructType([*documents.schema.fields, *(T.StructField(x, T.LongType(), False) for x in added)])

    def rewritten(batch: pa.RecordBatch, doomed) -> pa.RecordBatch:
        """The batch's rows without their doomed lines; ``doomed`` says it of (row, digest, line)."""
        texts, counts, dropped = [], [], []
        for row, text in enumerate(batch.column(at).to_pylist()):
            lines = (text or "").split("\n")
            kept = [x for i, (x, key) in enumerate(zip(lines, keys_of(text, min_chars))) if not key or not doomed(row, digest(key), i)]
            texts.append("\n".join(kept))
            counts.append(len(lines))
            dropped.append(len(lines) - len(kept))
        columns = list(batch.columns[: len(names)])
        columns[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, *added])

    if repeated.count() <= sent_keys:
        first_of = {bytes(r["digest"]): (r["first"]["doc_id"], r["first"]["line"]) if keep_first else None for r in repeated.collect()}
        sent = spark.sparkContext.broadcast(first_of)
        id_at = names.index("doc_id")

        def drop(batches: Batches) -> Batches:
            first_of = sent.value
            for batch in batches:
                ids = batch.column(id_at).to_pylist() if keep_first else None
                yield rewritten(batch, lambda row, key, i: key in first_of and not (keep_first and first_of[key] == (ids[row], i)))

        return documents.mapInArrow(drop, schema)

    found = hits.join(repeated, "digest")
    stays = F.when(F.struct(F.col("doc_id").isNull(), "doc_id", "line") == F.col("first"), F.col("line")) if keep_first \
        else F.lit(None).cast("int")
    doomed = cut_lineage(found.groupBy("doc_id").agg(F.collect_set("digest").alias("digests"), F.collect_list(stays).alias("firsts")))
    inner = [f"c{i}" for i in range(len(names))]
    flagged = may_hold(documents.toDF(*inner).withColumn("key", F.col(f"c{names.index('doc_id')}").cast("long")), "key", doomed.withColumnRenamed("doc_id", "key"))
    nothing = [F.lit(None).cast("array<binary>").alias("digests"), F.lit(None).cast("array<int>").alias("firsts")]
    clean = flagged.filter("not may_hold").select(*inner, *nothing)
    touched = flagged.filter("may_hold").alias("d").join(doomed.alias("x"), F.expr("d.key <=> x.doc_id"), "left")

    def drop_joined(batches: Batches) -> Batches:
        for batch in batches:
            bad = [set(x or ()) for x in batch.column(len(names)).to_pylist()]
            stay = [set(x or ()) for x in batch.column(len(names) + 1).to_pylist()]
            yield rewritten(batch, lambda row, key, i: key in bad[row] and i not in stay[row])

    return clean.unionByName(touched.select(*inner, "digests", "firsts")).mapInArrow(drop_joined, schema)
