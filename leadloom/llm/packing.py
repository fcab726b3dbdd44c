"""Packing documents into sequences of a fixed length by linear grouping.

There are at most ``capacity`` different piece lengths, so the whole packing
is decided on a table of counts by length, on the driver, in time that does
not depend on the number of documents:

1. the large lengths are dealt into groups of equal cardinality and rounded up
   to the largest of their group;
2. the few sizes that remain are packed with a linear program over
   configurations (columns are generated by a knapsack), rounded down;
3. the actual lengths replace the rounded ones, longest first, which leaves
   room in the sequences;
4. what is left over and the small lengths are put by best fit, longest
   first, into the tightest room.

The result is a list of slots ("the pieces of this length numbered a to b go
to the sequences from s on, at this offset").  Spark numbers the pieces of
each length and looks their slots up.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from leadloom.llm.common import Batches, cut_lineage, narrow_batches
from leadloom.llm.tokens import encoder, word_tokenizer

CAPACITY = 4096
END = 1

#: Part of one sequence that the linear program may miss its optimum by.
GAP = 0.1

Room = tuple[int, list[tuple[int, int]]]  # so many sequences, each with (length, times) items


# --- the plan, from counts by length -------------------------------------------

def configurations(sizes: list[int], wanted: list[int], capacity: int) -> list[tuple[float, np.ndarray]]:
    """Linear program min sum x, A x = wanted, over ways to fill a sequence with sizes: (x, column) of the best solution.

    Steps go on until no way to fill a sequence has a reduced cost below
    zero, or the bound that the best one gives (the present number of
    sequences divided by its value) shows that less than ``GAP`` of one
    sequence could still be saved.  The demand is a little uneven while they
    do, so that no step stays in place; should rounding errors keep the number
    from falling for as many steps as four for each size, the search ends.
    """
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    demand = np.array(wanted, float)
    uneven = demand + 1e-4 * (1 + np.modf(np.arange(1, k + 1) * 0.6180339887498949)[0])
    room = np.arange(capacity + 1)
    least, idle = np.inf, 0
    while idle <= 4 * k:
        prices = np.linalg.solve(basis.T, np.ones(k))
        used = float(prices @ uneven)
        least, idle = (used, 0) if used < least - 1e-6 else (least, idle + 1)
        best = np.zeros(capacity + 1)
        chosen = np.full((capacity // min(sizes) + 1, capacity + 1), -1)
        for step in range(1, len(chosen)):  # best value with at most `step` items
            now, pick = best.copy(), np.full(capacity + 1, -1)
            for i, (size, price) in enumerate(zip(sizes, prices)):
                more = best[: capacity + 1 - size] + price
                better = more > now[size:] + 1e-12
                now[size:][better], pick[size:][better] = more[better], i
            chosen[step] = pick
            if (pick < 0).all():
                break
            best = now
        if best[capacity] <= 1 + 1e-7 or used - used / best[capacity] < GAP:
            break
        column, at = np.zeros(k), int(room[np.argmax(best)])
        for step in range(len(chosen) - 1, 0, -1):
            if (i := chosen[step][at]) >= 0:
                column[i] += 1
                at -= sizes[i]
        have, moved = np.linalg.solve(basis, uneven), np.linalg.solve(basis, column)
        ratio = np.where(moved > 1e-9, have / np.where(moved > 1e-9, moved, 1), np.inf)
        if not np.isfinite(ratio).any():
            break
        basis[:, int(np.argmin(ratio))] = column
    return [(x, basis[:, j]) for j, x in enumerate(np.linalg.solve(basis, demand)) if x > 0]


def _groups(large: list[tuple[int, int]], n_groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count), longest first, cut into groups of equal cardinality; few lengths are groups as they are."""
    if len(large) <= n_groups:
        return [[run] for run in large]
    total = sum(n for _, n in large)
    each, out, filled = -(-total // n_groups), [[]], 0
    for length, n in large:
        while n:
            take = min(n, each - filled)
            out[-1].append((length, take))
            n, filled = n - take, filled + take
            if filled == each:
                out.append([])
                filled = 0
    return [g for g in out if g]


#: (groups, part of the capacity above which a length is large): the scheme is run with each, the fewest sequences win.
SETTINGS = ((64, 3), (64, 2), (128, 4))


def plan(counts: dict[int, int], capacity: int = CAPACITY, settings: tuple[tuple[int, float], ...] = SETTINGS) -> list[Room]:
    """How to fill sequences with the given counts by length (1 to ``capacity``)."""
    tried = [grouped(counts, capacity, *s) for s in settings]
    return min(tried, key=lambda rooms: sum(n for n, _ in rooms))


def grouped(counts: dict[int, int], capacity: int, n_groups: int, small_part: float) -> list[Room]:
    """One run of the grouping scheme."""
    done: list[Room] = []
    if counts.get(capacity):
        done.append((counts[capacity], [(capacity, 1)]))
    runs = sorted(((s, n) for s, n in counts.items() if 0 < s < capacity and n), reverse=True)
    large, rest = [r for r in runs if r[0] * small_part > capacity], Counter(dict(r for r in runs if r[0] * small_part <= capacity))
    rooms: list[Room] = []
    if large:
        groups = _groups(large, n_groups)
        merged: dict[int, list[tuple[int, int]]] = {}
        for g in groups:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = sorted(merged, reverse=True)
        left = {s: list(merged[s]) for s in sizes}
        for times, column in configurations(sizes, [sum(n for _, n in merged[s]) for s in sizes], capacity):
            n_rooms = int(times + 1e-6)
            wanted = [sizes[i] for i, c in enumerate(column) for _ in range(round(c))]
            n_rooms = min([n_rooms, *(sum(n for _, n in left[s]) // c for s, c in Counter(wanted).items())])
            if n_rooms:
                rooms += _substitute(wanted, n_rooms, left)
        for runs_left in left.values():
            for length, n in runs_left:
                rest[length] += n
    return done + _best_fit(rooms, rest, capacity)


def _substitute(wanted: list[int], n_rooms: int, left: dict[int, list[tuple[int, int]]]) -> list[Room]:
    """Rooms with one actual length for each wanted size; takes them out of ``left``, longest first."""
    columns = []
    for size in wanted:
        need, column = n_rooms, []
        while need:
            length, n = left[size][0]
            take = min(n, need)
            column.append((length, take))
            need -= take
            if take == n:
                left[size].pop(0)
            else:
                left[size][0] = (length, n - take)
        columns.append(column)
    out = []
    while columns and columns[0]:
        n = min(c[0][1] for c in columns)
        out.append((n, sorted(Counter(c[0][0] for c in columns).items(), reverse=True)))
        for c in columns:
            length, have = c[0]
            c[0] = (length, have - n)
            if have == n:
                c.pop(0)
    return out


def _best_fit(rooms: list[Room], rest: dict[int, int], capacity: int) -> list[Room]:
    """Put the lengths of ``rest``, longest first, into the room that is left tightest; open new sequences when none fits."""
    by_room: dict[int, list[Room]] = {}
    for n, items in rooms:
        by_room.setdefault(capacity - sum(s * t for s, t in items), []).append((n, items))
    free = sorted(by_room)

    def put(n: int, items: list[tuple[int, int]], room: int) -> None:
        if n:
            if room not in by_room:
                by_room[room] = []
                bisect.insort(free, room)
            by_room[room].append((n, items))

    for length, n in sorted(rest.items(), reverse=True):
        while n:
            at = bisect.bisect_left(free, length)
            if at == len(free):
                times = capacity // length
                put(n // times, [(length, times)], capacity - times * length)
                if n % times:
                    put(1, [(length, n % times)], capacity - n % times * length)
                break
            room = free[at]
            have, items = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], free[at]
            times = room // length
            full = min(have, n // times)
            put(full, [*items, (length, times)], room - times * length)
            n, have = n - full * times, have - full
            if have and n:  # fewer than fill one sequence
                put(1, [*items, (length, n)], room - n * length)
                n, have = 0, have - 1
            put(have, items, room)
    return [r for found in by_room.values() for r in found]


def slots(rooms: list[Room]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, pieces, times, first sequence, offset): piece ``first + i`` goes to sequence
    ``first sequence + i // times`` at ``offset + i % times * length``."""
    numbered: Counter = Counter()
    out, sequence = [], 0
    for n, items in rooms:
        offset = 0
        for length, times in items:
            out.append((length, numbered[length], n * times, times, sequence, offset))
            numbered[length] += n * times
            offset += length * times
        sequence += n
    return out


# --- Spark -------------------------------------------------------------------

def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of each document: its ids and the end id, cut at the capacity."""
    narrow_batches(documents.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Batches) -> Batches:
        made, last = encoder(tokenizer), end.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(made.ids(text) + last)
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        made.forget()  # the worker goes on with other steps, which need the memory

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _slot_table(spark: SparkSession, rooms: list[Room]) -> DataFrame:
    ddl = "length long, first long, pieces long, times long, sequence long, at long"
    return spark.createDataFrame(slots(rooms), ddl)


def pack(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END,
         settings: tuple[tuple[int, float], ...] = SETTINGS, salt_rows: int = 200_000) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece (from 0), start (ids of its
    document before it), length, ids_crc32, sequence_id (from 0) and offset.
    Only documents longer than the capacity are cut.  A null or empty text is
    a document of the end id alone; each row is a document, repeated and null
    ids included; other columns are ignored.  Pieces of one length are
    numbered in buckets of about ``salt_rows``, so that a length that very
    many documents have is spread over tasks.
    """
    found = cut_lineage(pieces(documents, tokenizer or word_tokenizer(), capacity, end))
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slot_table = F.broadcast(_slot_table(found.sparkSession, plan(counts, capacity, settings)))
    salts = max(1, -(-max(counts.values(), default=1) // salt_rows) * 4)
    order = ["doc_id", "piece", "start", "ids_crc32"]
    salted = found.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    by_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    by_salt = by_salt.select("length", "salt", before.alias("before"))
    number = F.row_number().over(W.partitionBy("length", "salt").orderBy(*order)) - 1
    numbered = salted.withColumn("number", number).join(by_salt, ["length", "salt"]).withColumn("number", F.col("number") + F.col("before"))
    i = F.col("number") - F.col("first")
    return numbered.join(slot_table, "length").filter((i >= 0) & (i < F.col("pieces"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(i / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("at") + i % F.col("times") * F.col("length")).cast("long").alias("offset"))
