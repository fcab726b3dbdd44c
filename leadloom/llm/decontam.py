"""Test items in documents, up to a number of edits: pigeonhole pieces and Myers' bit-parallel distance.

An item with an error budget of k edits is cut into k + 1 pieces.  A passage
within k edits of it holds at least one piece unchanged, so one automaton over
all pieces finds every place worth looking at; there the distance is
computed, one machine step per character of the text, whole pattern at once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadloom.llm.common import Batches, narrow_batches, texts_of

#: Edits allowed per character of an item, rounded down.
ERROR_RATE = 0.06
#: Characters of items that one automaton holds; more items make more automata, one after the other.
BLOCK_CHARS = 2_000_000

_GAPS = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    """Letters and digits in lower case, everything between them one space, a space at either end."""
    return f" {_GAPS.sub(' ', text.lower()).strip()} "


def budget(item: str, rate: float = ERROR_RATE) -> int:
    return int(len(item) * rate)


def cut(item: str, parts: int) -> list[tuple[int, str]]:
    """(place, text) of ``parts`` pieces of about equal length."""
    edges = [len(item) * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


class Pattern:
    """An item for bit-parallel search."""

    def __init__(self, text: str):
        self.size = len(text)
        self.masks: dict[str, int] = defaultdict(int)
        for i, char in enumerate(text):
            self.masks[char] |= 1 << i
        self.masks = dict(self.masks)

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end) of the part of ``text`` nearest to the pattern, the first end among equals."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score = full, 0, self.size
        least, end = score, 0
        for at, char in enumerate(text, 1):
            eq = self.masks.get(char, 0)
            vertical = eq | down
            eq = (((eq & up) + up) ^ up) | eq
            plus, minus = down | (full & ~(eq | up)), up & eq
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus, minus = (plus << 1) & full, (minus << 1) & full
            up, down = minus | (full & ~(vertical | plus)), plus & vertical
            if score < least:
                least, end = score, at
        return least, end


@dataclass
class Item:
    item_id: int | None
    text: str
    edits: int
    ahead: Pattern
    back: Pattern


class Matcher:
    """Finds items in texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float = ERROR_RATE):
        self.items, self.automaton = [], ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            text = plain(text or "")
            if not text.strip():
                continue
            edits = budget(text, rate)
            for at, piece in cut(text, edits + 1):
                pieces[piece].append((len(self.items), at))
            self.items.append(Item(item_id, text, edits, Pattern(text), Pattern(text[::-1])))
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each item with a piece in ``text``, the parts of the text that a match must be in, overlaps joined."""
        found: dict[int, list[list[int]]] = defaultdict(list)
        for end, (size, places) in self.automaton.iter(text):
            for number, at in places:
                item = self.items[number]
                low = end + 1 - size - at - item.edits
                window = [max(0, low), min(len(text), low + len(item.text) + 2 * item.edits)]
                found[number].append(window)
        for number, windows in found.items():
            windows.sort()
            joined = [windows[0]]
            for low, high in windows[1:]:
                if low <= joined[-1][1]:
                    joined[-1][1] = max(high, joined[-1][1])
                else:
                    joined.append([low, high])
            found[number] = joined
        return found

    def find(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """(item_id, distance, start, end) of the nearest occurrence of each item within its budget; places in ``plain(text)``."""
        out = []
        if not self.items or not text:
            return out
        text = plain(text)
        for number, windows in sorted(self.windows(text).items()):
            item = self.items[number]
            best = None
            for low, high in windows:
                at = text.find(item.text, low, high)
                distance, end = (0, at + len(item.text) - low) if at >= 0 else item.ahead.best(text[low:high])
                if distance <= item.edits and (best is None or distance < best[0]):
                    start = at if at >= 0 else low + end - item.back.best(text[low : low + end][::-1])[1]
                    best = (distance, start, low + end)
                    if not distance:
                        break
            if best:
                out.append((item.item_id, *best))
        return out


_made: dict[tuple, Matcher] = {}


def _matcher(items: tuple, rate: float) -> Matcher:
    """One automaton per worker and block of items."""
    if (items, rate) not in _made:
        _made.clear()
        _made[items, rate] = Matcher(list(items), rate)
    return _made[items, rate]


def _blocks(benchmark: DataFrame, block_chars: int) -> list[tuple]:
    """The items in blocks of about ``block_chars`` characters, each small enough for every worker."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [tuple(sorted(((r["item_id"], r["text"]) for r in rows.filter(part == i).collect()), key=repr)) for i in range(n)]


def find_leaks(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, start and end of every test item in every document, whole texts.

    An item of n characters (letters, digits and single spaces, lower case)
    is in a document if a part of the document's text, written so, is within
    floor(n x rate) edits; its nearest occurrence is given, the first of
    equals, by places in that text.  Each row of either table counts, repeated
    and null ids included.  Null or empty texts, and items without a letter
    or digit, match nothing.  Other columns are ignored.
    """
    narrow_batches(documents.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def scan(items: tuple) -> DataFrame:
        def run(batches: Batches) -> Batches:
            matcher = _matcher(items, rate)
            for batch in batches:
                rows = [(d, *hit) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in matcher.find(text)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        return chosen.mapInArrow(run, "doc_id long, item_id long, distance int, start int, end int")

    first, *others = map(scan, _blocks(benchmark, block_chars))
    for other in others:
        first = first.unionByName(other)
    return first


def drop_leaks(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no test item, columns as they were (see ``find_leaks``)."""
    narrow_batches(documents.sparkSession)
    at = documents.columns.index("text")

    def without(docs: DataFrame, items: tuple) -> DataFrame:
        def run(batches: Batches) -> Batches:
            matcher = _matcher(items, rate)
            for batch in batches:
                clean = pa.array([not matcher.find(x) for x in texts_of(batch.column(at))], pa.bool_())
                yield batch.filter(clean)

        return docs.mapInArrow(run, docs.schema)

    for items in _blocks(benchmark, block_chars):
        documents = without(documents, items)
    return documents
