"""Two tokenizers over the same texts: which tokens overlap, where both end, and how common each pair of ids is.

Tokens are aligned by the bytes they stand for.  All documents of a block are
aligned in lockstep: two vectors point at the current A and B token of every
document; each step emits one link a document, notes whether both tokens end
at the same byte (a cut), moves on the pointer whose token ends first (both at
a cut), and drops the documents that are through.

How many documents hold a pair is counted over blocks: a block lists its
different pairs once with the number of its documents that hold them, so what
is shuffled are (block, pair) rows and never a row a link; documents name
their pairs by the place in the list of their block.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from leadloom.llm.common import Batches, cut_lineage, narrow_batches

#: Bytes of text that are aligned in lockstep (one longer text is a block of its own).
BLOCK_BYTES = 3 << 20
#: A tokens after which a long document goes on as a lane of its own, from the next byte at which both end.
STRETCH = 1024
#: Parts of a text kept with their ids per worker, and the longest that are kept.
CACHED = 500_000
LONGEST = 64

_SPACES = re.compile(" *[^ ]*")
#: White space other than a blank before two blanks is taken together with one of them by the byte-level rule.
_ACROSS = re.compile(r"[^\S ] {2}")
#: Fixed value: how the byte-level rule splits a text.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = dict(zip(map(chr, kept), kept))
    others = [b for b in range(256) if b not in set(kept)]
    return signs | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Ids of texts under both tokenizers, as 32-bit bytes; parts between blanks are encoded once and kept.

    Neither vocabulary joins a sign that is no blank with the blank after it
    (checked for the pieces, a rule of the byte-level splitting), so what
    stands from a blank to the next one is encoded on its own, with the same
    ids as in the whole text.  Short parts go through ``tiktoken`` where the
    order of A's merges is that of its ids (checked): the same ids, sooner.
    """

    def __init__(self, a: str, b: str):
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        sign = _byte_of_sign()
        own = {t.content for t in self.a.get_added_tokens_decoder().values()}
        vocabulary = sorted((i, t) for t, i in self.a.get_vocab(with_added_tokens=True).items())
        self.a_bytes = [t.encode() if t in own else bytes(map(sign.__getitem__, t)) for _, t in vocabulary]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int32) for x in (self.a_bytes, self.b_bytes))
        about = json.loads(self.a.to_str())
        rule = about.get("pre_tokenizer") or {}
        byte_level = rule.get("type") == "ByteLevel" and rule["use_regex"] and not rule["add_prefix_space"] and not about["normalizer"]
        self.by_part = byte_level and not any(re.search("[^▁]▁", p) for p in pieces)
        merges = [m if isinstance(m, str) else "".join(m) for m in about["model"]["merges"]]
        made = [about["model"]["vocab"][m.replace(" ", "")] for m in merges]
        self.short = None
        if self.by_part and made == sorted(made):
            ranks = {x: i for (i, t), x in zip(vocabulary, self.a_bytes) if t not in own}
            self.short = tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.kept: dict[str, tuple[bytes, bytes] | None] = {}

    def _one(self, rest: str) -> tuple[bytes, bytes] | None:
        """Ids of a blank and ``rest``; None where the tokens do not spell it."""
        a = self.a.encode(" " + rest, add_special_tokens=False).ids
        b = self.b.encode(rest) if rest else [self.b.piece_to_id("▁")]  # a blank at the end
        spelt = b" " + rest.encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == spelt == b"".join(map(self.b_bytes.__getitem__, b))
        return (array("I", a).tobytes(), array("I", b).tobytes()) if same else None

    def _encoded(self, rests: set[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """Ids of a blank and each of ``rests``; short parts are encoded in one text, and cut where their bytes begin."""
        out, short = {}, []
        for rest in rests:
            if self.short and rest and len(rest) <= LONGEST and rest[0] != " " and "▁" not in rest:
                short.append(rest)
            else:
                out[rest] = self._one(rest)
        if not short:
            return out
        whole = " " + " ".join(short)
        a, b = self.short(whole), self.b.encode(short, num_threads=1)
        b_flat = list(chain.from_iterable(b))
        spelt = whole.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != spelt or b"".join(map(self.b_bytes.__getitem__, b_flat)) != spelt:
            return out | {rest: self._one(rest) for rest in short}
        stops = np.cumsum([len(x) for x in map(str.encode, short)]) + np.arange(1, len(short) + 1)
        a = np.array(a, np.uint32)
        a_stops = np.searchsorted(np.cumsum(self.a_sizes[a]), stops) + 1
        b_stops, a, b = np.cumsum(list(map(len, b))), a.tobytes(), np.array(b_flat, np.uint32).tobytes()
        for rest, i, j, k, m in zip(short, [0, *(4 * a_stops).tolist()], (4 * a_stops).tolist(), [0, *(4 * b_stops).tolist()], (4 * b_stops).tolist()):
            out[rest] = a[i:j], b[k:m]
        return out

    def _parts(self, text: str | None) -> list[str]:
        """The parts of blank and text, each without its first blank."""
        if not text:
            return []
        if not self.by_part or _ACROSS.search(text):
            return [text]
        if "  " not in text and text[0] != " ":
            return text.split(" ")
        return [p[1:] for p in _SPACES.findall(" " + text) if p]

    def ids(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """A's ids of blank and text and B's of the text; none for an empty text or if the bytes of either differ from blank and text."""
        parts = list(map(self._parts, texts))
        kept = self.kept
        new = {p for x in parts for p in x if p not in kept}
        if len(kept) + len(new) > CACHED:
            kept.clear()
            new = set().union(*parts)
        kept.update(self._encoded(new))
        out = []
        for x in parts:
            found = [kept[p] for p in x]
            out.append((b"".join([f[0] for f in found]), b"".join([f[1] for f in found])) if None not in found else (b"", b""))
        for p in new:
            if len(p) > LONGEST:
                del kept[p]
        return out


_made: dict[tuple[str, str], Pair] = {}


def pair_of(a: str, b: str) -> Pair:
    """One pair of tokenizers per worker; its parts outlive a task."""
    if (a, b) not in _made:
        _made[a, b] = Pair(a, b)
    return _made[a, b]


# --- alignment ---------------------------------------------------------------

def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_stops: np.ndarray, b_stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, cut, first link of each lane): the links of all lanes, one lane after the other.

    A lane is a document, or a part of a long one.  Tokens of all lanes stand
    one after the other; ``ends`` are their byte ends in the joined texts,
    ``stops`` how many tokens there are up to and with each lane.  Both
    tokenizers spell the same bytes.
    """
    a_at, b_at = np.concatenate([[0], a_stops[:-1]]), np.concatenate([[0], b_stops[:-1]])
    room = (a_stops - a_at) + (b_stops - b_at)
    first = np.concatenate([[0], np.cumsum(room)])
    small = np.int32 if first[-1] < 1 << 31 else np.int64
    link_a, link_b = np.full(first[-1], -1, small), np.empty(first[-1], small)
    cut = np.zeros(first[-1], bool)
    going = a_at < a_stops
    a_at, b_at, stop, out = a_at[going].astype(small), b_at[going].astype(small), a_stops[going], first[:-1][going]
    while len(out):
        link_a[out], link_b[out] = a_at, b_at
        a_end, b_end = a_ends[a_at], b_ends[b_at]
        cut[out] = a_end == b_end
        a_at = a_at + (a_end <= b_end)
        b_at = b_at + (b_end <= a_end)
        out = out + 1
        going = a_at < stop
        if not going.all():
            a_at, b_at, stop, out = a_at[going], b_at[going], stop[going], out[going]
    used = link_a >= 0
    before = np.concatenate([[0], np.cumsum(used)])
    return link_a[used], link_b[used], cut[used], before[first]


def written_groups(a: list[str], b: list[str], link_a: np.ndarray, link_b: np.ndarray, cut: np.ndarray,
                   a_ids: np.ndarray, b_ids: np.ndarray) -> list[bytes]:
    """The pieces of text of all groups in order: each id with the sign after it; ``a`` and ``b`` are tables of such pieces."""
    last_a, last_b = link_a[cut], link_b[cut]
    first_a, first_b = np.concatenate([[0], last_a + 1]), np.concatenate([[0], last_b + 1])
    n_a, n_b = np.diff(first_a), np.diff(first_b)
    kinds = len(a) // 2
    ends = np.zeros(len(a_ids), np.int64)
    ends[last_a] = kinds
    order = np.empty(len(a_ids) + len(b_ids), np.int64)
    order[np.arange(len(a_ids)) + np.repeat(first_b[:-1], n_a)] = a_ids + ends
    kinds = len(b) // 2
    ends = np.zeros(len(b_ids), np.int64)
    ends[last_b] = kinds
    order[np.arange(len(b_ids)) + np.repeat(last_a + 1, n_b)] = len(a) + b_ids + ends
    return list(map((a + b).__getitem__, order.tolist()))


class Block:
    """Aligned documents: ids, links (token numbers within the block), cuts, and where each document starts in them."""

    def __init__(self, pair: Pair, ids: list[tuple[bytes, bytes]]):
        self.a = np.frombuffer(b"".join([x[0] for x in ids]), "u4").astype(np.int64)
        self.b = np.frombuffer(b"".join([x[1] for x in ids]), "u4").astype(np.int64)
        self.a_stops = np.cumsum([len(x[0]) // 4 for x in ids])
        self.b_stops = np.cumsum([len(x[1]) // 4 for x in ids])
        a_ends, b_ends = self._ends(pair.a_sizes[self.a]), self._ends(pair.b_sizes[self.b])
        a_stops = self._lanes(a_ends, b_ends)
        b_stops = np.searchsorted(b_ends, a_ends[a_stops - 1]) + 1
        self.link_a, self.link_b, self.cut, first = lockstep(a_ends, b_ends, a_stops, b_stops)
        self.first = np.concatenate([[0], first[np.searchsorted(a_stops, self.a_stops, side="right")]])

    def _lanes(self, a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
        """Where lanes stop, in A tokens: with each document and, within long ones, at a shared byte end after each stretch."""
        at = np.arange(STRETCH - 1, len(a_ends), STRETCH)
        while len(wrong := np.flatnonzero(b_ends[np.searchsorted(b_ends, a_ends[at])] != a_ends[at])):
            at[wrong] += 1  # a document's last token ends with one of B's
        return np.union1d(at + 1, self.a_stops[self.a_stops > 0])

    @staticmethod
    def _ends(sizes: np.ndarray) -> np.ndarray:
        ends = np.cumsum(sizes, dtype=np.int64)
        return ends.astype(np.int32) if len(ends) and ends[-1] < 1 << 31 else ends

    def sizes(self) -> dict[str, np.ndarray]:
        cuts = np.concatenate([[0], np.cumsum(self.cut)])
        return {"n_a": np.diff(self.a_stops, prepend=0), "n_b": np.diff(self.b_stops, prepend=0),
                "n_groups": np.diff(cuts[self.first]), "n_links": np.diff(self.first)}

    def groups(self, tables: tuple[list[bytes], list[bytes]]) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        if not len(self.a):
            return [b""] * len(self.a_stops)
        pieces = written_groups(*tables, self.link_a, self.link_b, self.cut, self.a, self.b)
        stops = (self.a_stops + self.b_stops).tolist()
        return [b"".join(pieces[i:j])[:-1] for i, j in zip([0, *stops], stops)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pairs of the block as a << 32 | b, documents that hold each, place in that list and times of each document's
        different pairs, first of each document)."""
        n = len(self.a_stops)
        key = self.a[self.link_a] << 32 | self.b[self.link_b]
        pairs, place = np.unique(key, return_inverse=True)
        owner = np.repeat(np.arange(n), np.diff(self.first))
        held, times = np.unique(owner * max(1, len(pairs)) + place, return_counts=True)
        owner, place = np.divmod(held, max(1, len(pairs)))
        return pairs, np.bincount(place, minlength=len(pairs)), place, times, np.searchsorted(owner, np.arange(n + 1))


def sign_tables(pair: Pair) -> tuple[list[bytes], list[bytes]]:
    """Decimal ids followed by a comma, then the same followed by what ends their side of a group."""
    def table(n: int, last: str) -> list[bytes]:
        return [f"{i}{sign}".encode() for sign in (",", last) for i in range(n)]

    return table(len(pair.a_bytes), "|"), table(len(pair.b_bytes), ";")


def blocks_of(batches: Batches, pair: Pair, block_bytes: int) -> Iterator[tuple[list, list[tuple[bytes, bytes]]]]:
    """Document ids and token ids of the rows, in blocks of about ``block_bytes`` of text."""
    doc_ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            size = len(text or "")
            if texts and held + size > block_bytes:
                yield doc_ids, pair.ids(texts)
                doc_ids, texts, held = [], [], 0
            doc_ids.append(doc_id)
            texts.append(text)
            held += size
    if texts:
        yield doc_ids, pair.ids(texts)


# --- Spark -------------------------------------------------------------------

def align_documents(documents: DataFrame, a: str | None = None, b: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The alignment itself: doc_id, a_ids, b_ids, links (array of A token number, B token number), cuts (links at which both end).

    Token numbers are places in the document's id arrays.  Odd texts as in
    ``link_statistics``: empty arrays.
    """
    narrow_batches(documents.sparkSession)
    a, b = a or byte_bpe(), b or piece_bpe()
    link = pa.struct([("a", pa.int32()), ("b", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())),
                        ("links", pa.list_(link)), ("cuts", pa.list_(pa.int32()))])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a, b)
        for doc_ids, ids in blocks_of(batches, pair, block_bytes):
            block = Block(pair, ids)
            a_first, b_first = block.a_stops - np.diff(block.a_stops, prepend=0), block.b_stops - np.diff(block.b_stops, prepend=0)
            sizes = np.diff(block.first)
            links = pa.StructArray.from_arrays([pa.array((block.link_a - np.repeat(a_first, sizes)).astype(np.int32)),
                                                pa.array((block.link_b - np.repeat(b_first, sizes)).astype(np.int32))], ["a", "b"])
            cuts = np.flatnonzero(block.cut)
            owner = np.searchsorted(block.first, cuts, side="right") - 1

            def lists(stops: np.ndarray, values) -> pa.Array:
                offsets = pa.array(np.concatenate([[0], stops]).astype(np.int32))
                return pa.ListArray.from_arrays(offsets, values)

            yield pa.RecordBatch.from_arrays([
                pa.array(doc_ids, pa.int64()), lists(block.a_stops, pa.array(block.a.astype(np.int32))),
                lists(block.b_stops, pa.array(block.b.astype(np.int32))), lists(block.first[1:], links),
                lists(np.searchsorted(cuts, block.first[1:]), pa.array((cuts - block.first[owner]).astype(np.int32)))], schema=schema)

    ddl = "doc_id long, a_ids array<int>, b_ids array<int>, links array<struct<a:int,b:int>>, cuts array<int>"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


_SIZES = ("n_a", "n_b", "n_groups", "n_links")
_PLACED = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "places binary, times binary, pairs array<long>, holders array<int>")


def placed_pairs(documents: DataFrame, a: str, b: str, block_bytes: int) -> DataFrame:
    """A row per document with its figures and pairs (places in the list of its block, as steps, and times), and one per
    block with that list (``pairs`` and ``holders``); written."""
    narrow_batches(documents.sparkSession)
    long, raw = pa.int64(), pa.binary()
    schema = pa.schema([("block", long), ("doc_id", long), *[(n, long) for n in _SIZES], ("groups_sha256", pa.string()),
                        ("places", raw), ("times", raw), ("pairs", pa.list_(long)), ("holders", pa.list_(pa.int32()))])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a, b)
        tables, part = sign_tables(pair), TaskContext.get().partitionId()
        for number, (doc_ids, ids) in enumerate(blocks_of(batches, pair, block_bytes)):
            block, n = Block(pair, ids), len(doc_ids)
            pairs, holders, places, times, first = block.pairs()
            steps = np.diff(places, prepend=0)
            starts = first[:-1][first[:-1] < len(places)]
            steps[starts] = places[starts]
            steps, times = memoryview(steps.astype("<i4").tobytes()), memoryview(times.astype("<i4").tobytes())
            cut = [(4 * i, 4 * j) for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
            sums = [hashlib.sha256(g).hexdigest() if g else "" for g in block.groups(tables)]
            columns = {
                "block": [part << 32 | number] * (n + 1), "doc_id": [*doc_ids, None],
                **{k: [*v.tolist(), None] for k, v in block.sizes().items()}, "groups_sha256": [*sums, None],
                "places": [*[steps[i:j].tobytes() for i, j in cut], None], "times": [*[times[i:j].tobytes() for i, j in cut], None],
                "pairs": [*[None] * n, pairs], "holders": [*[None] * n, holders.astype(np.int32)]}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return cut_lineage(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PLACED))


def pair_counts(placed: DataFrame) -> DataFrame:
    """pair, a, n (documents that hold the pair, over all blocks) and best (whether no pair of its A id is held by more)."""
    each = placed.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "holders")).alias("p"))
    counts = cut_lineage(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.holders").alias("n")))
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    most = cut_lineage(counts.groupBy("a").agg(F.max("n").alias("most")))
    return counts.join(most, "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best"))


def link_statistics(documents: DataFrame, a: str | None = None, b: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document.

    A encodes a blank and the text, B the text (it adds the blank); strings of
    special tokens are plain text.  A null or empty text, or one whose bytes
    under A or B differ from blank and text, has no tokens: zeros, and '' for
    the groups.  Every row is a document, whatever its id; other columns are
    ignored.  A pair's count is the number of documents of the whole table
    that hold it linked; ``n_best`` are links whose count is the highest of
    their A id, ties included; ``count_sum`` adds the counts of all links.
    """
    placed = placed_pairs(documents, a or byte_bpe(), b or piece_bpe(), block_bytes)
    listed = placed.filter("pairs is not null").select("block", F.posexplode("pairs").alias("place", "pair"))
    known = listed.join(cut_lineage(pair_counts(placed)), "pair").select(F.col("block").alias("of"), "place", "n", "best")
    plain = ["doc_id", *_SIZES, "groups_sha256"]
    rows = placed.filter("pairs is null").select("block", *plain, "places", "times")

    def looked_up(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        n, best = np.zeros(len(found), np.int64), np.zeros(len(found), bool)
        n[found["place"]], best[found["place"]] = found["n"], found["best"]
        sums = np.zeros((len(docs), 2), np.int64)
        for i, (places, times) in enumerate(zip(docs["places"], docs["times"])):
            places, times = np.cumsum(np.frombuffer(places, "<i4")), np.frombuffer(times, "<i4").astype(np.int64)
            sums[i] = times[best[places]].sum(), (times * n[places]).sum()
        return docs[plain].assign(n_best=sums[:, 0], count_sum=sums[:, 1], doc_id=docs["doc_id"].astype("Int64"))

    ddl = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("block").cogroup(known.groupBy("of")).applyInPandas(looked_up, ddl).select(
        "doc_id", *_SIZES, "n_best", "count_sum", "groups_sha256")
