"""Periodic runs of words: suffix classes united by falling common prefix, neighbours in a class seed the runs.

A run is a longest stretch of words with period q (words q apart are equal),
of at least ``least_words`` words and ``least_times`` periods.  Within a text:

1. Two places q apart in such a run share at least ``shortest_prefix`` words
   from there on, so only places whose words to that length come again in
   the text can take part (found by a sort of hashes, then exactly).
2. These places are sorted by what follows them, by doubling; neighbours in
   that order are edges, weighted by their common prefix.
3. Kruskal: edges are taken by falling weight and unite the sets of places
   they join; a set is kept in order of place.  Places i < j that become
   neighbours in a set at weight t share exactly t words, so i to j + t has
   period j - i; no place between them shares as much, so no smaller period
   does.  If the words before i and j differ, the run starts at i.  Each run
   is found once, as each pair becomes neighbours at most once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from leadloom.llm.common import Batches, narrow_batches

LEAST_WORDS = 6
LEAST_TIMES = 4
#: Words whose runs are searched at once; a longer text is searched alone.
GROUP_WORDS = 400_000

Runs = list[tuple[int, int, int]]  # start, length, period


def shortest_prefix(least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> int:
    """Words that two places a period apart share at least, at the start of any run."""
    return min(max(least_words, least_times * q) - q for q in range(1, least_words + 1))


def word_numbers(texts: list[list[bytes]]) -> np.ndarray:
    """Numbers for the words of all texts, one after the other; a text has numbers of its own and one more at its end."""
    out, used = [], 0
    for words in texts:
        numbers = defaultdict(count(used).__next__)
        out.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        used += len(numbers)
        out.append(np.array([used], np.int64))
        used += 1
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _suspects(ids: np.ndarray, k: int) -> np.ndarray:
    """Places, ascending, whose hash of k words comes more than once."""
    n = len(ids) - k + 1
    if n < 2:
        return np.empty(0, np.int64)
    words = ids.astype(np.uint64)
    mixed, factor = np.zeros(n, np.uint64), 0x9E3779B97F4A7C15
    for j in range(k):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(factor) + words[j : j + n]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(factor)
    place = np.uint64((1 << int(n - 1).bit_length()) - 1)
    ordered = np.sort((mixed & ~place) | np.arange(n, dtype=np.uint64))  # the place is kept in the low bits
    same = (ordered[1:] | place) == (ordered[:-1] | place)
    again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return np.sort((ordered[again] & place).astype(np.int64))


def _starts(classes: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], classes[1:] != classes[:-1]])


def _edges(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in suffix order, words shared with the next one, class start): classes share at least k words, singles are left out."""
    at = _suspects(ids, k)
    if not len(at):
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, bool),)
    # what follows a suspect's k words decides its order too, so those places are ranked along with them, in true order
    at = np.union1d(at, at[at + k < len(ids)] + k)
    padded = np.concatenate([ids, np.full(k, -1)]) + 1
    classes = padded[at]
    for j in range(1, k):
        classes = np.unique(classes << 32 | padded[at + j], return_inverse=True)[1]
    # rank: first place of the class in suffix order; places outside have ranks of their own
    n, m = len(ids), len(at)
    rank = np.arange(m, m + n + 1, dtype=np.int64)
    order = np.argsort(classes, kind="stable")
    in_order, class_start = at[order], _starts(classes[order])
    rank[in_order] = np.maximum.accumulate(np.where(class_start, np.arange(m), 0))
    sizes = np.diff(np.concatenate([np.flatnonzero(class_start), [m]]))
    levels, width, active = [], k, in_order[np.repeat(sizes > 1, sizes)]
    while len(active):
        levels.append(rank.astype(np.int32 if n + m < 1 << 31 else np.int64))
        key = rank[active] << 32 | rank[np.minimum(active + width, n)]
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        new, old = _starts(key), _starts(key >> 32)
        index = np.arange(len(active))
        inside = np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(old, index, 0))
        rank[active] = (key >> 32) + inside
        sizes = np.diff(np.concatenate([np.flatnonzero(new), [len(active)]]))
        active = active[np.repeat(sizes > 1, sizes)]
        width *= 2
    in_order[rank[at]] = at
    a, b = in_order[:-1], in_order[1:]
    shared = np.zeros(m - 1, np.int64)
    for ranks in reversed(levels):  # each width fits once more at most
        width //= 2
        shared += np.where(ranks[np.minimum(a + shared, n)] == ranks[np.minimum(b + shared, n)], width, 0)
    ended = np.concatenate([ids, [-1]])
    for _ in range(k - 1):
        more = ended[np.minimum(a + shared, n)] == ended[np.minimum(b + shared, n)]
        shared += more & (shared >= k)
    return in_order, shared, class_start


def periodic_runs(ids: np.ndarray, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> Runs:
    """All runs (start, length, smallest period), in no order; ``ids`` as from ``word_numbers``."""
    in_order, shared, class_start = _edges(ids, shortest_prefix(least_words, least_times))
    if not len(in_order):
        return []
    # a class whose places are all too far apart for what they share has no run
    starts = np.flatnonzero(class_start)
    sizes = np.diff(np.concatenate([starts, [len(in_order)]]))
    number = np.repeat(np.arange(len(starts)), sizes)
    by_place = np.lexsort((in_order, number))
    gaps = np.concatenate([np.diff(in_order[by_place]), [len(ids)]])
    gaps[np.concatenate([starts[1:] - 1, [len(in_order) - 1]])] = len(ids)
    inner = np.concatenate([~class_start[1:], [False]])  # an edge to the next place of the same class
    weights = np.where(inner, np.concatenate([shared, [0]]), 0)
    hopeful = np.minimum.reduceat(gaps, starts) * (least_times - 1) <= np.maximum.reduceat(weights, starts)
    edges = np.flatnonzero(inner & hopeful[number])
    edges = edges[np.argsort(-weights[edges], kind="stable")]

    found: Runs = []
    word = ids.tolist() if len(edges) * 8 > len(ids) else ids
    place, other, sets = in_order.tolist(), list(range(len(in_order))), {}

    def seed(i: int, j: int, t: int) -> None:
        period = j - i
        if t >= (least_times - 1) * period and t + period >= least_words and word[i - 1] != word[j - 1]:
            found.append((i, t + period, period))

    # a set is an interval of the suffix order; `other` leads from either end to the other one.  Of a run's places the first
    # ones share most and are united first, so most places are put at the end of their set.
    for e, t in zip(edges.tolist(), weights[edges].tolist()):
        low, high = other[e], other[e + 1]
        one = sets.pop(low, None) or [place[low]]
        two = sets.pop(e + 1, None) or [place[e + 1]]
        large, small = (one, two) if len(one) >= len(two) else (two, one)
        last = None
        for x, following in zip(small, [*small[1:], len(word)]):  # neighbours within `small` are none newly
            at = bisect_left(large, x)
            if at and large[at - 1] != last:
                seed(large[at - 1], x, t)
            if at < len(large) and large[at] < following:
                seed(x, large[at], t)
            large.insert(at, x)
            last = x
        sets[low] = large
        other[low], other[high] = high, low
    return found


def runs_of_texts(texts: list[list[bytes]], least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> list[Runs]:
    """The runs of each text by start, then period."""
    out: list[Runs] = [[] for _ in texts]
    firsts = np.cumsum([0] + [len(words) + 1 for words in texts])
    runs = periodic_runs(word_numbers(texts), least_words, least_times)
    owners = np.searchsorted(firsts, [r[0] for r in runs], side="right") - 1 if runs else []
    for (start, length, period), owner in zip(runs, owners):
        out[owner].append((int(start - firsts[owner]), int(length), int(period)))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: Runs) -> bytes:
    """The words without those of a run after its first period, joined by one blank."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(compress(words, keep.tolist()))


# --- Spark -------------------------------------------------------------------

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(documents: DataFrame, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES,
              group_words: int = GROUP_WORDS) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period) and collapsed text of each document.

    Words are what stands between blanks, numbered from 0.  A null or empty
    text has no words, no run and an empty collapsed text.  One row per input
    row, whatever its id; other columns are ignored.  Each text is worked on
    alone, whole, in one task; nothing is shuffled.
    """
    narrow_batches(documents.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])

    def searched(doc_ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of_texts(texts, least_words, least_times)
        plain = [collapsed(w, r).decode() for w, r in zip(texts, runs)]
        listed = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(map(len, texts), pa.int64()),
                                           pa.array(listed, schema.field(2).type), pa.array(plain, pa.string())], schema=schema)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").encode().split()  # bytes are split at the six ASCII blanks
                if texts and held + len(words) > group_words:
                    yield searched(doc_ids, texts)
                    doc_ids, texts, held = [], [], 0
                doc_ids.append(doc_id)
                texts.append(words)
                held += len(words)
            if texts:
                yield searched(doc_ids, texts)

    ddl = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, exactly; of equals the first in the array; null if there is none."""
    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    nothing = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, nothing, better)


def run_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run and digests of all runs and of the collapsed text, from ``find_runs``."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                               r["period"].cast("string")), F.lit("\n")))
    best = F.col("best")
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(F.lit(1000) * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """doc_id and text; texts of every tenth id hash are made periodic from a place of their own on (words joined by one blank)."""
    hashed = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    text = F.coalesce(F.col("text"), F.lit(""))

    def planted(words: Column) -> Column:
        n, g = F.size(words), F.floor(hashed / 10)
        a = (g % n).cast("int")
        rest = n - a
        p = (F.floor(rest / (g % 8 + 3)) + 1).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil(rest / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), F.slice(tail, 1, rest)), " ")).otherwise("")

    words = F.array(F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))  # bound once by the transform
    return documents.select("doc_id", F.when(hashed % 10 == 0, F.transform(words, planted)[0]).otherwise(text).alias("text"))
