"""Near duplicates by weighted MinHash: DartMinHash signatures, banded joining, exact verification.

A text is a weighted set: its shingles of five words with their counts.  Darts
are thrown at the plane of every element (weight x rank); their places are
hashes of the element alone, so texts that share an element share its darts.
A dart hits a text if it lies below the element's weight.  Each dart belongs
to one of k coordinates, and the earliest hit (by rank) of each coordinate is
its minhash.  Only darts of small rank are thrown: about k ln k per text,
whatever its size.

Signatures are cut into bands.  Texts that agree in a band are candidates.
In each bucket every member is compared with the smallest one; the buckets
whose members then still belong to several components are compared across
components, block by block.  So a bucket of n near copies costs n comparisons,
no list of all pairs is ever made, and no link between components is lost.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadloom.llm.common import Batches, cut_lineage, may_hold, narrow_batches, texts_of
from leadloom.llm.graph import components
from leadloom.llm.shingles import mix, shingled

COORDINATES = 80
BAND = 4
SIMILARITY = 0.8
#: Texts of a side that are compared in one task.
BLOCK = 256
_FINE = 6
_tables: dict[float, np.ndarray] = {}


# --- signatures ----------------------------------------------------------------

def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Number of darts of an area, from uniform numbers."""
    if mean not in _tables:
        n = np.arange(int(mean + 12 * math.sqrt(mean) + 24))
        logs = n * math.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(n[1:]))])
        _tables[mean] = np.cumsum(np.exp(logs))
    return np.searchsorted(_tables[mean], u, side="right")


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Darts:
    """The earliest dart per text and coordinate."""

    def __init__(self, n_texts: int, coordinates: int):
        self.k = coordinates
        self.best = np.full(n_texts * coordinates, np.inf)

    def region(self, element, weight, text, limit, low_weight: float, width: float, low_rank, height: float, number) -> None:
        """Throw the darts of one region of every element: weights from ``low_weight``, ranks from ``low_rank``."""
        seed = mix(element + mix(np.atleast_1d(number).astype(np.uint64) + np.uint64(0x51ED2701)))
        darts = _poisson(_uniform(seed), width * height)
        hit = np.flatnonzero(darts)
        if not len(hit):
            return
        each = np.repeat(hit, darts[hit])
        nth = np.arange(len(each)) - np.repeat(np.cumsum(darts[hit]) - darts[hit], darts[hit])
        place = mix(seed[each] + (nth + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        rank = (low_rank[each] if isinstance(low_rank, np.ndarray) else low_rank) + height * _uniform(place)
        place = mix(place)
        inside = (low_weight + width * _uniform(place) < weight[each]) & (rank <= limit[text[each]])
        coordinate = (mix(place) % np.uint64(self.k)).astype(np.int64)
        np.minimum.at(self.best, (text[each] * self.k + coordinate)[inside], rank[inside])

    def throw(self, element, weight, text, limit) -> None:
        """All darts with ranks up to the limit of their text."""
        level, top = 0, int(weight.max(initial=0))
        while (low_weight := 0 if level == 0 else 1 << (level - 1)) < top:
            width = max(1, low_weight)
            on = weight > low_weight
            e, w, t = element[on], weight[on], text[on]
            for i in range(_FINE + 1):  # ranks below 1, in halves
                low = 0.0 if i == 0 else 2.0 ** (i - 1 - _FINE)
                near = limit[t] > low
                self.region(e[near], w[near], t[near], limit, low_weight, width, low, max(low, 2.0**-_FINE), level * 1_000_003 + i)
            cells = np.maximum(0, np.ceil(limit[t]) - 1).astype(np.int64)
            if cells.any():
                at = np.repeat(np.arange(len(e)), cells)
                rank = 1 + np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
                self.region(e[at], w[at], t[at], limit, low_weight, width, rank.astype(float), 1.0, level * 1_000_003 + 100 + rank)
            level += 1


def signatures(element: np.ndarray, weight: np.ndarray, text: np.ndarray, n_texts: int, coordinates: int = COORDINATES) -> np.ndarray:
    """Ranks of the minhashes, n_texts x coordinates; a text without elements has infinite ones."""
    total = np.bincount(text, weight, n_texts)
    limit = np.divide(coordinates * (math.log(coordinates) + 2), total, out=np.zeros(n_texts), where=total > 0)
    darts = Darts(n_texts, coordinates)
    todo = total > 0
    while todo.any():
        on = todo[text]
        darts.throw(element[on], weight[on], text[on], limit)
        todo &= np.isinf(darts.best.reshape(n_texts, -1)).any(axis=1)
        limit = np.where(todo, 2 * limit, limit)
    return darts.best.reshape(n_texts, coordinates)


def bands(ranks: np.ndarray, band: int = BAND) -> np.ndarray:
    """A hash per text and band."""
    bits = ranks.view(np.uint64).reshape(len(ranks), -1, band)
    out = np.broadcast_to(np.arange(bits.shape[1], dtype=np.uint64), bits.shape[:2]).copy()
    for j in range(band):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, j])
    return out.view(np.int64)


def similarities(texts: list[str], left: list[int], right: list[int], columns: int = 2048) -> np.ndarray:
    """Weighted Jaccard similarity of the left with the right texts.

    A shingle with count c becomes c elements; what two texts share is then
    a product of 0-1 matrices, made from elements of two texts or more, some
    columns at a time.
    """
    elements, owners = [], []
    for first, s in shingled(texts):
        nth = np.arange(int(s.count.sum())) - np.repeat(np.cumsum(s.count) - s.count, s.count)
        elements.append(mix(np.repeat(s.shingle, s.count) + nth.astype(np.uint64)))
        owners.append(first + np.repeat(s.text, s.count))
    elements, owners = np.concatenate(elements), np.concatenate(owners)
    weight = np.bincount(owners, minlength=len(texts)).astype(np.float64)
    _, number, times = np.unique(elements, return_inverse=True, return_counts=True)
    new = np.cumsum(times > 1) - 1
    common = times[number] > 1
    number, owners = new[number[common]], owners[common]
    order = np.argsort(number, kind="stable")
    number, owners = number[order], owners[order]
    shared = np.zeros((len(left), len(right)))
    for low in range(0, int(number.max(initial=-1)) + 1, columns):
        a, b = np.searchsorted(number, [low, low + columns])
        has = np.zeros((len(texts), columns), np.float32)
        has[owners[a:b], number[a:b] - low] = 1
        shared += has[left] @ has[right].T
    total = weight[left][:, None] + weight[right][None] - shared
    return np.divide(shared, total, out=np.ones_like(shared), where=total > 0)


# --- Spark -------------------------------------------------------------------

def sketch(documents: DataFrame, coordinates: int = COORDINATES, band: int = BAND) -> DataFrame:
    """doc_id, the key of the text's words (two hashes, number of words) and its band hashes (none for a text without words)."""
    narrow_batches(documents.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("words", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids = batch.column(0)
            for first, s in shingled(texts_of(batch.column(1))):
                n = len(s.words)
                hashes = bands(signatures(s.shingle, s.count, s.text, n, coordinates), band)
                has = s.words > 0
                ends = np.concatenate([[0], np.cumsum(has * hashes.shape[1])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[has].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, n).cast(pa.int64()), pa.array(s.first_key.view(np.int64)), pa.array(s.second_key.view(np.int64)),
                     pa.array(s.words.astype(np.int64)), lists], schema=schema)

    ddl = "doc_id long, k1 long, k2 long, words long, bands array<long>"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


def _verified(groups: DataFrame, documents: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) found in groups of rows (task, id, component, side).

    In each task the texts of side 0 or 2 are compared with those of side 1
    or 2; two that are already connected, before or within the task, are not.
    """
    wanted = cut_lineage(groups)
    ids = wanted.select(F.col("id").alias("doc_id")).distinct()
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.col("doc_id").isNotNull())
    texts = may_hold(docs, "doc_id", ids).filter("may_hold").select(F.col("doc_id").alias("id"), "text")
    rows = wanted.join(texts, "id").select("task", "id", "component", "side", "text")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["id", "side"])
        texts = group.drop_duplicates("id")
        at = {id: i for i, id in enumerate(texts["id"].tolist())}
        left = [at[x] for x in group.loc[group["side"] != 1, "id"]]
        right = [at[x] for x in group.loc[group["side"] != 0, "id"]]
        i, j = np.nonzero(similarities(texts["text"].tolist(), left, right) >= similarity)
        ids, parts = texts["id"].tolist(), texts["component"].tolist()
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links = []
        for x, y in zip(i.tolist(), j.tolist()):
            x, y = left[x], right[y]
            if root(parts[x]) != root(parts[y]):
                parent[root(parts[x])] = root(parts[y])
                links.append((ids[x], ids[y]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return cut_lineage(rows.groupBy("task").applyInPandas(compare, "a long, b long"))


def _part(id: str, size: Column) -> Column:
    """Block of an id among blocks of about BLOCK rows."""
    return F.pmod(F.xxhash64(F.col(id), F.lit(5)), F.ceil(size / BLOCK).cast("long"))


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, coordinates: int = COORDINATES, band: int = BAND) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and kept (whether it is that one) of every row.

    Two documents are linked if the weighted Jaccard similarity of their
    shingles is at least ``similarity``; classes are connected components.
    Texts with the same words are one class, also without any word (null,
    empty, blank).  Rows with one doc_id are taken as copies of one document.
    A null id has the class of the rows with the same words, null if none of
    them has an id, and is kept only then.  Other columns are ignored.
    """
    docs = documents.select("doc_id", "text")
    key = ["k1", "k2", "words"]
    rows = cut_lineage(sketch(docs, coordinates, band))
    texts = cut_lineage(rows.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count("*").alias("n")))
    # written tables on both sides: a text with very many copies can be split
    copies = rows.filter(F.col("doc_id").isNotNull()).join(texts.filter("n > 1").select(*key, "rep"), key)
    equal = copies.filter(F.col("doc_id") != F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    hashes = texts.filter(F.col("rep").isNotNull()).select(F.explode("bands").alias("bucket"), F.col("rep").alias("id"))
    shared = cut_lineage(hashes.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
                         .filter(F.col("first") != F.col("last")).drop("last"))
    members = cut_lineage(hashes.join(shared, "bucket"))
    near = _against_first(members, docs, similarity)
    linked = components(near)
    across = _across(members, linked, docs, similarity)
    found = components(equal.unionByName(near).unionByName(across))

    class_of = found.select(F.col("id").alias("rep"), "component")
    by_text = cut_lineage(texts.select(*key, "rep").join(class_of, "rep", "left").select(*key, F.coalesce("component", "rep").alias("class_id")))
    return rows.join(by_text, key).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def _against_first(members: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Every member of a bucket against the bucket's first."""
    pairs = members.filter(F.col("id") != F.col("first")).select("first", "id").distinct()
    sizes = cut_lineage(pairs.groupBy("first").agg(F.count("*").alias("n")))
    tasks = cut_lineage(pairs.join(sizes, "first").select("first", "id", F.xxhash64("first", _part("id", F.col("n"))).alias("task")))
    me = tasks.select("task", "id", F.col("id").alias("component"), F.lit(1).alias("side"))
    leads = tasks.select("task", "first").distinct().select("task", F.col("first").alias("id"), F.col("first").alias("component"), F.lit(0).alias("side"))
    return _verified(me.unionByName(leads), docs, similarity)


def _across(members: DataFrame, linked: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The members of a bucket that are in different components, the smaller components against all.

    Of buckets with the same members one is taken.  The largest component of
    a bucket is not compared with itself; all else is, in blocks.
    """
    known = members.select("bucket", "id").join(linked, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    sized = cut_lineage(known.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id") % (1 << 40)).alias("who")))
    several = sized.groupBy("bucket").agg(
        F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("who").alias("who"),
        F.max(F.struct("n", "component")).alias("top")).filter("parts > 1")
    buckets = cut_lineage(several.groupBy("n", "who").agg(F.min_by(F.struct("bucket", "top"), "bucket").alias("b")).select(
        "b.bucket", F.col("b.top.component").alias("top"), F.col("b.top.n").alias("n_top"), (F.col("n") - F.col("b.top.n")).alias("n_rest")))
    rows = cut_lineage(known.join(buckets, "bucket"))
    n_rest, n_top = F.ceil(F.col("n_rest") / BLOCK), F.ceil(F.col("n_top") / BLOCK)
    rest = rows.filter(F.col("component") != F.col("top")).withColumn("at", _part("id", F.col("n_rest")))
    top = rows.filter(F.col("component") == F.col("top")).withColumn("at", _part("id", F.col("n_top")))

    def tasks(of: DataFrame, kind: str, i: Column, j: Column, side: Column) -> DataFrame:
        """Rows of the tasks (i, j); one of the two may be an array."""
        return of.withColumn("i", i).withColumn("i", F.explode("i")).withColumn("j", j).withColumn("j", F.explode("j")).select(
            F.xxhash64("bucket", F.lit(kind), "i", "j").alias("task"), "id", "component", side.cast("int").alias("side"))

    at = F.col("at")
    side = F.when(F.col("i") == F.col("j"), 2)
    groups = [
        tasks(rest, "rest", F.array(at), F.sequence(at, (n_rest - 1).cast("long")), side.otherwise(0)),
        tasks(rest.filter(at > 0), "rest", F.sequence(F.lit(0).cast("long"), at - 1), F.array(at), F.lit(1)),
        tasks(rest, "top", F.array(at), F.sequence(F.lit(0).cast("long"), (n_top - 1).cast("long")), F.lit(0)),
        tasks(top, "top", F.sequence(F.lit(0).cast("long"), (n_rest - 1).cast("long")), F.array(at), F.lit(1)),
    ]
    union = groups[0]
    for g in groups[1:]:
        union = union.unionByName(g)
    return _verified(union, docs, similarity)


def drop_near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, **options) -> DataFrame:
    """One document of each class, columns as they were; of rows with one kept id, one stays (the first by text).

    Rows without an id stay unless a row with an id has the same words.
    """
    classes = near_duplicates(documents, similarity, **options)
    counted = cut_lineage(classes.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    gone = counted.filter(~F.col("kept") | ((F.col("n") > 1) & F.col("doc_id").isNotNull()))
    names, inner = documents.columns, [f"c{i}" for i in range(len(documents.columns))]
    doc_id, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    docs = documents.toDF(*inner).withColumn("id", F.col(doc_id).cast("long"))
    with_id = docs.filter(F.col("id").isNotNull())
    flagged = may_hold(with_id, "id", gone.select(F.col("doc_id").alias("id")))
    clean = flagged.filter("not may_hold").select(*inner)
    asked = flagged.filter("may_hold").join(gone.select(F.col("doc_id").alias("id"), F.col("kept").alias("stays"), "n"), "id", "left")
    single = asked.filter(F.col("n").isNull()).select(*inner)
    first = F.row_number().over(W.partitionBy(doc_id).orderBy(text))
    repeated = asked.filter("stays").withColumn("first", first).filter("first = 1").select(*inner)
    out = clean.unionByName(single).unionByName(repeated)
    if not counted.filter("doc_id is null").isEmpty():
        out = out.unionByName(_without_id(docs.filter(F.col("id").isNull()).select(*inner), documents, names, inner))
    return out.toDF(*names)


def _without_id(rows: DataFrame, documents: DataFrame, names: list[str], inner: list[str]) -> DataFrame:
    """The rows without an id whose words no row with an id has."""
    at = names.index("text")
    low = F.translate(F.coalesce(F.col(f"c{at}"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.trim(F.regexp_replace(low, r"[\x09-\x0D\x20]+", " "))
    known = documents.toDF(*inner).filter(F.col(f"c{names.index('doc_id')}").isNotNull()).select(F.sha2(words, 256).alias("words"))
    return rows.withColumn("words", F.sha2(words, 256)).join(known, "words", "left_anti").select(*inner)
