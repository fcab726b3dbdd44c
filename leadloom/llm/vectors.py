"""Near-duplicate vectors by collision counting over many one-dimensional projections.

Vectors of length one are projected on many random lines.  Two vectors collide
on a line if their projections are within a window around each other; near
vectors collide on most lines.  Pairs that collide often enough are verified
by their cosine.  The count asked for is calibrated: a pair just at the wanted
cosine reaches it with a probability of at least ``recall``.

Within a block of vectors the projections of each line are sorted, so that the
window of a vector is a run of the sorted list.  Blocks are cells of a grid
over some of the lines; several grids with shifted cells are used, so that a
near pair shares a cell of at least one of them.  A cell with very many
vectors is cut into parts that are compared two by two.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadloom.llm.common import Batches, cut_lineage, narrow_batches
from leadloom.llm.graph import components


@dataclass(frozen=True)
class Lines:
    """Projections, windows and grids; the defaults find over 99 % of pairs at the least cosine."""

    cosine: float = 0.93
    lines: int = 32
    half_window: float = 0.6
    recall: float = 0.999
    grids: int = 8
    depth: int = 6
    cell: float = 2.5
    part: int = 1024
    seed: int = 7

    @cached_property
    def spread(self) -> float:
        """Deviation of the difference of two projections, for vectors at the least cosine."""
        return math.sqrt(2 - 2 * self.cosine)

    @cached_property
    def collisions(self) -> int:
        """Collisions that a pair at the least cosine reaches with the wanted recall."""
        p = math.erf(self.half_window / self.spread / math.sqrt(2))
        missed = 0.0
        for n in range(self.lines + 1):
            missed += math.comb(self.lines, n) * p**n * (1 - p) ** (self.lines - n)
            if missed > 1 - self.recall:
                return n
        return self.lines

    def directions(self, size: int) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((size, self.lines))

    def cells(self, projected: np.ndarray) -> np.ndarray:
        """Cell of each vector in each grid, as one number."""
        rng = np.random.default_rng(self.seed + 1)
        out = np.zeros((len(projected), self.grids), np.int64)
        for g in range(self.grids):
            chosen = rng.choice(self.lines, min(self.depth, self.lines), replace=False)
            places = np.floor((projected[:, chosen] + rng.uniform(0, self.cell, len(chosen))) / self.cell).astype(np.int64)
            for column in places.T:
                out[:, g] = out[:, g] * 1_000_003 + column
        return out


def window_counts(queries: np.ndarray, members: np.ndarray, half_window: float) -> np.ndarray:
    """Collisions of each query with each member: for each line, the run of the sorted members around the query."""
    counts = np.zeros((len(members), len(queries)), np.uint8)
    columns = np.arange(len(queries))
    for line in range(queries.shape[1]):
        order = np.argsort(members[:, line])
        placed = members[order, line]
        low = np.searchsorted(placed, queries[:, line] - half_window, side="left")
        high = np.searchsorted(placed, queries[:, line] + half_window, side="right")
        edges = np.zeros((len(members) + 1, len(queries)), np.int8)
        np.add.at(edges, (low, columns), 1)
        np.add.at(edges, (high, columns), -1)
        counts[order] += np.cumsum(edges[:-1], axis=0, dtype=np.int8).view(np.uint8)
    return counts.T


def compare(a: dict, b: dict | None, grid: int, lines: Lines) -> pd.DataFrame:
    """Links within one part of a cell (``b`` None) or between two: rows of id, number of vectors linked and one link (or null).

    A pair that shares a cell of an earlier grid was counted there.  Of the
    links only as many are given as connect what is connected.
    """
    inner = b is None
    b = a if inner else b
    counts = window_counts(a["lines"], b["lines"], lines.half_window)
    i, j = np.nonzero(counts >= lines.collisions)
    keep = i < j if inner else np.ones(len(i), bool)
    if grid:
        for g in range(grid):
            keep &= a["cells"][i, g] != b["cells"][j, g]
    i, j = i[keep], j[keep]
    near = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        s = slice(at, at + (1 << 16))
        near[s] = np.einsum("ij,ij->i", a["unit"][i[s]], b["unit"][j[s]]) >= lines.cosine
    i, j = i[near], j[near]
    links_a = np.bincount(i, b["copies"][j], len(a["id"])).astype(np.int64)
    links_b = np.bincount(j, a["copies"][i], len(b["id"])).astype(np.int64)
    rows = [(v, n, None) for v, n in zip(a["id"].tolist(), links_a.tolist()) if n] + [(v, n, None) for v, n in zip(b["id"].tolist(), links_b.tolist()) if n]
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a["id"][i].tolist(), b["id"][j].tolist()):
        if root(x) != root(y):
            parent[root(x)] = root(y)
            rows.append((x, 0, y))
    return pd.DataFrame({"id": pd.array([r[0] for r in rows], "Int64"), "n": pd.array([r[1] for r in rows], "Int64"),
                         "other": pd.array([r[2] for r in rows], "Int64")})


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the squares
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def near_vectors(embeddings: DataFrame, lines: Lines = Lines()) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``embeddings`` (vec_id, embedding, label).

    Vectors are compared if their labels are equal and not null and they have
    equally many components.  Null, empty and zero vectors, and vectors with
    a null or non-finite component, link with nothing.  Equal vectors of a
    label are linked with one another and compared as one.  Each row counts
    as a vector: rows with a repeated vec_id add up their links and are one
    node of the components; a row with a null id counts as a link of others,
    has no component and is not kept.  Other columns are ignored.
    """
    narrow_batches(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    big = F.lit(float("inf"))
    fit = F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("v", lambda x: x != 0), F.lit(False))
    usable = cut_lineage(rows.filter(fit))
    # the sum of a vector's hash and its label tell texts of bytes apart cheaply; the vector itself decides
    texts = cut_lineage(usable.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
                        .withColumn("node", F.xxhash64("label", "v")))
    placed = cut_lineage(_placed(texts.select("node", "label", "v", "copies"), lines))
    found = cut_lineage(_compared(placed, lines))
    links = found.filter("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    edges = found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))

    by_node = cut_lineage(texts.join(links, texts["node"] == links["id"], "left").select(
        "label", "v", texts["id"].alias("rep"), "node", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    # nodes of texts, and every vector with the node of its text: one graph over ids
    ids = by_node.filter(F.col("rep").isNotNull()).select("node", "rep")
    between = edges.join(ids.select(F.col("node").alias("a"), F.col("rep").alias("ra")), "a").join(
        ids.select(F.col("node").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    own = usable.join(by_node, ["label", "v"]).select("vec_id", "rep", "n_links")
    own = cut_lineage(own)
    copies = own.filter(F.col("vec_id") != F.col("rep")).select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    found = components(between.unionByName(copies))
    counted = own.select("vec_id", "n_links").unionByName(rows.filter(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links")))
    return counted.join(found, counted["vec_id"] == found["id"], "left").select(
        "vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept"))


def _placed(nodes: DataFrame, lines: Lines) -> DataFrame:
    """node, copies, unit vector, projections and cells of each vector."""
    schema = pa.schema([("node", pa.int64()), ("copies", pa.int64()), ("kind", pa.int64()), ("unit", pa.list_(pa.float64())), ("cells", pa.list_(pa.int64()))])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            frame = batch.to_pandas()
            for size, part in frame.groupby(frame["v"].map(len)):
                u = unit(np.stack(part["v"].to_numpy()))
                cells = lines.cells(u @ lines.directions(size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part["node"]), pa.array(part["copies"]), pa.array(part["kind"]), pa.array(list(u), pa.list_(pa.float64())),
                     pa.array(list(cells), pa.list_(pa.int64()))], schema=schema)

    kind = F.xxhash64("label", F.size("v")).alias("kind")
    return nodes.select("node", "copies", kind, "v").mapInArrow(run, "node long, copies long, kind long, unit array<double>, cells array<long>")


def _compared(placed: DataFrame, lines: Lines) -> DataFrame:
    """Links found, by cell and part: (id, n, null) and (id, 0, other)."""
    each = placed.select("node", "kind", F.posexplode("cells").alias("grid", "cell"))
    cells = each.select("node", "grid", F.xxhash64("kind", "grid", "cell").alias("block"))
    sizes = cut_lineage(cells.groupBy("block").agg(F.count("*").alias("n")).filter("n > 1"))
    parts = F.ceil(F.col("n") / lines.part).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(11)), F.col("parts")).cast("int")
    rows = cells.join(sizes, "block").withColumn("parts", parts).withColumn("part", mine)
    # the pair of parts (i, j), i <= j, gets the rows of both
    pairs = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "node", "grid", "part", F.xxhash64("block", F.least("part", "o"), F.greatest("part", "o")).alias("task"),
        F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"))
    full = cut_lineage(pairs).join(placed.select("node", "copies", "unit", "cells"), "node")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        size = len(first["unit"])

        def side(rows: pd.DataFrame) -> dict:
            u = np.stack(rows["unit"].to_numpy())
            return {"id": rows["node"].to_numpy(np.int64), "unit": u, "lines": u @ lines.directions(size),
                    "cells": np.stack(rows["cells"].to_numpy()), "copies": rows["copies"].to_numpy(np.int64)}

        a = group[group["part"] == first["i"]]
        if first["i"] == first["j"]:
            return compare(side(a), None, int(first["grid"]), lines)
        b = group[group["part"] == first["j"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": pd.array([], "Int64"), "n": pd.array([], "Int64"), "other": pd.array([], "Int64")})
        return compare(side(a), side(b), int(first["grid"]), lines)

    return full.groupBy("task").applyInPandas(run, "id long, n long, other long")
