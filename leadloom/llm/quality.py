"""Document quality: a generalised additive model with pairwise interactions.

Every feature and a few pairs of features get a lookup table.  The tables are
learned by cyclic boosting: in each round, for one feature after another, a
shallow tree over the feature's bins is fitted to the gradient of the log loss
and a small part of it is added to the feature's table; then the same for the
pairs.  A score is the sum of one entry per table, so scoring is a few
vectorised additions per document.

Features are shares and counts of a text's characters, words and lines.  The
id, the language and the source of a document are never inputs.
"""

from __future__ import annotations

import itertools
import operator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from leadloom.llm.common import Batches, fresh, held, narrow_batches, texts_of

#: At most so many labelled rows are used for training, those with the smallest hash of their id.
TRAIN_ROWS = 20_000

LOWER, UPPER, DIGIT, SPACE, NEWLINE, STOP, BANG, BAR, MARK, WIDE, OTHER = range(11)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    for code in range(33, 127):
        kinds[code] = MARK
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), ("0123456789", DIGIT),
                        (" \t", SPACE), ("\n", NEWLINE), (".,;:?'\"()-", STOP), ("!", BANG), ("|", BAR)):
        kinds[list(chars.encode())] = kind
    kinds[128:] = WIDE
    return kinds


KINDS = _byte_kinds()
FEATURES = (
    "log_bytes", "upper", "digits", "bangs", "bars", "marks", "stops", "wide", "line_words", "word_bytes", "distinct_words",
    "repeated_words", "short_words", "repeated_lines", "longest_word", "upper_lines",
)


def text_features(text: str) -> list[float]:
    """The features of one text; an empty one gives zeros."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = np.bincount(KINDS[raw], minlength=11) if len(raw) else np.zeros(11, np.int64)
    words, lines = text.split(), text.split("\n")
    count, letters = max(1, len(words)), max(1, n[LOWER] + n[UPPER])
    repeated = sum(map(operator.eq, words, itertools.islice(words, 1, None)))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return [
        float(np.log1p(len(raw))), n[UPPER] / letters, n[DIGIT] / max(1, len(raw)), n[BANG] / count, n[BAR] / count,
        n[MARK] / count, n[STOP] / count, n[WIDE] / max(1, len(raw)), count / len(lines),
        (len(raw) - n[SPACE] - n[NEWLINE]) / count, len(set(words)) / count, repeated / count,
        np.count_nonzero(sizes < 4) / count, 1 - len(set(lines)) / len(lines), float(np.log1p(sizes.max(initial=0))),
        sum(map(str.isupper, lines)) / len(lines),
    ]


def features(texts: list[str]) -> np.ndarray:
    return np.array([text_features(x) for x in texts], float).reshape(len(texts), len(FEATURES))


# --- model -------------------------------------------------------------------

@dataclass
class AdditiveModel:
    """Log odds = intercept + one table entry per feature + one per pair of features."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edges, x[:, f], side="right")]
        for (a, b), values in zip(self.pairs, self.pair_tables):
            at = [np.searchsorted(self.pair_edges[f], x[:, f], side="right") for f in (a, b)]
            total += values[at[0], at[1]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges of at most ``bins`` bins with about equally many values."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)) if len(values) else np.empty(0)


def _best_cut(g: np.ndarray, h: np.ndarray, low: int, high: int, least: float, smooth: float) -> tuple[float, int]:
    """Gain and place of the best cut of the bins low..high - 1."""
    left_g, left_h = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
    if not len(left_g):
        return 0.0, low
    all_g, all_h = g[low:high].sum(), h[low:high].sum()
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + smooth) + right_g**2 / (right_h + smooth) - all_g**2 / (all_h + smooth)
    gain = np.where((left_h >= least) & (right_h >= least), gain, 0.0)
    best = int(np.argmax(gain))
    return float(gain[best]), low + best + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float, smooth: float) -> np.ndarray:
    """Values per bin of a tree with at most ``leaves`` leaves, grown at the best cut first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*_best_cut(g, h, low, high, least, smooth), low, high) for low, high in parts]
        gain, cut, low, high = max(found)
        if gain <= 1e-9:
            break
        parts.remove((low, high))
        parts += [(low, cut), (cut, high)]
    values = np.zeros(len(g))
    for low, high in parts:
        values[low:high] = g[low:high].sum() / (h[low:high].sum() + smooth)
    return values


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float, smooth: float) -> tuple[float, np.ndarray]:
    """A cut of one feature, then a cut of the other on either side: gain and values per pair of bins."""
    best_gain, best = 0.0, np.zeros_like(g)
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(gg)):
            gain, values = 0.0, np.zeros_like(gg)
            for rows in (slice(0, cut), slice(cut, None)):
                sg, sh = gg[rows].sum(axis=0), hh[rows].sum(axis=0)
                values[rows] = _tree(sg, sh, 2, least, smooth)
                more, _ = _best_cut(sg, sh, 0, len(sg), least, smooth)
                gain += more + sg.sum() ** 2 / (sh.sum() + smooth)
            if gain > best_gain:
                best_gain, best = gain, values.T if turned else values
    return best_gain, best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 48, pair_bins: int = 8, rounds: int = 120, pair_rounds: int = 20,
        n_pairs: int = 4, rate: float = 0.1, leaves: int = 3, least: float = 2.0, smooth: float = 1.0) -> AdditiveModel:
    """Learn the tables.  Without labelled rows every score is 0.5; with one class only, every score leans to it."""
    model = AdditiveModel()
    if not len(x):
        return model
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(share / (1 - share)))
    model.edges = [_edges(x[:, f], bins) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if share * (len(y) + 1) < 1 or (1 - share) * (len(y) + 1) < 1:
        return model
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    odds = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, values in enumerate(model.tables):
            if len(values) < 2:
                continue
            g, h = slopes()
            step = rate * _tree(np.bincount(at[f], g, len(values)), np.bincount(at[f], h, len(values)), leaves, least, smooth)
            values += step
            odds += step[at[f]]

    model.pair_edges = [_edges(x[:, f], pair_bins) for f in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.pair_edges)]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        code = coarse[a] * shape[1] + coarse[b]
        return tuple(np.bincount(code, v, shape[0] * shape[1]).reshape(shape) for v in slopes())

    ranked = sorted(((-_pair_tree(*grid(a, b), least, smooth)[0], a, b)
                     for a, b in itertools.combinations(range(x.shape[1]), 2)))[:n_pairs]
    model.pairs = [(a, b) for _, a, b in ranked]
    model.pair_tables = [np.zeros([len(model.pair_edges[f]) + 1 for f in pair]) for pair in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), values in zip(model.pairs, model.pair_tables):
            step = rate * _pair_tree(*grid(a, b), least, smooth)[1]
            values += step
            odds += step[coarse[a], coarse[b]]
    return model


# --- Spark -------------------------------------------------------------------

def train(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, folds: int = 3, held_fold: int = 1) -> AdditiveModel:
    """Fit on labelled documents outside the held-out fold (crc32 of doc_id modulo ``folds`` = ``held_fold``).

    At most ``train_rows`` labelled documents are used, those with the
    smallest hash of their id; an id labelled more than once takes the mean,
    0.5 counting as 1.  Rows with a null id or label are not used.
    """
    spark = documents.sparkSession
    narrow_batches(spark)
    doc_id, mark = F.col("doc_id"), F.xxhash64(F.col("doc_id"), F.lit(17))
    chosen = (
        labels.select("doc_id", "quality").filter(F.col("quality").isNotNull() & (held(doc_id, folds) != held_fold))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
        .orderBy(mark, "doc_id").limit(train_rows)
    )
    known = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    names = list(FEATURES)
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.float64()), *((f, pa.float64()) for f in names)])

    def measure(batches: Batches) -> Batches:
        for batch in batches:
            x = features(texts_of(batch.column("text")))
            columns = [batch.column("doc_id").cast(pa.int64()), batch.column("y"), *(pa.array(c) for c in x.T)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    measured = known.select("doc_id", "y", "text").mapInArrow(measure, "doc_id long, y double, " + ", ".join(f"{f} double" for f in names))
    rows = measured.orderBy(mark, *measured.columns).limit(train_rows).toPandas()
    return fit(rows[names].to_numpy(float), rows["y"].to_numpy(float))


def score_documents(documents: DataFrame, model: AdditiveModel, score: str = "score") -> DataFrame:
    """All columns of ``documents`` and the score of each whole text; null and empty texts are scored as empty."""
    narrow_batches(documents.sparkSession)
    names = documents.columns
    at = names.index("text")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            scores = model.score(features(texts_of(batch.column(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, score])

    schema = T.StructType([*documents.schema.fields, T.StructField(score, T.DoubleType(), False)])
    return documents.mapInArrow(run, schema)


def classify(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``documents``.

    One row per input row, repeated ids included; a null id is never held
    out.  Other columns of either table are ignored.  Empty documents give an
    empty result, an empty label table gives scores of 0.5.
    """
    model = train(documents, labels, **options)
    scored = score_documents(documents.select("doc_id", "text"), model)
    held_out = F.coalesce(held(F.col("doc_id"), options.get("folds", 3)) == options.get("held_fold", 1), F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The documents with a score of at least ``least``, columns as they were."""
    model = train(documents, labels, **options)
    score = fresh("score", documents.columns)
    return score_documents(documents, model, score).filter(F.col(score) >= least).select(documents.columns)
