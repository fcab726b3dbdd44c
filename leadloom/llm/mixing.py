"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets.  DataFrame functions only.

1. One scan of the texts gives a narrow table: id, source, words, a random
   key (a hash of id and text, so a rerun gives the same mix).
2. Sources get targets by weight; no target is above ``most`` times its
   source, and what lies above is shared anew among the others.
3. Rows are range-sorted by (source, key).  The totals of the ranges give
   every row the words before it in its source, without one task a source.
4. A source gives its texts as many whole times as its target allows, then
   those that begin within the rest; the last one is cut at the exact word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadloom.llm.common import cut_lineage, fresh
from leadloom.operators.serve import number_rows

WORD = "[^\\x20\\x09-\\x0D]+"
BLANKS = "[\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
#: Words of the mix, as a share of all words, and how often a source may come in it.
SHARE = 1.5
MOST = 2


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def random_key(doc_id: Column, text: Column) -> Column:
    """60 bits of a hash of id and text: the place of a row in the random order of its source."""
    seen = F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.conv(F.substring(seen, 1, 15), 16, 10).cast("long")


def words_before(rows: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows ahead in ``order`` within their group (columns without nulls).

    Rows are dealt into sampled ranges of (group, order), so a group that
    holds most rows lies over many ranges.  The totals of its ranges (one row
    a range at most) are summed in order, then rows within a range.
    """
    part, ahead = fresh("part", rows.columns), fresh("ahead", rows.columns)
    ranged = cut_lineage(rows.repartitionByRange(*group, *order).withColumn(part, F.spark_partition_id()))
    earlier = W.partitionBy(*group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy(*group, part).agg(F.sum(value).alias(ahead))
    totals = cut_lineage(totals.withColumn(ahead, F.coalesce(F.sum(ahead).over(earlier), F.lit(0))))
    within = W.partitionBy(*group, part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return summed.join(totals, [*group, part]).withColumn(name, F.col(name) + F.col(ahead)).drop(part, ahead)


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (words, weight) with ``target``: ``share`` of all words dealt by weight, nobody above ``most`` times its words.

    Words a unit of weight rise as sources reach their limit; each round is
    one aggregate that returns two numbers, until nobody new is above.
    """
    words, weight = F.col("words"), F.col("weight")
    total = sources.agg(F.sum("words").alias("words"), F.sum("weight").alias("weight")).first()
    capped, left = 0, total["weight"] or 0
    while True:
        level = (share * (total["words"] or 0) - most * capped) / left if left else float("inf")
        above = F.lit(float(most)) * words < weight * F.lit(float(level))
        now = sources.agg(F.coalesce(F.sum(F.when(above, words)), F.lit(0)).alias("capped"),
                          F.coalesce(F.sum(F.when(~above, weight)), F.lit(0)).alias("left")).first()
        if not left or now["left"] == left:
            break
        capped, left = now["capped"], now["left"]
    return sources.withColumn("target", F.least(F.lit(float(most)) * words, weight * F.lit(float(level)))
                              if left else F.lit(float(most)) * words)


def mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
        carry: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken and the ``carry`` columns.

    Size is the number of words between blanks; a null or empty text has
    none and gives none.  Sources are taken in the order of their code
    points, a null source last (a source of its own, apart from the empty
    one), with the weights of ``weights`` in turn.  The words taken of a
    source are exactly its target rounded down.  One row per input row: rows
    with equal or null ids are documents of their own, an empty table gives
    no rows, other columns are ignored.
    """
    held = {c: fresh(f"carry_{i}", ["doc_id", "source", "text"]) for i, c in enumerate(carry)}
    text = F.col("text")
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("unnamed"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), word_count(text).alias("size"),
        random_key(F.col("doc_id"), text).alias("key"), F.monotonically_increasing_id().alias("row"),
        *[F.col(c).alias(name) for c, name in held.items()])
    rows = cut_lineage(rows)
    group = ["unnamed", "source"]
    sources = rows.groupBy(*group).agg(F.sum("size").alias("words")).withColumn("place", F.struct(*group))
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    numbered = number_rows(sources, [], "place", "number").withColumn(
        "weight", F.element_at(dealt, ((F.col("number") - 1) % len(weights) + 1).cast("int")))
    wanted = targets(cut_lineage(numbered.select(*group, "words", "weight")), share, most)
    budget = F.floor("target").cast("long")
    times = F.when(F.col("words") > 0, F.floor(budget / F.col("words"))).otherwise(0).cast("long")
    wanted = cut_lineage(wanted.select(*group, F.col("words").alias("source_size"), "target", times.alias("times"),
                                       (budget - times * F.col("words")).alias("rest")))
    placed = words_before(rows, group, ["key", "row"], "size", "before").join(wanted, group)
    last = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before")))
    return placed.select(
        "doc_id", F.when(~F.col("unnamed"), F.col("source")).alias("source"), "size", "source_size", "target",
        (F.col("size") * F.col("times") + last).cast("long").alias("taken"), *[F.col(name).alias(c) for c, name in held.items()])


def mixture(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: doc_id, source, epoch (from 1), words and text, a row for each time that a document comes.

    The one document of a source that is cut gives its first words, joined by
    one blank; all others keep their text as it is.
    """
    taken = mix(documents, weights, share, most, carry=("text",)).filter("taken > 0")
    epochs = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    each = taken.withColumn("epoch", F.explode(epochs))
    words = F.least("size", F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    first = F.slice(F.filter(F.split("text", BLANKS), lambda w: w != ""), F.lit(1), F.col("words").cast("int"))
    return each.withColumn("words", words).select(
        "doc_id", "source", "epoch", "words",
        F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(F.array_join(first, " ")).alias("text"))
