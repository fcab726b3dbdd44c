"""Secrets in texts, by a trigram inverted index; DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived
that every match must fulfil.  The index has, for every trigram of the
queries, the ids of the documents that contain it, in blocks of documents.
Postings are intersected and united as the queries say; the documents that
remain are verified with the regular expression.  A rule whose expression has
no trigram that must be there is run over all texts.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.llm.common import cut_lineage, may_hold


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression, and the least length of one of its groups (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed by the operator's contract.  A run of one class that is too short holds no long enough match either, so the
#: least length of "access" and "hex" is part of the expression; "assign" takes short values too and drops them after.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----"),
)
RULES = BASE + MORE

# --- queries: True, a trigram, or ("and" | "or", frozenset of queries) -----------

Query = bool | str | tuple
#: Texts followed one by one while reading an expression; more of them end a run.
SPELLINGS = 32


def _join(kind: str, parts: list[Query]) -> Query:
    """Parts under one "and" or "or"; True is what any text fulfils."""
    if kind == "or" and any(p is True for p in parts):
        return True
    flat = {q for p in parts if p is not True for q in (p[1] if p[0] == kind and not isinstance(p, str) else [p])}
    if kind == "or":  # a or (a and b) is a
        needs = {p: p[1] if p[0] == "and" and not isinstance(p, str) else frozenset([p]) for p in flat}
        flat = {p for p in flat if not any(needs[q] < needs[p] for q in flat)}
    kept = frozenset(flat)
    return True if not kept else next(iter(kept)) if len(kept) == 1 else (kind, kept)


def _of_texts(texts: set[str]) -> Query:
    """What a text must contain to contain one of ``texts``."""
    return _join("or", [_join("and", [t[i : i + 3] for i in range(len(t) - 2)]) for t in texts])


def _spellings(item: tuple) -> set[str] | None:
    """All texts that an element matches, in lower case; None if they are many."""
    kind, value = item
    if kind is sre.LITERAL:
        return {chr(value).lower()}
    if kind is sre.IN and all(k is sre.LITERAL for k, _ in value) and len(value) <= SPELLINGS:
        return {chr(v).lower() for _, v in value}
    if kind is sre.AT:
        return {""}
    if kind is sre.SUBPATTERN:
        return _spellings_of(value[-1])
    if kind is sre.BRANCH:
        each = [_spellings_of(p) for p in value[1]]
        return None if any(e is None for e in each) else set().union(*each)
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] != sre.MAXREPEAT and value[1] <= 3:
        once = _spellings_of(value[2])
        if once is None:
            return None
        out: set[str] = set()
        for n in range(value[0], value[1] + 1):
            if len(once) ** n > SPELLINGS:
                return None
            out |= {"".join(p) for p in product(once, repeat=n)}
        return out
    return None


def _spellings_of(items) -> set[str] | None:
    texts = {""}
    for item in items:
        more = _spellings(item)
        if more is None or len(texts) * len(more) > SPELLINGS:
            return None
        texts = {a + b for a in texts for b in more}
    return texts


def _query_of(items) -> Query:
    parts: list[Query] = []
    run = {""}
    for item in items:
        more = _spellings(item)
        if more is not None and len(run) * len(more) <= SPELLINGS:
            run = {a + b for a in run for b in more}
            continue
        parts.append(_of_texts(run))
        run = more if more is not None and len(more) <= SPELLINGS else {""}
        if more is None:
            kind, value = item
            if kind is sre.SUBPATTERN:
                parts.append(_query_of(value[-1]))
            elif kind is sre.BRANCH:
                parts.append(_join("or", [_query_of(p) for p in value[1]]))
            elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
                parts.append(_query_of(value[2]))
    return _join("and", [*parts, _of_texts(run)])


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of an expression, over texts in lower case; True if nothing is sure to be there."""
    return _query_of(parser.parse(pattern))


def trigrams_of(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


# --- index -------------------------------------------------------------------

def trigram_index(documents: DataFrame, trigrams: list[str], block_rows: int = 50_000) -> DataFrame:
    """block, trigram, docs: the ids of a block of documents that contain the trigram, in lower case.

    Documents are dealt into blocks of about ``block_rows`` by a hash of
    their id, so a posting list is bounded however common its trigram is.
    Rows with a null id are not indexed.
    """
    blocks = max(1, -(-documents.count() // block_rows))
    # the lower text is bound by the outer transform: a lambda's body runs for each trigram, and `lower` with it
    found = F.flatten(F.transform(F.array(F.lower("text")), lambda low: F.filter(F.array(*map(F.lit, trigrams)), lambda g: F.contains(low, g))))
    rows = documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return (
        rows.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), F.explode(found).alias("trigram"))
        .groupBy("block", "trigram").agg(F.collect_set("doc_id").alias("docs"))
    )


def _postings(query: Query, held: Column) -> Column:
    """The ids that fulfil a query, from a map of trigram to ids."""
    if isinstance(query, str):
        return F.coalesce(F.element_at(held, query), F.array().cast("array<long>"))
    kind, parts = query
    out, *others = [_postings(p, held) for p in sorted(parts, key=str)]
    for other in others:
        out = F.array_intersect(out, other) if kind == "and" else F.array_union(out, other)
    return out


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """doc_id and the kinds whose query the document fulfils."""
    held = F.map_from_entries(F.collect_list(F.struct("trigram", F.col("docs").cast("array<long>"))))
    by_block = index.groupBy("block").agg(held.alias("held"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), _postings(q, F.col("held")).alias("docs")) for k, q in queries.items()])
    each = by_block.select(F.explode(kinds).alias("k")).select("k.kind", F.explode("k.docs").alias("doc_id"))
    return each.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


# --- matches -----------------------------------------------------------------

def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, kind, end) of the matches from left to right, in code points, end exclusive; too short ones are left out.

    The text between matches (split) and the matches (extract) alternate, so
    their lengths give the places.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    zipped = F.arrays_zip(gaps.alias("gap"), F.transform(matches, F.length).alias("size"), sizes.alias("checked"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:string,end:int>>").alias("found"))

    def step(so_far: Column, part: Column) -> Column:
        start = so_far["at"] + part["gap"]
        end = start + F.coalesce(part["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        found = F.when(part["checked"] >= rule.least, F.concat(so_far["found"], F.array(span))).otherwise(so_far["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    return F.when(F.regexp_like(text, pattern), F.aggregate(zipped, empty, step)["found"]).otherwise(empty["found"])


def find_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES, block_rows: int = 50_000) -> DataFrame:
    """doc_id and spans (array of start, kind, end, by start, then kind in the order of ``rules``) of every row.

    One row per input row, whatever its id: repeated ids keep their rows
    apart, rows with a null id are verified for every rule.  A null text is
    empty.  Other columns are ignored.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    number = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])

    def ordered(wanted) -> Column:
        """All spans by start and rule; ``wanted`` says for a rule whether its expression is run."""
        nothing = F.array().cast("array<struct<start:int,kind:string,end:int>>")
        every = F.concat(*[F.when(c, spans(F.col("text"), r)).otherwise(nothing) for r in rules if (c := wanted(r)) is not None], nothing)
        keyed = F.transform(every, lambda s: F.struct(s["start"].alias("start"), number[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
        return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    if not indexed:
        return docs.select("doc_id", ordered(lambda r: F.lit(True)).alias("spans"))
    index = cut_lineage(trigram_index(docs, sorted(set().union(*map(trigrams_of, indexed.values()))), block_rows))
    chosen = cut_lineage(candidates(index, indexed))
    # only documents that may be candidates are shuffled; the others need the rules without trigrams alone
    flagged = may_hold(docs, "doc_id", chosen).withColumn("may_hold", F.col("may_hold") | F.col("doc_id").isNull())
    full = flagged.filter("not may_hold").select("doc_id", ordered(lambda r: None if r.kind in indexed else F.lit(True)).alias("spans"))
    verified = flagged.filter("may_hold").join(chosen, "doc_id", "left").select("doc_id", ordered(
        lambda r: F.col("doc_id").isNull() | F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), r.kind) if r.kind in indexed else F.lit(True)
    ).alias("spans"))
    return full.unionByName(verified)


def written(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the number of spans of each base kind, the digest of the base spans, and all spans as text."""
    base = [r.kind for r in BASE]
    found = find_secrets(documents, rules)

    def of_kind(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(written(of_kind(*base)), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
