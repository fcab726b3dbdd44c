"""Alignment of tokenizers, periodic runs and source mixing: brute force, odd and empty tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from leadloom.llm import align, mixing, periodic, queries
from .test_operators import SF, empty, odd


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- alignment ---------------------------------------------------------------

@pytest.fixture(scope="module")
def plainly():
    """Ids and byte ends of a text under both tokenizers, the whole text at once."""
    a, b = Tokenizer.from_file(align.byte_bpe()), sentencepiece.SentencePieceProcessor(model_file=align.piece_bpe())
    a.encode_special_tokens = True
    pair = align.pair_of(align.byte_bpe(), align.piece_bpe())

    def run(text):
        if not text:
            return [], []
        sides = [(i, pair.a_bytes[i]) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, pair.b_bytes[i]) for i in b.encode(text)]
        return sides if all(b"".join(x for _, x in s) == (" " + text).encode() for s in sides) else ([], [])

    return run


def brute_alignment(rows, plainly):
    per, held = [], Counter()
    for doc_id, text in rows:
        a, b = plainly(text)
        spans = []
        for side in (a, b):
            at = np.cumsum([0] + [len(x) for _, x in side]).tolist()
            spans.append(list(zip(at, at[1:])))
        links, first = [], 0
        for (i, _), (start, end) in zip(a, spans[0]):
            while spans[1][first][1] <= start:
                first += 1
            k = first
            while k < len(b) and spans[1][k][0] < end:
                links.append((i, b[k][0]))
                k += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = []
        for low, high in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(i) for (i, _), (s, e) in zip(side, at) if low <= s and e <= high) for side, at in zip((a, b), spans)))
        held.update(set(links))
        per.append((doc_id, len(a), len(b), links, groups))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return sorted([(d, n_a, n_b, len(g), len(ls), sum(held[p] == best[p[0]] for p in ls), sum(held[p] for p in ls),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, n_a, n_b, ls, g in per], key=repr)


def test_parts_have_the_ids_of_whole_texts(plainly):
    pair = align.pair_of(align.byte_bpe(), align.piece_bpe())
    rng = random.Random(1)
    signs = "abcXYZ 019.,!?'\"\n\téÈßñ½ªſK\xa0 \x1c\x85日́<|>-_sStTdD  \n▁ "
    texts = [None, "", "<|endoftext|>x", "<s>a</s> <unk><0x41>", "  a", " ", "   ", "a ", "a  ", "\n  b", "a\n  b", "a\xa0  b", "\t \t  x", "x" * 3000,
             "a▁b", *("".join(rng.choices(signs[: rng.randint(12, len(signs))], k=rng.randint(1, 60))) for _ in range(3000))]
    for kept in (500_000, 50):  # with room for all parts, and emptied all the time
        align.CACHED, before = kept, align.CACHED
        found = pair.ids(texts) if kept > 50 else [pair.ids([t])[0] for t in texts]
        align.CACHED = before
        for text, sides in zip(texts, found):
            assert [np.frombuffer(s, "u4").tolist() for s in sides] == [[i for i, _ in s] for s in plainly(text)], text


@pytest.mark.parametrize("block_bytes", [align.BLOCK_BYTES, 30_000])
def test_alignment_equals_brute_force(spark, docs, plainly, block_bytes):
    some = docs.select("doc_id", "text").filter("length(text) < 4000")
    rows = [(r.doc_id, r.text) for r in some.collect()]
    assert sorted(map(tuple, align.link_statistics(some, block_bytes=block_bytes).collect()), key=repr) == brute_alignment(rows, plainly)


def test_long_texts_are_cut_into_lanes(plainly):
    pair = align.pair_of(align.byte_bpe(), align.piece_bpe())
    texts = ["", "word and word " * 4000, "x", "ab" * 9000]
    block = align.Block(pair, pair.ids(texts))
    for i, text in enumerate(texts):
        ends = [np.cumsum([len(x) for _, x in side]) for side in plainly(text)]
        shared = len(np.intersect1d(*ends)) if text else 0
        assert block.sizes()["n_groups"][i] == shared and block.sizes()["n_links"][i] == sum(map(len, ends)) - shared


def test_alignment_of_odd_tables(spark, plainly):
    table = odd(spark)
    rows = [(r.doc_id, r.text if len(r.text or "") < 9000 else None) for r in table.collect()]
    found = sorted(map(tuple, align.link_statistics(table).filter("n_a < 9000").collect()), key=repr)
    assert [r[:5] for r in found] == [r[:5] for r in brute_alignment([r for r in rows if r[0] not in (5, 6)], plainly)]
    assert align.link_statistics(empty(spark)).count() == 0 and align.align_documents(empty(spark)).count() == 0
    for r in align.align_documents(table.filter("doc_id = 1")).collect():
        assert len(r.links) == len(r.a_ids) + len(r.b_ids) - len(r.cuts)
        assert r.links[-1].a == len(r.a_ids) - 1 and r.links[-1].b == len(r.b_ids) - 1 and r.cuts[-1] == len(r.links) - 1


# --- periodic runs -------------------------------------------------------------

def brute_runs(words, least_words=6, least_times=4):
    found = {}
    for q in range(1, len(words) // least_times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least_words, least_times * q):
                found.setdefault((start, i - start + q), q)  # the smallest period comes first
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(1, 12)):
            signs = [b"%d" % i for i in range(rng.choice([1, 2, 2, 3, 5, 50]))]
            words = rng.choices(signs, k=rng.randint(0, 60))
            for _ in range(rng.randint(0, 3) if words else 0):
                p, at = rng.randint(1, min(9, len(words))), rng.randrange(len(words))
                words[at:at] = (words[at : at + p] * rng.randint(2, 9))[: rng.randint(1, 60)]
            texts.append(words)
        least = rng.choice([(6, 4), (6, 4), (2, 2), (5, 3)])
        assert periodic.runs_of_texts(texts, *least) == [brute_runs(w, *least) for w in texts]
    assert periodic.runs_of_texts([[b"a"] * 100_000, [b"a", b"b", b"c"] * 30_000]) == [[(0, 100_000, 1)], [(0, 90_000, 3)]]


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_run_digest(doc_id, text):
    words = planted(doc_id, text)
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None,) * 3
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_run_digest_of_odd_tables(spark, docs):
    def digest(table):
        return sorted(map(tuple, periodic.run_digest(periodic.find_runs(periodic.with_planted_runs(table), group_words=500)).collect()), key=repr)

    more = spark.createDataFrame([(i, ("a b c " * (i % 9) + "x y ") * (i % 5)) for i in range(300)], "doc_id long, text string")
    for table in (more, odd(spark).filter("text is null or length(text) < 9000"), docs.filter("length(text) < 3000").select("doc_id", "text")):
        assert digest(table) == sorted((brute_run_digest(r.doc_id, r.text) for r in table.collect()), key=repr)
    assert digest(empty(spark)) == [] and [r[2:5] for r in digest(odd(spark)) if r[0] == 5] == [(0, 100_000, 5)]


# --- mixing --------------------------------------------------------------------

def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        left = sum(weight[s] for s in names if s not in capped)
        level = (total - sum(most * sizes[s] for s in capped)) / left if left else 0
        above = {s for s in names if s not in capped and weight[s] * level > most * sizes[s]}
        if not above:
            return {s: float(most * sizes[s]) if s in capped else weight[s] * level for s in names}
        capped |= above


def test_mix_meets_its_targets(spark, docs):
    rng = random.Random(5)
    uneven = spark.createDataFrame([(i if i % 7 else None, " ".join(["w"] * rng.randint(0, 30)) if i % 11 else None,
                                     rng.choice(["é", "z", "", None, "a", "b", "big", "big", "big", "big"]), 1) for i in range(700)],
                                   "doc_id long, text string, source string, size int")
    copies = spark.createDataFrame([(1, "a b c", "s")] * 400 + [(2, "a b c d", "t")] * 10, "doc_id long, text string, source string")
    for table in (docs, uneven, copies):
        rows = mixing.mix(table).collect()
        sizes = Counter()
        for r in table.collect():
            sizes[r.source] += len((r.text or "").encode().split())
        wanted, taken = brute_targets(sizes), Counter()
        for r in rows:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source], rel=1e-12) and 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
        assert {s: taken[s] for s in sizes} == {s: int(t) for s, t in wanted.items()}
        assert len(rows) == table.count() and sum(sizes.values()) == sum(r.size for r in rows)
        again = mixing.mix(table.repartition(5)).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, again))
        words = Counter()
        for r in mixing.mixture(table).collect():
            assert len(r.text.encode().split()) == r.words and r.epoch in (1, 2)
            words[r.source] += r.words
        assert words == +taken


def test_mix_of_odd_tables(spark):
    table = odd(spark).withColumnRenamed("word", "source")
    rows = mixing.mix(table).collect()
    assert len(rows) == 11 and sum(r.taken for r in rows) == int(1.5 * rows[0].source_size) and rows[0].target == 1.5 * rows[0].source_size
    assert mixing.mix(empty(spark).withColumnRenamed("word", "source")).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mixture(blank).count() == 0


def test_mixing_runs_without_python(spark):
    plan = queries.op13_source_mixing(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
