"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SHINGLE = 5
#: Bytes of text worked on at once, unless one text is longer.
CHUNK_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BACK)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


@dataclass
class Shingled:
    """Of some texts: hashes and counts of the different shingles, and which text they are of; two hashes and the number of words."""

    shingle: np.ndarray
    count: np.ndarray
    text: np.ndarray
    first_key: np.ndarray
    second_key: np.ndarray
    words: np.ndarray


def _shingled(texts: list[bytes], size: int) -> Shingled:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    up, down = _grow(len(data) + 1)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    low = _LOWER[data]
    inside = ~_SPACE[data]
    step = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    word = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    text = np.searchsorted(np.cumsum(lengths), starts, side="right")
    n_words = np.bincount(text, minlength=len(texts))
    ends = np.cumsum(n_words)
    begins = ends - n_words
    n = len(word)
    at = np.arange(n)
    hashed = np.zeros(n, np.uint64)
    for j in range(size):
        there = np.zeros(n, np.uint64)
        there[: n - j] = word[j:]
        there[at + j >= ends[text]] = 0
        hashed = hashed * np.uint64(0xD6E8FEB86659FD93) + there
    hashed = mix(hashed)
    valid = (at + size <= ends[text]) | ((at == begins[text]) & (n_words[text] < size))
    place = up[at - begins[text]]
    keys = []
    for words in (word, mix(word + np.uint64(1))):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * place)])
        keys.append(total[ends] - total[begins])
    hashed, owner = hashed[valid], text[valid]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    found = [np.unique(hashed[a:b], return_counts=True) for a, b in zip(cuts, cuts[1:])]
    sizes = np.fromiter((len(u) for u, _ in found), np.int64, len(found))
    return Shingled(np.concatenate([u for u, _ in found]), np.concatenate([c for _, c in found]),
                    np.repeat(np.arange(len(texts)), sizes), *keys, n_words)


def shingled(texts: list[str], size: int = SHINGLE, chunk: int = CHUNK_BYTES):
    """(number of the first text, Shingled) for runs of texts.

    Words are parted by the blanks of ASCII, A-Z in lower case; a text with
    fewer words than ``size`` has one shingle of all its words, one without
    words has none.
    """
    held: list[bytes] = []
    first = filled = 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "replace")
        if held and filled + len(data) > chunk:
            yield first, _shingled(held, size)
            held, first, filled = [], i, 0
        held.append(data)
        filled += len(data)
    if held:
        yield first, _shingled(held, size)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller counts over sum of the larger ones; (sorted shingles, counts) each.  Two empty ones are equal."""
    (x, n), (y, m) = a, b
    all_n, all_m = int(n.sum()), int(m.sum())
    if not all_n and not all_m:
        return 1.0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = y[at] == x if len(y) else np.zeros(len(x), bool)
    shared = int(np.minimum(n[same], m[at[same]]).sum())
    return shared / (all_n + all_m - shared)
