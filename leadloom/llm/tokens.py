"""Texts to token ids with a public tokenizer file, words looked up in a bounded cache."""

from __future__ import annotations

import json
import re

import numpy as np
from tokenizers import Tokenizer

#: Words kept per worker, in two generations.
CACHED = 600_000
LONGEST = 64


def word_tokenizer() -> str:
    """The word tokenizer's file as it is installed (the operators take any file's path)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# in lower case, these characters need no normalising and are split by the rule below
_PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-ÿ]*")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


# the visible character that stands for each byte in a byte-level vocabulary
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = dict(zip([b for b in range(256) if b not in _SEEN], range(0x100, 0x200)))


class _Words(dict):
    """ids of words: a full generation replaces the one before, whose words come back when they are asked for."""

    def __init__(self, encode):
        self.encode, self.before = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(word) <= LONGEST:
            if len(self) >= CACHED // 2:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """ids of a text as little-endian unsigned 32-bit bytes, equal to the tokenizer's on the whole text.

    A tokenizer that drops white space and splits words by the rule above
    encodes each word on its own, so words are encoded once and looked up
    afterwards.  Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        about = json.loads(self.whole.to_str())
        steps = (about.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = (
            len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": _RULE}
            and steps[0].get("invert") is True and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space")
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in about["added_tokens"])
            and [n.get("type") for n in (about.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        )
        self.model = self.whole.model
        marks = sorted({t["content"][:2] for t in about["added_tokens"]})
        self.marks = re.compile("|".join(map(re.escape, marks)) or "(?!)")
        self.letters = not any(m.isalpha() for m in marks)
        self.words = _Words(self._word)

    def _plainly(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(_BYTES)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(part)])

    def _word(self, word: str) -> bytes:
        if self.letters and word.isascii() and word.isalpha():  # one part, and no mark
            return self._part(word.lower())
        if not _PLAIN.fullmatch(word) or self.marks.search(word):
            return self._plainly(word)
        parts = _PARTS.findall(word.lower())
        # a part is a word that has itself as its only part
        return self._part(parts[0]) if len(parts) == 1 else b"".join(map(self.words.__getitem__, parts))

    def forget(self) -> None:
        """Give back the memory of the words kept."""
        self.words.clear()
        self.words.before = {}

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._plainly(text)
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file; its cache outlives a task."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]
