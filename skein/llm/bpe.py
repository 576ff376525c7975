"""The word-level byte-pair vocabulary: its file, and the words of a text.

A file names pairs in rank order, the ids of symbols, and special strings that
are ids of their own wherever they stand in a text.  Text is put into NFC,
white space folded, lower-cased code point by code point, and cut into words
by one pattern; a word's UTF-8 bytes are its first symbols, of which the last
carries the end-of-word mark.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np

WORD = "word_bpe_49k.json"
END = "</w>"
#: Letters up to here are alike in every Unicode version; texts beyond are
#: normalised and cut by the library's own components.
BEYOND = re.compile(r"[^\x00-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e]")
SPACE = "\\t-\\r \\x85\\xa0"


def _category(first: str) -> str:
    """The code points below U+0180 of a general category, as a class."""
    return "".join(re.escape(chr(i)) for i in range(0x180) if unicodedata.category(chr(i))[0] == first)


LETTERS, NUMBERS = _category("L"), _category("N")


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(WORD)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the
    next free code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Vocabulary:
    """Ids of bytes, sorted pair keys with rank and product, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.size = max(self.tokens) + 1
        sym = byte_symbols()
        self.inner = np.array([ids[s] for s in sym], np.int64)
        self.last = np.array([ids[s + END] for s in sym], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.pairs = {(int(a), int(b)): (r, int(m)) for r, (a, b, m) in enumerate(zip(left, right, made))}
        # A symbol is made before any pair that holds it, so all places of the
        # lowest pair of a word can merge in one round.
        first = np.full(self.size, -1, np.int64)
        first[made[::-1]] = np.arange(len(made))[::-1]
        dup = len(set(made.tolist())) != len(made)
        self.in_order = not dup and bool((np.maximum(first[left], first[right]) < np.arange(len(made))).all())
        self._cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+")
        self._path = path

    @functools.cached_property
    def by_rank(self) -> list[tuple[int, int, int]]:
        """(left, right, made) of each rank."""
        order = np.argsort(self.rank)
        keys = self.keys[order]
        return list(zip((keys // self.size).tolist(), (keys % self.size).tolist(), self.made[order].tolist()))

    @functools.cached_property
    def _library(self):
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(self._path)
        back = {c: b for b, c in enumerate(byte_symbols())}
        return t.normalizer, t.pre_tokenizer, back

    def words(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        if not text.isascii() and BEYOND.search(text):
            norm, pre, back = self._library
            return [bytes(back[c] for c in w).decode() for w, _ in pre.pre_tokenize_str(norm.normalize_str(text))]
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return self._words.findall(text.lower())

    def pieces(self, text: str):
        """(words, special id or None) in order."""
        if self._cut is None or "<|" not in text:
            yield self.words(text), None
            return
        for part in self._cut.split(text):
            if part in self.special:
                yield [], self.special[part]
            elif part:
                yield self.words(part), None


@functools.lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)
