"""Encoding by a public tokenizer's file inside tasks, with a cache of words.

For tokenizers that drop white space before the merges, the pieces of a text
between ASCII blanks are encoded independently of each other, so the ids of a
text are the ids of its pieces in a row. Natural text repeats its pieces: only
new ones go to the library.
"""

from __future__ import annotations

import functools
import importlib
import os
import re

import numpy as np

CACHE_PIECES = 600_000
#: Runs of Latin-1 lower-case letters, and of other characters that are not blanks.
RUNS = re.compile("[a-zªµºß-öø-ÿ]+|[^ \t\n\ra-zªµºß-öø-ÿ]+")
_TO_SPACE = str.maketrans("\t\n\r", "   ")


def vocabulary_path(name: str) -> str:
    """Where the public tokenizer file lies on this machine; a path that exists is taken as it is."""
    return name if os.path.exists(name) else importlib.import_module("public_tokenizers").path(name)


@functools.lru_cache(maxsize=4)
def encoder(name: str) -> WordEncoder:
    """One encoder per Python worker and file: its cache outlives a task."""
    return WordEncoder(name)


class WordEncoder:
    def __init__(self, name: str, cache_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache_pieces = cache_pieces
        self.known: dict[str, bytes] = {"": b""}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        ends = [i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if suffix and t.endswith(suffix)]
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.ends_word[ends] = True
        self.marks_ends = bool(ends)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.splits_runs = self._splits_runs()

    def _splits_runs(self) -> bool:
        """Asked of the tokenizer itself: are the ids of a Latin-1 text without an apostrophe those of its lower-cased runs of
        letters and of other characters? Tried on every pair of neighbours of one character per kind."""
        kinds = [*map(chr, [*range(33, 39), *range(40, 127), *range(161, 256)])]
        some = "aZ5,.-é×²ªµß¿!"
        probe = " ".join(f"{x}{y}{x}" for x in kinds for y in some) + " " + " ".join("b" + x + y + "q" for x in some for y in some)
        runs = RUNS.findall(probe.lower())
        if len("".join(runs)) != len(probe.replace(" ", "")):
            return False
        whole = self.tokenizer.encode(probe, add_special_tokens=False).ids
        return whole == [i for e in self.tokenizer.encode_batch(runs, add_special_tokens=False) for i in e.ids]

    @staticmethod
    def pieces(text: str) -> list[str]:
        return text.translate(_TO_SPACE).split(" ") if ("\t" in text or "\r" in text) else text.replace("\n", " ").split(" ")

    def learn(self, pieces: set[str]) -> None:
        """Encodes what the cache lacks. A full cache keeps its short pieces, the frequent ones, or starts anew."""
        if len(self.known) + len(pieces) > self.cache_pieces:
            short = {p: i for p, i in self.known.items() if len(p) < 6}
            self.known = short if 2 * len(short) < self.cache_pieces else {"": b""}
        new = [p for p in pieces if p not in self.known]
        plain = [p for p in new if p.isalpha()] if self.marks_ends else []
        for at in range(0, len(plain), 2000):
            self._learn_words(plain[at : at + 2000])
        self._learn_each([p for p in new if p not in self.known])

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        split = []
        for t in texts:
            if self.splits_runs and "'" not in t and _latin(t) and not any(a in t for a in self.added):
                split.append(RUNS.findall(t.lower()))
            else:
                split.append(self.pieces(t))
        get = self.known.get
        found = [[get(p) for p in s] for s in split]
        missing = {p for s, f in zip(split, found, strict=True) if None in f for p, i in zip(s, f, strict=True) if i is None}
        if not missing:
            return [b"".join(f) for f in found]
        # learning may empty the cache, so what was found stays in hand and only the gaps are filled
        self.learn(missing)
        known = self.known
        return [b"".join([known[p] if i is None else i for p, i in zip(s, f, strict=True)] if None in f else f) for s, f in zip(split, found, strict=True)]

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters in one go. One word-end per word proves that each word is one run for the tokenizer."""
        ids = np.asarray(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype="<u4")
        ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
        if len(ends) == len(words):
            raw, start = ids.tobytes(), 0
            for w, end in zip(words, ends.tolist(), strict=True):
                self.known[w] = raw[start:end]
                start = end

    def _learn_each(self, pieces: list[str]) -> None:
        for at in range(0, len(pieces), 20_000):
            some = pieces[at : at + 20_000]
            for piece, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[piece] = np.asarray(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[list[bytes]]:
        """Per text the ids of its pieces, as little-endian 32-bit numbers; b"".join gives those of the text."""
        split = [self.pieces(t) for t in texts]
        self.learn({p for s in split for p in s})
        return [[self.known[p] for p in s] for s in split]

    def encode_whole(self, text: str) -> bytes:
        """The library's own ids of a text, without the cache."""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()


def _latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def batches(lengths: list[int], most: int = 4_000_000, rows: int = 500):
    """Ranges of neighbouring rows with at most `most` characters together, one row at least."""
    start = 0
    while start < len(lengths):
        end, total = start, 0
        while end < len(lengths) and end - start < rows and (end == start or total + lengths[end] <= most):
            total += lengths[end]
            end += 1
        yield start, end
        start = end


def slices(rows, text: str, most: int = 4_000_000, at_most: int = 500):
    """Record batches cut so that a slice holds at most `most` bytes of text, one row at least: only a slice at a time
    becomes Python objects."""
    import pyarrow.compute as pc

    for batch in rows:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        for a, b in batches(lengths, most, at_most):
            yield batch.slice(a, b - a)
