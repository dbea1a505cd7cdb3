"""Token ids of whole documents, for the packing operators.

The tokenizer splits at white space and never merges across it, so the ids of a text are those of its words in a row.
Each Python worker keeps the ids of the words it has met, up to a bound, and hands only new words to the tokenizer. Arrow
splits the texts of a batch and tells their distinct words, and only these are looked up.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END = 2
VOCABULARY = "word_bpe_49k.json"
#: Bytes of text that are split at once.
PART = 1 << 21


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Lower-case letters that no normalisation changes, then ASCII punctuation: two runs that the tokenizer's own split also makes.
PLAIN = re.compile(r"([a-z\xdf-\xf6\xf8-\xff]+)([!-/:-@\[-`{-~]*)").fullmatch


def byte_alphabet() -> dict[int, int]:
    """The printable stand-in for each byte that byte-level vocabularies use: itself, or the next free code point."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class _Places(dict):
    """Numbers words as they are met."""

    def __init__(self, new: list):
        super().__init__()
        self.new = new

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        place = self[word] = len(self)
        return place


class WordIds:
    """Ids by word. ``words`` bounds the memory: past it, the half met most often stays before the next texts.

    Meetings count half after that, so words that are no longer met give way. A word that ends in marks is kept beside its
    letters and its marks, which are words too.
    """

    def __init__(self, path: str, words: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), words
        self.tokenize = self.tokenizer.model.tokenize
        self.alphabet = byte_alphabet()
        self.new: list[bytes] = []
        self.place = _Places(self.new)
        self.starts, self.sizes, self.met = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.float32)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0

    def _trim(self) -> None:
        stay = np.sort(np.argsort(-self.met[: len(self.place)], kind="stable")[: self.limit // 2])
        chosen = np.zeros(len(self.place), bool)
        chosen[stay] = True
        words = list(compress(self.place, chosen.tolist()))
        self.place = _Places(self.new)
        self.place.update(zip(words, range(len(words)), strict=True))
        flat, sizes = self._ids(stay), self.sizes[stay]
        self.met[: len(stay)] = self.met[stay] / 2
        self.used = 0
        self._put(np.arange(len(stay)), sizes, flat)

    def _put(self, places: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        while len(self.flat) < self.used + len(flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.sizes[places] = sizes
        self.starts[places] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)

    def _ids(self, places: np.ndarray) -> np.ndarray:
        """Ids of the words at ``places`` in a row."""
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        if not len(ends):
            return np.zeros(0, np.uint32)
        return self.flat[np.repeat(self.starts[places] - ends + sizes, sizes) + np.arange(ends[-1])]

    def _learn(self) -> None:
        first = len(self.place) - len(self.new)
        letters, sizes, flat, marked, parts, other = [], [], [], [], [], []
        for at, word in enumerate(self.new, first):  # grows by the letters and marks of its own words
            text = word.decode("utf-8", "replace")
            plain = PLAIN(text)
            if not plain:
                other.append((at, text))
            elif marks := len(plain[2]):
                marked.append(at)
                parts += self.place[word[:-marks]], self.place[word[-marks:]]
            else:  # a run that the tokenizer does not split
                ids = [t.id for t in self.tokenize(text if text.isascii() else word.decode("latin-1").translate(self.alphabet))]
                letters.append(at)
                sizes.append(len(ids))
                flat += ids
        self.new.clear()
        while len(self.starts) < len(self.place):
            self.starts, self.sizes, self.met = (np.resize(x, 2 * len(x)) for x in (self.starts, self.sizes, self.met))
        self.met[first : len(self.place)] = 0
        self._put(np.array(letters, np.int64), np.array(sizes, np.int64), np.array(flat, np.uint32))
        for k in range(0, len(other), 4096):
            places, texts = zip(*other[k : k + 4096], strict=True)
            said = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
            self._put(np.array(places), np.bincount(np.array(said.word_ids, np.int64), minlength=len(texts)), np.array(said.ids, np.uint32))
        if marked:
            both = np.array(parts)
            self.met[both] += 1
            self._put(np.array(marked), self.sizes[both].reshape(-1, 2).sum(1), self._ids(both))

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, for a short array of texts without nulls."""
        if len(self.place) > self.limit:
            self._trim()
        texts = texts.view(pa.string())  # not checked to be UTF-8: all that follows takes bytes
        special = pc.match_substring(texts, "<|")  # there may be a special token, whose case counts
        split = pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)))  # empty words have no ids
        coded = split.flatten().dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary.view(pa.binary())
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b"\n")
        at = np.fromiter(map(self.place.__getitem__, joined[0].as_py().split(b"\n")), np.int64, len(words))
        if self.new:
            self._learn()
        self.met[at] += np.bincount(index, minlength=len(at))
        ids = self._ids(at[index])
        ends = np.r_[0, np.cumsum(self.sizes[at][index])][np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy())]]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield ids[a:b]


_encoders: dict[str, WordIds] = {}


def batch_ids(texts: pa.Array, path: str, part: int = PART) -> Iterator[np.ndarray]:
    """Ids of each binary text and the end id; the cache lives as long as the worker.

    Texts are taken in parts of about ``part`` bytes, or one by one if they are longer.
    """
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + part, side="right")))
        for ids in _encoders[path](texts.slice(at, to - at)):
            yield np.append(ids, np.uint32(END))
        at = to


def document_ids(text: bytes, path: str) -> np.ndarray:
    """Ids of one text and the end id."""
    return next(batch_ids(pa.array([text], pa.binary()), path))
