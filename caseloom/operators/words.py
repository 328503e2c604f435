"""Words of whole batches of texts, found and numbered in a few array operations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.text import WORD
from caseloom.session import small_table

# Bytes of text that are worked on at a time; one longer text is taken alone.
SLICE_BYTES = 1 << 22
CODE_POINTS = 0x110000
# Four bytes of UTF-8 hold so many values.
ALL_CODES = 1 << 21
# Slots of the table that tells which pairs may be known.
SEEN_BITS = 20


def word_characters(spark: SparkSession) -> np.ndarray:
    """Bits, packed: which code points are word characters to the JVM's patterns."""
    every = "".join(map(chr, (*range(1, 0xD800), *range(0xE000, CODE_POINTS))))
    kept = small_table(spark, [(every,)], "t string").select(F.regexp_replace("t", f"[^{WORD[1:]}", "")).head()[0]
    bits = np.zeros(ALL_CODES, bool)
    bits[np.frombuffer(kept.encode("utf-32-le"), np.uint32)] = True
    return np.packbits(bits)


def lowered(text: str) -> Column:
    """What :class:`Splitter` takes: lower case as the JVM makes it; null counts as empty."""
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in turn, about ``SLICE_BYTES`` at a time."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first, done = 0, 0
    while first < len(texts):
        last = max(int(np.searchsorted(ends, done + SLICE_BYTES, "right")), first + 1)
        yield texts.slice(first, last - first)
        first, done = last, ends[last - 1]


class Splitter:
    """Finds the runs of at least two word characters, as ``word_tokens`` does, in texts of lower case."""

    def __init__(self, characters: np.ndarray):
        self.is_word = np.unpackbits(characters).astype(bool)
        self.byte_is_word = np.zeros(256, bool)
        self.byte_is_word[:128] = self.is_word[:128]
        # Bytes of the character that a byte begins, and its bits of the code point.
        self.width = np.ones(256, np.int64)
        self.bits = np.zeros(256, np.int64)
        for low, high, width in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0xF8, 4)):
            self.width[low:high] = width
            self.bits[low:high] = np.arange(high - low)

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, one after the other, and their number in each text."""
        texts = texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        edges = offsets.astype(np.int64) - offsets[0]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        if not len(data):
            return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
        word = self.byte_is_word[data]
        wide = np.flatnonzero(data >= 0xC0)
        if len(wide):
            code, width = self.bits[data[wide]], self.width[data[wide]]
            for k in range(1, 4):
                more = np.flatnonzero(width > k)
                code[more] = code[more] << 6 | data[wide[more] + k] & 0x3F
            hit = self.is_word[code]
            for k in range(4):
                word[wide[hit & (width > k)] + k] = True
        before, after = np.zeros_like(word), np.zeros_like(word)
        before[1:], after[:-1] = word[:-1], word[1:]
        # No word goes on in the next text.
        before[edges[edges < len(data)]] = False
        after[edges[edges > 0] - 1] = False
        starts = np.flatnonzero(word & ~before)
        sizes = np.flatnonzero(word & ~after) + 1 - starts
        single = sizes == self.width[data[starts]]
        for k in range(4):
            word[starts[single & (sizes > k)] + k] = False
        starts, sizes = starts[~single], sizes[~single]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(data[word]))
        return words, np.diff(np.searchsorted(starts, edges))


def runs_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def counted(docs: np.ndarray, codes: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc, code, number`` of the distinct pairs, in order."""
    keys = np.sort(docs * n_codes + codes)
    starts = runs_of(keys)
    return keys[starts] // n_codes, keys[starts] % n_codes, np.diff(starts, append=len(keys))


def added_up(codes: np.ndarray, *numbers: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct codes in order, and the sums of their numbers."""
    order = np.argsort(codes, kind="stable")
    starts = runs_of(codes[order])
    return codes[order[starts]], *(np.add.reduceat(n[order], starts) if len(starts) else n[:0] for n in numbers)


def word_codes(words: pa.Array, known: pa.Array) -> np.ndarray:
    """The place of each word in ``known``, or -1."""
    places = pc.fill_null(pc.index_in(words, value_set=known), -1)
    return places.to_numpy(zero_copy_only=False).astype(np.int64)


def neighbours(codes: np.ndarray, docs: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """``doc, code`` of the pairs of neighbours in a text that both have a place; a pair's code is ``first * n_words + second``."""
    some = np.flatnonzero((docs[1:] == docs[:-1]) & (codes[1:] >= 0) & (codes[:-1] >= 0))
    return docs[some], codes[some] * n_words + codes[some + 1]


def slots(codes: np.ndarray, bits: int) -> np.ndarray:
    """A hash of each code below ``2 ** bits``."""
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Vocabulary:
    """Known words and pairs of words, each with the index of its term."""

    words: pa.Array  # the known words and the words of known pairs
    word_index: np.ndarray  # of each word, -1 for one that only pairs have
    pairs: np.ndarray  # the codes of the pairs, in order
    pair_index: np.ndarray
    idf: np.ndarray  # by index
    characters: np.ndarray

    @classmethod
    def of(cls, terms: list[str], indices: list[int], idf: list[float], characters: np.ndarray) -> Vocabulary:
        """A term with a blank is a pair."""
        parts = [t.split(" ") for t in terms]
        place = {w: i for i, w in enumerate(sorted({w for p in parts for w in p}))}
        word_index = np.full(len(place), -1)
        by_index, pairs = np.zeros(max(indices, default=-1) + 1), {}
        for p, i, weight in zip(parts, indices, idf):
            by_index[i] = weight
            if len(p) == 1:
                word_index[place[p[0]]] = i
            else:
                pairs[place[p[0]] * len(place) + place[p[1]]] = i
        codes = np.array(sorted(pairs), np.int64)
        index = np.array([pairs[c] for c in codes.tolist()], np.int64)
        return cls(pa.array(list(place), pa.string()), word_index, codes, index, by_index, characters)


class Lookup:
    """Counts the known terms of texts; made in a task."""

    def __init__(self, vocabulary: Vocabulary):
        self.known, self.split = vocabulary, Splitter(vocabulary.characters)
        self.maybe = np.zeros(1 << SEEN_BITS, bool)
        self.maybe[slots(vocabulary.pairs, SEEN_BITS)] = True

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``indices, counts`` of all texts, in the order of indices in each, and the number of terms in each text."""
        found = [self._count(part) for part in slices(texts)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def _count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, lengths = self.split(texts)
        codes = word_codes(words, self.known.words)
        docs = np.repeat(np.arange(len(lengths)), lengths)
        pair_docs, pairs = neighbours(codes, docs, len(self.known.words))
        maybe = np.flatnonzero(self.maybe[slots(pairs, SEEN_BITS)])
        pair_docs, pairs = pair_docs[maybe], pairs[maybe]
        place = np.searchsorted(self.known.pairs, pairs)
        same = np.flatnonzero(self.known.pairs[np.minimum(place, len(self.known.pairs) - 1)] == pairs) if len(pairs) else place
        some = np.flatnonzero(codes >= 0)
        single = self.known.word_index[codes[some]]
        some, single = some[single >= 0], single[single >= 0]
        all_docs = np.concatenate([docs[some], pair_docs[same]])
        terms = np.concatenate([single, self.known.pair_index[place[same]]])
        doc, index, count = counted(all_docs, terms, max(len(self.known.idf), 1))
        return index, count, np.bincount(doc, minlength=len(lengths))
