"""Exact token counts of every prefix, for byte-pair encodings of the sentencepiece library.

The encoding of a prefix ends in one token, and what stands before it is the encoding of a
shorter prefix. So the counts follow from left to right: of the pieces that end at a position,
exactly one is the last token, namely the one that the last token of the shorter prefix does not
merge with or break up; the count is that of the shorter prefix plus one. Questions about
truncation and budgets are then look-ups in the counts and need no encoding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import slices

SPACE = "▁"
# A task remembers the counts of so many chunks and pairs, then forgets them and starts anew.
REMEMBERED = 400_000
# Characters that often end a word.
TAIL = ".,;:!?&#*%$|"


class PrefixCounter:
    """Counts for the prefixes of chunks, which no token of the model crosses."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces: dict[str, tuple[int, float]] = {}
        for i in range(model.vocab_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.pieces[model.id_to_piece(i)] = (i, model.get_score(i))
        self.bytes = any(model.is_byte(i) for i in range(model.vocab_size()))
        self.names = {i: piece for piece, (i, _) in self.pieces.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, (i, _) in self.pieces.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        crosses = any(SPACE in piece.lstrip(SPACE) for piece in self.pieces)
        line = any("\n" in piece for piece in self.pieces if len(piece) > 1)
        if crosses:
            self.chunks = re.compile(r"(?s).+")
        elif line:
            self.chunks = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        else:
            self.chunks = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        self.letters = {piece for piece in self.pieces if len(piece) == 1}
        self.pairs = {piece[k : k + 2] for piece in self.pieces for k in range(len(piece) - 1)}
        self.counts: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}
        self.stable: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text: always merge the pair of the best score, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = self.pieces.get(parts[k] + parts[k + 1])
                if found is not None and (best is None or found[1] > best):
                    best, at = found[1], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` can stand after ``last``; a negative id is a character without a piece."""
        if token not in self.stable:
            self.stable[token] = len(self.merged(self.names[token])) == 1
        if not self.stable[token]:
            return False
        if last < 0:
            return True
        left, right = self.names[last], self.names[token]
        return self.merged(left + right) == [left, right]

    def learn(self, chunks: set[str]) -> None:
        """Work out the counts of new ``chunks``.

        A tail of punctuation is taken off where no piece holds the two characters at the cut.
        In sorted order a chunk goes on from the state of the one before, up to their common prefix.
        """
        cut, known = {}, self.counts
        for chunk in chunks:
            stem = chunk.rstrip(TAIL)
            if len(stem) < len(chunk) and stem and chunk[len(stem) - 1 : len(stem) + 1] not in self.pairs:
                cut[chunk] = (stem, chunk[len(stem) :])
        parts = (chunks - cut.keys()).union(*cut.values()) - known.keys()
        previous, counts, last = "", [0], [-1]
        for part in sorted(parts):
            same, most = 0, min(len(part), len(previous))
            while same < most and part[same] == previous[same]:
                same += 1
            counts[same + 1 :], last[same + 1 :] = [0] * (len(part) - same), [-1] * (len(part) - same)
            self.fill(part, same, counts, last)
            previous = part
            known[part] = packed(counts[1:])
        for chunk, (stem, tail) in cut.items():
            left, right = known[stem], known[tail]
            if len(left) == len(stem) and len(right) == len(tail) and left[-1] + right[-1] < 256:
                known[chunk] = left + bytes([n + left[-1] for n in right])
            else:
                left, right = unpacked(left, stem), unpacked(right, tail)
                known[chunk] = packed([*left.tolist(), *(right + left[-1]).tolist()])

    def fill(self, text: str, done: int, counts: list[int], last: list[int]) -> None:
        """Extend ``counts`` and ``last`` (token) from the first ``done`` characters to all."""
        fits, plain = self.fits, self.letters.issuperset(text)
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if counts[end]:
                continue
            start = end - length
            if not plain:
                self.skip(text, start, counts)
            key = (last[start] << 24) + token
            ok = fits.get(key)
            if ok is None:
                ok = fits[key] = self.follows(last[start], token)
            if ok:
                counts[end], last[end] = counts[start] + 1, token
        if not plain:
            self.skip(text, len(text), counts)

    def skip(self, text: str, end: int, counts: list[int]) -> None:
        """Fill ``counts`` up to ``end``, where characters without a piece were left out."""
        first = end
        while first and not counts[first]:
            first -= 1
        for k in range(first, end):
            counts[k + 1] = counts[k] + (len(text[k].encode("utf-8", "surrogatepass")) if self.bytes else 1)

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the token counts of its prefixes of 1, 2, ... characters."""
        known = self.counts
        if len(known) > REMEMBERED:
            known.clear()
        if len(self.fits) > REMEMBERED:
            self.fits.clear()
        cut = [self.chunks.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        self.learn(set().union(*cut).difference(known))
        return [self.joined(chunks) for chunks in cut]

    def joined(self, chunks: list[str]) -> np.ndarray:
        if not chunks:
            return np.zeros(0, np.int32)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(lengths)
        within = np.frombuffer(b"".join(map(self.counts.__getitem__, chunks)), np.uint8)
        if len(within) != ends[-1]:
            within = np.concatenate([unpacked(self.counts[c], c) for c in chunks])
        totals = within[ends - 1].astype(np.int32)
        before = np.cumsum(totals, dtype=np.int32) - totals
        return (within + np.repeat(before, lengths))[1:]


def packed(counts: list[int]) -> bytes:
    """A byte each, or four if a count does not fit; the length shows which."""
    return bytes(counts) if max(counts) < 256 else np.array(counts, np.int32).tobytes()


def unpacked(counts: bytes, chunk: str) -> np.ndarray:
    return np.frombuffer(counts, np.uint8 if len(counts) == len(chunk) else np.int32).astype(np.int32)


def prefix_counts(df: DataFrame, model_file: str, keep: list[str], text: str = "text", arrays: bool = True) -> DataFrame:
    """The columns ``keep`` with ``n_tokens`` and, if ``arrays``, ``prefix_tokens``.

    ``prefix_tokens[k]`` is the exact number of tokens of the first k + 1 characters, without
    begin and end tokens. Null and empty texts have none. Rows repeat as they do in the input.
    """
    fields = [f for f in df.select(*keep).schema]
    source = df.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_tokens bigint"])
    if arrays:
        schema += ", prefix_tokens array<int>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(model_file)
        for batch in batches:
            for part in slices(batch, "_text"):
                counted = counter.texts([t or "" for t in part.column("_text").to_pylist()])
                columns = [part.column(f.name) for f in fields]
                columns.append(pa.array([int(c[-1]) if len(c) else 0 for c in counted], pa.int64()))
                names = [f.name for f in fields] + ["n_tokens"]
                if arrays:
                    ends = np.cumsum([0] + [len(c) for c in counted])
                    flat = np.concatenate(counted) if counted else np.zeros(0, np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
                    names.append("prefix_tokens")
                yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(count, schema)


def tokens_at(prefix_tokens: str, characters: Column | int) -> Column:
    """Tokens of the first ``characters`` characters (the whole text if it is shorter)."""
    n = F.least(F.lit(characters) if isinstance(characters, int) else characters, F.size(prefix_tokens))
    return F.when(n <= 0, F.lit(0)).otherwise(F.get(prefix_tokens, n - 1))


def longest_prefix(prefix_tokens: str, budget: int) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens.

    Counts are not monotone: a longer prefix can have fewer tokens than a shorter one.
    """
    fitting = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i + 1).otherwise(F.lit(0)))
    return F.coalesce(F.array_max(fitting), F.lit(0))
