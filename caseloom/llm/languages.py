"""Language mixtures: expectation-maximisation over n-gram likelihoods.

For each language the share of every hashed letter trigram is counted over all learning texts.
The proportions of the languages in a text maximise the likelihood of its trigrams. The set of
languages is the one, among the sets of the 1, 2, ... largest, with the best penalised likelihood.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caseloom.llm.common import slices, tidy

# Trigrams are hashed into so many buckets, so a model has BUCKETS counts a language.
BUCKETS = 1 << 16
PIECE = 500_000
# Proportions are found when no language moves by more than this in a round.
TOLERANCE = 1e-3
SMOOTHING = 0.5
UNKNOWN = "und"


def folded_letters() -> np.ndarray:
    """For each code point the number of its lower-case letter, 0 for what is no letter."""
    table = np.zeros(sys.maxunicode + 1, np.int32)
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if char.isalpha():
            lower = char.lower()
            table[code] = ord(lower) if len(lower) == 1 else code
    return table


def trigrams(text: str, letters: np.ndarray) -> Iterator[np.ndarray]:
    """The trigram buckets of ``text``, piece by piece; runs of other characters count as one blank."""
    held = np.zeros(1, np.int32)
    for start in range(0, len(text), PIECE):
        codes = np.frombuffer(text[start : start + PIECE].encode("utf-32-le", "surrogatepass"), np.int32)
        codes = np.concatenate([held, letters[codes]])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = codes[keep]
        if start + PIECE >= len(text):
            codes = np.append(codes, 0) if codes[-1] else codes
        x = codes.astype(np.uint32)
        if len(x) > 2:
            mixed = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield (mixed >> np.uint32(16)).astype(np.int32)
        held = codes[-2:]


@dataclass
class LanguageModel:
    languages: list[str]
    counts: np.ndarray  # languages x BUCKETS

    def likelihoods(self) -> np.ndarray:
        """BUCKETS x languages."""
        smoothed = self.counts + SMOOTHING
        return np.ascontiguousarray((smoothed / smoothed.sum(axis=1, keepdims=True)).T)


def fit_languages(docs: DataFrame) -> LanguageModel:
    """Count the trigrams of all texts of ``docs`` (text, lang) by language; null rows are left out.

    Tasks return at most ``BUCKETS`` counts a language, and so does the driver get; so the model grows
    with the number of different values of lang, half a megabyte for each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(folded_letters())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, totals = shared.value, {}
        for batch in batches:
            for part in slices(batch, "text"):
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    own = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    for grams in trigrams(text, letters):
                        own += np.bincount(grams, minlength=BUCKETS)
        for lang, own in totals.items():
            found = np.nonzero(own)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int32()), pa.array(own[found], pa.int64())],
                ["lang", "bucket", "n"],
            )

    rows = (
        docs.where("text is not null and lang is not null").select("text", "lang")
        .mapInArrow(tidy(count), "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = rows.column("lang").to_pylist()
    languages = sorted(set(names))
    place = {lang: k for k, lang in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    counts[[place[n] for n in names], rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return LanguageModel(languages, counts)


def proportions(likely: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture proportions and log-likelihood of trigrams seen ``counts`` times.

    The likelihood rises in every round, so the proportions come to rest.
    """
    n, k = counts.sum(), likely.shape[1]
    shares = np.full(k, 1 / k)
    if k > 1:
        moved = 1.0
        while moved > TOLERANCE:
            mixed = likely * shares
            found = (counts / mixed.sum(axis=1)) @ mixed / n
            shares, moved = found, np.abs(found - shares).max()
    return shares, float(counts @ np.log(likely @ shares))


def mixture(likely: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The proportions of all languages, 0 for those outside the selected set."""
    k = likely.shape[1]
    order = np.argsort(-proportions(likely, counts)[0], kind="stable")
    # Every letter is in three trigrams, so the evidence is counted thrice: so is the penalty.
    penalty = 1.5 * np.log(counts.sum())
    best, chosen = -np.inf, np.zeros(k)
    for size in range(1, k + 1):
        shares, value = proportions(likely[:, order[:size]], counts)
        if size == 1:  # the single language of the best likelihood
            single = counts @ np.log(likely)
            top = int(np.argmax(single))
            order = np.concatenate([[top], order[order != top]])
            value = float(single[top])
        if value - penalty * size <= best:
            break
        best, chosen = value - penalty * size, np.zeros(k)
        chosen[order[:size]] = shares
    return chosen


def language_mixtures(docs: DataFrame, columns: list[str], model: LanguageModel) -> DataFrame:
    """``columns``, ``lang_pred``, ``score`` and ``mixture`` (language to proportion) for whole texts.

    The prediction is the language of the largest proportion, the score that proportion. A text
    that is null or has no letter, or any text if nothing could be learned, is ``und`` with score
    0 and an empty mixture. Rows repeat as in the input; an empty table gives an empty result.
    """
    fields = list(docs.select(*columns).schema)
    names = [f.name for f in fields] + ["lang_pred", "score", "mixture"]
    schema = StructType([*fields, *StructType.fromDDL("lang_pred string, score double, mixture map<string,double>")])
    languages = model.languages
    shared = docs.sparkSession.sparkContext.broadcast((folded_letters(), model.likelihoods()))

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, likely = shared.value
        for batch in batches:
            for part in slices(batch, "_text"):
                found = []
                for text in part.column("_text").to_pylist():
                    seen = np.zeros(0, np.int32), np.zeros(0)
                    if text and languages:
                        grams = list(trigrams(text, letters))
                        if len(grams) == 1:
                            seen = np.unique(grams[0], return_counts=True)
                        elif grams:
                            total = sum(np.bincount(g, minlength=BUCKETS) for g in grams)
                            seen = np.nonzero(total)[0], total[np.nonzero(total)[0]]
                    found.append(mixture(likely[seen[0]], seen[1].astype(float)) if len(seen[0]) else None)
                best = [int(np.argmax(m)) if m is not None else -1 for m in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(f.name) for f in fields]
                    + [
                        pa.array([languages[b] if b >= 0 else UNKNOWN for b in best], pa.string()),
                        pa.array([float(m[b]) if m is not None else 0.0 for m, b in zip(found, best)], pa.float64()),
                        pa.array(
                            [[(languages[k], float(m[k])) for k in np.nonzero(m)[0]] if m is not None else [] for m in found],
                            pa.map_(pa.string(), pa.float64()),
                        ),
                    ],
                    names,
                )

    return docs.select(*columns, F.col("text").alias("_text")).mapInArrow(tidy(infer), schema)
