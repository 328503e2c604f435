"""Benchmark decontamination by templates.

Numbers, units after numbers and names become typed placeholders. A capitalised word at the start
of a sentence or line is read both as a word and as a name. Windows of the resulting
templates are hash-joined between documents and benchmark items. The values in the placeholders of
a window must then map to each other one to one, which tells a question with other numbers or names
from a chance likeness.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import if_small, materialise, slices, tidy

WINDOW = 8
# Items with fewer tokens than this are matched only where they stand alone: from the start of a
# sentence or line to the end of one.
SHORTEST = 4
# At least this many tokens of a window must be literal words (of half of them, if it is shorter);
# others are compared by their tokens as they are.
LITERALS = 4
# Benchmark windows per pass over the documents: their hashes are sent to every task.
PASS_WINDOWS = 1_000_000
# A task remembers so many tokens, then starts anew.
REMEMBERED = 100_000
# Added to the hashes of windows without placeholders.
AS_IS = 0x5851F42D4C957F2D
# The odd factor of the window hashes.
POLYNOMIAL = 0xD6E8FEB86659FD93

LITERAL, NUMBER, UNIT, NAME, DROPPED = 0, 1, 2, 3, 4
PLACEHOLDERS = {NUMBER: "\0number", UNIT: "\0unit", NAME: "\0name"}
# Units that count as such after a number.
UNITS = frozenset(
    "km m cm mm mi ft in yd kg g mg lb lbs oz t l ml cl gal s sec secs min mins h hr hrs ms d day days"
    " week weeks month months year years hour hours minute minutes second seconds meter meters metre"
    " metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches gram grams"
    " kilogram kilograms pound pounds liter liters litre litres percent % ° °c °f $ € £ dollar dollars"
    " euro euros cent cents usd eur gbp mph kmh km/h k w kw v a hz j n pa".split()
)
MARKS = ".,;:!?\"'()[]{}<>|*#&$%€£…«»“”‘’–—-/\\`~^=+@_。，、．！？：；（）「」『』【】《》〈〉・"
CLOSING = "\"')]}»”’）」』】》〉"
STOPS = ".!?:;。．！？：；"
DIGIT = re.compile("[0-9]")
NUMERIC = re.compile(r"[+-]?\d[\d.,:/-]*$")
SPLIT_UNIT = re.compile(r"(?<=\d)(?=[^\W\d_]|[%°])")
LINE_BREAK = re.compile("[\r\n\v\f\x85\u2028\u2029]+")
# Letters of scripts without spaces between words: Thai, Lao, Tibetan, Burmese, Khmer, Tai, Balinese,
# Javanese, kana, bopomofo and Han. Each is a token, as are the stops between them.
UNSPACED = re.compile(
    "[\u0e00-\u0e4f\u0e5a-\u0ecf\u0eda-\u0f1f\u0f34-\u103f\u104a-\u108f\u109a-\u109f\u1780-\u17df\u1950-\u19cf\u19da-\u1a7f\u1a9a-\u1aaf"
    "\u1b00-\u1b4f\u2e80-\u2fdf\u3001-\u303f\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua980-\ua9cf\ua9e0-\ua9ef"
    "\ua9fa-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff01\uff08\uff09\uff0c\uff0e\uff1a\uff1b\uff1f\uff61-\uff9f\U00020000-\U0003ffff]"
)
# Stands for a line break among the raw tokens.
BREAK = "\0"
CURRENCY_FIRST = re.compile(r"([$€£])\s?(\d[\d.,]*)")


class Tokens(dict):
    """A number for each raw token, and its hash and facts by that number.

    Facts are bits: the kind inside a sentence, from bit 3 the kind at the start of one, then
    whether the token ends a sentence, is a unit after a number, is a mark alone, and a line break.
    """

    ENDS, UNIT_WORD, MARK, LINE_END = 64, 128, 256, 512

    def __init__(self):
        self.new_hashes, self.new_facts = [], []
        self.hashes, self.facts = np.zeros(0, np.uint64), np.zeros(0, np.int16)

    def __missing__(self, raw: str) -> int:
        if raw == BREAK:
            word, facts = raw, self.LINE_END
        elif raw.isalpha() and raw.islower():
            word, facts = raw, self.UNIT_WORD if raw in UNITS else 0
        else:
            core = raw.strip(MARKS)
            word = (core or raw).lower()
            facts = self.UNIT_WORD if word in UNITS else 0
            if not core:
                facts |= self.MARK | self.ENDS
                if not facts & self.UNIT_WORD:
                    facts |= DROPPED * 9
            elif NUMERIC.match(core):
                facts = NUMBER * 9
            elif core[0].isupper() and len(core) > 1 and core[1:].islower():
                facts |= NAME
            if raw.rstrip(CLOSING)[-1:] in STOPS:
                facts |= self.ENDS
        self.new_hashes.append(xxhash.xxh3_64_intdigest(word))
        self.new_facts.append(facts)
        self[raw] = number = len(self)
        return number

    def look_up(self, raw: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes and facts of ``raw``."""
        numbers = np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))
        if self.new_facts:
            self.hashes = np.concatenate([self.hashes, np.array(self.new_hashes, np.uint64)])
            self.facts = np.concatenate([self.facts, np.array(self.new_facts, np.int16)])
            self.new_hashes.clear()
            self.new_facts.clear()
        return self.hashes[numbers], self.facts[numbers]

    def forget(self) -> None:
        self.clear()
        self.__init__()


def raw_tokens(text: str) -> list[str]:
    """The tokens of a text; a unit is taken off its number, a currency mark put behind it.

    Scripts without spaces are cut into characters.
    """
    if DIGIT.search(text):
        text = SPLIT_UNIT.sub(" ", CURRENCY_FIRST.sub(r"\2 \1 ", text))
    if not text.isascii():
        text = UNSPACED.sub(r" \g<0> ", text)
    return LINE_BREAK.sub(f" {BREAK} ", text).split()


class Templates(NamedTuple):
    """The templates of several texts, one after the other; text ``k`` ends before token ``ends[k]``.

    Tokens that are marks alone are left out; ``at`` is a token's place in ``raw``. A token that is
    at ``starts`` begins a sentence or line, one that is ``either`` is a literal word by its kind and may be a name. ``words`` are hashes without
    placeholders.
    """

    hashes: np.ndarray
    words: np.ndarray
    kinds: np.ndarray
    either: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    raw: list[str]
    ends: np.ndarray


def templates(texts: list[str], tokens: Tokens) -> Templates:
    if len(tokens) > REMEMBERED:
        tokens.forget()
    own = [raw_tokens(t) for t in texts]
    raw = list(chain.from_iterable(own))
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
    hashes, facts = tokens.look_up(raw)
    # Line breaks are taken out: a unit may stand on the line after its number.
    spot = np.nonzero(facts & Tokens.LINE_END == 0)[0]
    ends = np.searchsorted(spot, ends)
    hashes, facts = hashes[spot], facts[spot]
    # The first token of a text starts a sentence and follows no number.
    first = np.zeros(len(spot) + 1, bool)
    first[0] = True
    first[ends] = True
    first = first[:-1]
    starts = first.copy()
    starts[1:] |= np.diff(spot) > 1
    starts[1:] |= facts[:-1] & Tokens.ENDS != 0
    kinds = np.where(starts, (facts >> 3) & 7, facts & 7)
    unit = facts & Tokens.UNIT_WORD != 0
    after_number = ~first
    after_number[1:] &= kinds[:-1] == NUMBER
    kinds[unit & after_number] = UNIT
    # A currency or percent mark is a token after a number only.
    kinds[unit & ~after_number & (facts & Tokens.MARK != 0)] = DROPPED
    either = starts & (facts & 7 == NAME) & (kinds == LITERAL)
    words = hashes.copy()
    for k, name in PLACEHOLDERS.items():
        hashes[kinds == k] = xxhash.xxh3_64_intdigest(name)
    kept = kinds != DROPPED
    at = np.nonzero(kept)[0]
    return Templates(hashes[at], words[at], kinds[at], either[at], starts[at], spot[at], raw, np.concatenate([[0], np.cumsum(kept)])[ends])


def sums(values: np.ndarray, size: int) -> np.ndarray:
    """A polynomial of each ``size`` values that follow each other."""
    n = len(values) - size + 1
    # Put together from windows whose width is a power of two.
    total, done, wide, width, factor = np.full(n, 0x9E3779B97F4A7C15 + size, np.uint64), 0, values, 1, POLYNOMIAL
    while True:
        if size & width:
            total = total * np.uint64(factor) + wide[done : done + n]
            done += width
        if width * 2 > size:
            return total
        wide = wide[:-width] * np.uint64(factor) + wide[width:]
        width, factor = width * 2, factor * factor % (1 << 64)


def mixed(total: np.ndarray) -> np.ndarray:
    total = (total ^ (total >> np.uint64(32))) * np.uint64(POLYNOMIAL)
    return total ^ (total >> np.uint64(29))


def windows(cut: Templates, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The places and hashes of the windows of ``size`` tokens, one for each way to read a window.

    The third array has a bit for each place in a window whose word is read as a name. Readings with
    too few literal words give the hash of the tokens as they are, once, and -1. So do windows under
    ``SHORTEST`` tokens, which must stand alone.
    """
    n = len(cut.hashes) - size + 1
    if n <= 0:
        return
    # The last windows of a text reach into the next one.
    inside = np.ones(n, bool)
    last = (cut.ends[:-1, None] - np.arange(1, size)).ravel()
    inside[last[(last >= 0) & (last < n)]] = False
    if size < SHORTEST:
        at = np.nonzero(inside & cut.starts[:n] & np.append(cut.starts, True)[size:])[0]
        yield at, mixed(sums(cut.words, size)[at] + np.uint64(AS_IS)), np.full(len(at), -1)
        return
    total, least = sums(cut.hashes, size), min(LITERALS, (size + 1) // 2)
    literal = np.concatenate([[0], np.cumsum(cut.kinds == LITERAL)])
    literal = literal[size:] - literal[:n]
    at = np.nonzero(inside & (literal >= least))[0]
    yield at, mixed(total[at]), np.zeros(len(at), np.int64)
    # A word read as a name changes the sum by the difference of the hashes times the factor of its place.
    either = np.nonzero(cut.either)[0]
    change = np.uint64(xxhash.xxh3_64_intdigest(PLACEHOLDERS[NAME])) - cut.hashes[either]
    powers = np.array([pow(POLYNOMIAL, size - 1 - k, 1 << 64) for k in range(size)], np.uint64)
    before = np.concatenate([[0], np.cumsum(cut.either)])
    n_either = before[size:] - before[:n]
    few = np.nonzero(inside & (literal - n_either < least))[0]
    if len(few):
        yield few, mixed(sums(cut.words, size)[few] + np.uint64(AS_IS)), np.full(len(few), -1)
    for reading in range(1, 1 << int(n_either.max())):
        count, needed = reading.bit_count(), reading.bit_length()
        if reading == 1 << needed - 1:
            able = np.nonzero(inside & (n_either >= needed))[0]
        at = able[literal[able] - count >= least]
        if count > size - least or not len(at):
            continue
        own, names = total[at], np.zeros(len(at), np.int64)
        for k in range(needed):
            if reading >> k & 1:
                word = before[at] + k
                place = either[word] - at
                own = own + change[word] * powers[place]
                names |= 1 << place
        yield at, mixed(own), names


def slots(cut: Templates, start: int, size: int, names: int) -> list[str]:
    """The values in the placeholders of a window, each behind its place in it (one digit) and type.

    ``names`` is what ``windows`` gives: -1 for a window without placeholders.
    """
    found = []
    if names < 0:
        return found
    for k in range(start, start + size):
        kind = NAME if names >> (k - start) & 1 else int(cut.kinds[k])
        if kind != LITERAL:
            raw = cut.raw[cut.at[k]]
            found.append(f"{k - start}{kind} {raw.strip(MARKS).lower() or raw}")
    return found


SCHEMA = "_id bigint, _copy bigint, _at bigint, _size bigint, _tokens bigint, _hash bigint, _slots array<string>"
FIELDS = pa.schema([
    ("_id", pa.int64()), ("_copy", pa.int64()), ("_at", pa.int64()), ("_size", pa.int64()), ("_tokens", pa.int64()), ("_hash", pa.int64()),
    ("_slots", pa.list_(pa.string())),
])


def template_windows(rows: DataFrame, shared: Broadcast | None, sizes: list[int]) -> DataFrame:
    """Windows of ``rows`` (_id, _copy, _text) whose hash is in ``shared`` (sorted).

    Without ``shared``: all windows, one of the item's own length if it is shorter than ``WINDOW``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        if shared is not None:
            known = shared.value
            quick = np.zeros(1 << 20, bool)
            quick[known >> np.uint64(44)] = True
        for batch in batches:
            for part in slices(batch, "_text"):
                found = []
                ids, copies = part.column("_id").to_pylist(), part.column("_copy").to_pylist()
                cut_texts = templates([t or "" for t in part.column("_text").to_pylist()], tokens)
                first = np.concatenate([[0], cut_texts.ends[:-1]])
                n_tokens = cut_texts.ends - first
                for size in sizes if shared is not None else range(1, WINDOW + 1):
                    for places, own, names in windows(cut_texts, size):
                        texts = np.searchsorted(cut_texts.ends, places, "right")
                        if shared is None:
                            fitting = np.minimum(n_tokens[texts], WINDOW) == size
                        else:
                            fitting = np.nonzero(quick[own >> np.uint64(44)])[0]
                            fitting = fitting[known[np.searchsorted(known[:-1], own[fitting])] == own[fitting]]
                        for at, k, value, named in zip(
                            places[fitting].tolist(), texts[fitting].tolist(), own[fitting].view(np.int64).tolist(), names[fitting].tolist()
                        ):
                            found.append({
                                "_id": ids[k], "_copy": copies[k], "_at": at - int(first[k]), "_size": size,
                                "_tokens": int(n_tokens[k]), "_hash": value, "_slots": slots(cut_texts, at, size, named),
                            })
                yield pa.RecordBatch.from_pylist(found, schema=FIELDS)

    return rows.mapInArrow(tidy(cut), SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """Documents that hold passages of benchmark items: one row per ``doc_id`` and ``item_id``.

    ``n_windows`` of the item's ``item_windows`` occur in the document. A window counts if its values
    are equal in both texts or if it has none. With other values it counts if they map one to one
    and none of its placeholders stands in a window that gives one value of the item two values.
    ``kind`` is ``exact`` if all values of the windows that count are equal, else
    ``reparameterised``. The benchmark is taken in passes of at most ``pass_windows`` windows.

    Windows with fewer than ``LITERALS`` literal words are compared by their lower-case tokens.

    Items under ``SHORTEST`` tokens are found where they stand alone.

    Rows without id, null and empty texts match nothing. Rows with
    one doc_id count as one document. Repeated items give one row. Texts of any length are read
    whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    # Texts of one id are told apart by their hash, so that the values of one say nothing of another.
    copy = F.xxhash64("text").alias("_copy")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("_id"), copy, F.col("text").alias("_text"))
    asked = materialise(template_windows(items.where("_id is not null"), None, []), "item-windows")
    bounds = asked.agg(F.count("*"), F.collect_set("_size")).first()
    n_windows, sizes = bounds[0], sorted(bounds[1])
    passes = max(1, ceil(n_windows / pass_windows))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("_id"), copy, F.col("text").alias("_text"))
    found, sent = None, []
    for k in range(passes):
        part = asked.where(F.pmod("_hash", F.lit(passes)) == k).select("_hash").distinct()
        wanted = np.sort(part.toArrow().column("_hash").to_numpy().astype(np.int64).view(np.uint64))
        sent.append(spark.sparkContext.broadcast(wanted))
        hits = template_windows(texts, sent[-1], sizes)
        found = hits if found is None else found.union(hits)
    hits = materialise(found.select("_id", "_copy", "_at", "_hash", "_slots"), "hits")
    for hashes in sent:
        hashes.unpersist()
    theirs = asked.select(
        F.col("_id").alias("_item"), F.col("_copy").alias("_item_copy"), F.col("_at").alias("_item_at"), "_tokens", "_size", "_hash",
        F.col("_slots").alias("_item_slots"),
    )
    pairs = hits.join(if_small(theirs, n_windows), "_hash").withColumn("_shift", F.col("_at") - F.col("_item_at"))
    value = F.zip_with(
        "_item_slots", "_slots",
        lambda a, b: F.struct(
            (F.col("_item_at") + F.substring(a, 1, 1).cast("int")).alias("at"),
            F.substr(a, F.lit(2)).alias("a"), F.substr(b, F.lit(2)).alias("b"),
        ),
    )
    pairs = pairs.withColumn("_values", value).withColumn("_equal", F.col("_item_slots") == F.col("_slots"))
    n_values = F.size(F.array_distinct(F.transform("_values", lambda v: F.struct(v["a"], v["b"]))))
    one_to_one = (F.size(F.array_distinct("_values.a")) == n_values) & (F.size(F.array_distinct("_values.b")) == n_values)
    split = F.filter("_values", lambda v: F.exists("_values", lambda w: (w["a"] == v["a"]) & (w["b"] != v["b"])))
    changed = F.when(~F.col("_equal") & one_to_one, F.struct(F.col("_item_at").alias("at"), F.col("_values.at").alias("slots")))
    places = (
        pairs.groupBy("_id", "_copy", "_item", "_item_copy", "_shift")
        .agg(
            F.collect_set(F.when(F.col("_equal"), F.col("_item_at"))).alias("_same"),
            F.collect_set(changed).alias("_changed"),
            F.array_distinct(F.flatten(F.collect_set(F.transform(split, lambda v: v["at"])))).alias("_split"),
            F.max(F.col("_tokens") - F.col("_size") + 1).alias("_windows"),
        )
        .withColumn("_changed", F.filter("_changed", lambda w: ~F.arrays_overlap(w["slots"], F.col("_split"))))
        .withColumn("_places", F.array_union("_same", F.col("_changed.at")))
    )
    return (
        places.where(F.size("_places") > 0)
        .groupBy(F.col("_id").alias("doc_id"), F.col("_item").alias("item_id"))
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("_places")))).cast("bigint").alias("n_windows"),
            F.max("_windows").alias("item_windows"),
            F.when(F.min(F.size("_changed") > 0), "reparameterised").otherwise("exact").alias("kind"),
        )
    )
