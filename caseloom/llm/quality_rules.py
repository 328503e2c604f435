"""Quality rules: text statistics and a learned decision list over them, all as Spark expressions.

Sequential covering learns the list: a rule grows by the threshold condition with the best gain
and is pruned on rows held back, then the rows it covers are taken out and the next rule follows.
Each rule is a conjunction of thresholds; the list becomes one ordered ``CASE WHEN``.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import WORD_SPACE, let

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
# Labelled rows that a list is learned from: the smallest by a hash of the id.
LEARNING_ROWS = 20_000
MAX_RULES = 12
MAX_CONDITIONS = 4
THRESHOLDS = 32
# A rule must be right on at least this share of the rows held back for pruning.
MIN_PRECISION = 0.9
# A rule must cover at least this many learning rows.
MIN_COVER = 5
FEATURES = [
    "n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
    "exclamation_share",
]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold


def space_trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WORD_SPACE))


def repeated_words(hashes: Column) -> Column:
    """Words inside a window of ``WINDOW`` words that occurs twice or more, from word hashes.

    Windows are compared by 64-bit hashes. Their places are sorted by hash, so that equal windows
    are neighbours; the places kept are then swept once, in order, for the words they cover.
    """
    n = F.size(hashes)
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    def places(own: Column) -> Column:
        by_hash = F.array_sort(F.transform(own, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def equal_neighbour(rows: Column) -> Column:
            last = F.size(rows) - 1
            return F.filter(
                rows,
                lambda row, k: ((k > 0) & (F.get(rows, k - 1)["h"] == row["h"]))
                | ((k < last) & (F.get(rows, k + 1)["h"] == row["h"])),
            )

        return F.array_sort(F.transform(let(by_hash, equal_neighbour), lambda row: row["i"]))

    def covered(sorted_places: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
        return F.aggregate(
            sorted_places, start,
            lambda acc, i: F.struct(
                (acc["total"] + i + WINDOW - F.greatest(acc["end"], i)).alias("total"), (i + WINDOW).alias("end")
            ),
            lambda acc: acc["total"],
        )

    def counted(own: Column) -> Column:
        return F.when(F.size(F.array_distinct(own)) == F.size(own), F.lit(0)).otherwise(let(places(own), covered))

    return F.when(n < WINDOW, F.lit(0)).otherwise(let(windows, counted))


def text_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, counts and the features of the rules, for whole texts.

    Null and blank texts have no words and all counts and shares 0. Other columns are left out.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = space_trimmed(F.col("_text"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))

    def counts(w: Column) -> Column:
        lines = F.filter(F.split(F.col("_text"), "\n"), lambda line: space_trimmed(line) != "")
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(F.col("_text"), F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            let(lines, lambda kept: F.size(kept) - F.size(F.array_distinct(kept))).cast("bigint").alias("n_dup_lines"),
            let(F.transform(w, lambda word: F.xxhash64(word)), repeated_words).cast("bigint").alias("n_repeat_words"),
            F.regexp_count(F.col("_text"), F.lit("\\p{Lu}")).cast("bigint").alias("n_upper"),
            F.regexp_count(F.col("_text"), F.lit("[0-9]")).cast("bigint").alias("n_digits"),
            F.regexp_count(F.col("_text"), F.lit("!")).cast("bigint").alias("n_exclamations"),
            F.regexp_count(F.col("_text"), F.lit("\n")).cast("bigint").alias("n_breaks"),
        )

    base = docs.select(*keep, whole.alias("_text")).select(
        *keep, let(words, counts).alias("_stats")
    )
    flat = base.select(*keep, "_stats.*")
    word_chars, n_words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return flat.select(
        "*",
        (F.col("word_chars") / n_words).alias("mean_word"),
        (F.col("n_symbols") / word_chars).alias("symbol_share"),
        (F.col("n_dup_lines") / (F.col("n_breaks") + 1)).alias("dup_line_share"),
        (F.col("n_repeat_words") / n_words).alias("repeat_share"),
        (F.col("n_upper") / word_chars).alias("upper_share"),
        (F.col("n_digits") / word_chars).alias("digit_share"),
        (F.col("n_exclamations") / n_words).alias("exclamation_share"),
    )


def gain(positive: int, negative: int, positive_now: int, negative_now: int) -> float:
    """FOIL's gain of a condition that leaves ``*_now`` of the rows."""
    if not positive_now:
        return 0.0
    return positive_now * (
        log2(positive_now / (positive_now + negative_now)) - log2(positive / (positive + negative))
    )


def grown_rule(rows: list[dict], cuts: dict[str, list[float]]) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS:
        positive = sum(r["bad"] for r in rows)
        negative = len(rows) - positive
        if not positive or not negative:
            break
        best, found = 1e-9, None
        for feature, thresholds in cuts.items():
            ordered = sorted((r[feature], r["bad"]) for r in rows)
            at, below_bad, below = 0, 0, 0
            for threshold in thresholds:
                while at < len(ordered) and ordered[at][0] <= threshold:
                    below_bad += ordered[at][1]
                    below += 1
                    at += 1
                sides = ((True, positive - below_bad, negative - below + below_bad), (False, below_bad, below - below_bad))
                for above, p, n in sides:
                    if p + n >= MIN_COVER and gain(positive, negative, p, n) > best:
                        best, found = gain(positive, negative, p, n), Condition(feature, above, threshold)
        if found is None:
            break
        rule.append(found)
        rows = [r for r in rows if found.holds(r)]
    return rule


def precision(rule: list[Condition], rows: list[dict]) -> tuple[float, int]:
    covered = [r["bad"] for r in rows if all(c.holds(r) for c in rule)]
    return (sum(covered) / len(covered) if covered else 0.0), sum(covered)


def pruned_rule(rule: list[Condition], rows: list[dict]) -> list[Condition]:
    """Drop last conditions while that does not lower (p - n) / (p + n) on the rows held back."""
    best = rule
    for length in range(len(rule) - 1, 0, -1):
        if precision(rule[:length], rows)[0] >= precision(best, rows)[0]:
            best = rule[:length]
    return best


def learn_rules(rows: list[dict]) -> list[list[Condition]]:
    """An ordered list of conjunctions that mark bad rows; rows are dicts of features and ``bad``.

    Every third row is held back for pruning. Empty if no rule is precise enough.
    """
    grow = [r for k, r in enumerate(rows) if k % 3]
    prune = [r for k, r in enumerate(rows) if not k % 3]
    cuts = {}
    for feature in FEATURES:
        values = sorted({r[feature] for r in rows if r["bad"]} | {r[feature] for r in rows[::7]})
        steps = {round(k * (len(values) - 1) / THRESHOLDS) for k in range(THRESHOLDS + 1)} if values else set()
        cuts[feature] = [float(values[k]) for k in sorted(steps)]
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES:
        rule = grown_rule(grow, cuts)
        if not rule:
            break
        rule = pruned_rule(rule, prune)
        share, hits = precision(rule, prune)
        if share < MIN_PRECISION or not hits:
            break
        rules.append(rule)
        grow = [r for r in grow if not all(c.holds(r) for c in rule)]
        prune = [r for r in prune if not all(c.holds(r) for c in rule)]
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Learn from at most ``LEARNING_ROWS`` labelled documents; several labels count as the lowest."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("_quality"))
        .select(F.col("doc_id").alias("_id"), (F.col("_quality") == 0).alias("bad"), F.xxhash64("doc_id").alias("_order"))
        .orderBy("_order", "_id").limit(LEARNING_ROWS)
    )
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_body")).join(F.broadcast(chosen), "_id")
    known = text_statistics(texts, ["_order", "_id", "bad"], "_body")
    found = known.select("_order", "_id", "bad", *FEATURES).collect()
    return learn_rules([r.asDict() for r in sorted(found, key=lambda r: (r["_order"], r["_id"]))])


def rule_number(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that holds, from 1; 0 if none does."""
    number = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        holds = rule[0].column()
        for condition in rule[1:]:
            holds = holds & condition.column()
        number = F.when(holds, F.lit(k)).otherwise(number)
    return number


def apply_rules(docs: DataFrame, keep: list[str], rules: list[list[Condition]], text: str = "text") -> DataFrame:
    """``keep``, the counts, ``base_failed``, ``rule`` (0: none) and ``kept`` for whole texts.

    Null and blank texts fail the base rules. Rows repeat as in the input; an empty table gives an
    empty result.
    """
    stats = text_statistics(docs, keep, text)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        rule_number(rules).alias("rule"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
