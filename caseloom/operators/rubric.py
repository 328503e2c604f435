"""Automatic 1-5 rubric for drafted replies."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from caseloom.functions import constants as K
from caseloom.functions.numbers import at_least, half_up, share
from caseloom.functions.text import fold_case, java_pattern, required_start, split_words

SCORES = ["groundedness", "relevance", "tone", "correctness", "helpfulness", "overall"]


_TOKEN = re.compile(r"\w{2,}")


def _term_counts(text: str | None) -> Counter:
    """Counts of words and of pairs of neighbours; a pair is a tuple, which no word equals."""
    tokens = _TOKEN.findall((text or "").lower())
    counts = Counter(tokens)
    counts.update(zip(tokens, tokens[1:]))
    return counts


def _largest_cosine(first: Counter, texts: list[str | None]) -> float | None:
    """Largest TF-IDF cosine of ``first`` to the texts, all of them being the corpus; None if it has no term."""
    if not first:
        return 0.0 if any(_TOKEN.search((t or "").lower()) for t in texts) else None
    others = [_term_counts(t) for t in texts]
    n = len(others) + 1
    seen = Counter(chain(first, *others))
    # The square of a term's inverse frequency, by the number of texts that have the term.
    squares = [0.0, *((math.log((1 + n) / (1 + df)) + 1) ** 2 for df in range(1, n + 1))]

    def length(c: Counter) -> float:
        return math.sqrt(sum([tf * tf * squares[seen[t]] for t, tf in c.items()]))

    best, own = 0.0, length(first)
    for other in others:
        common = first.keys() & other.keys()
        if common:
            shared = sum([first[t] * other[t] * squares[seen[t]] for t in common])
            best = max(best, shared / (own * length(other)))
    return best


def _first_to_others(texts: list[str]) -> float | None:
    """Largest TF-IDF cosine of the first text to any other, the texts being the corpus."""
    return _largest_cosine(_term_counts(texts[0]), texts[1:])


@F.pandas_udf(DoubleType())
def _similarity(texts: pd.Series) -> pd.Series:
    return texts.map(_first_to_others).astype("float64")


def pair_similarity(texts: Column) -> Column:
    """Similarity of the first text of an array to the rest; null if no text has a token.

    Each row is a corpus of its own. In Arrow batches this is a projection, linear in the
    text; with built-in operators every single term of every row would have to be exploded,
    grouped and sorted.
    """
    return half_up(_similarity(texts), 6)


SIMILARITIES = StructType([StructField(name, DoubleType()) for name in ("to_evidence", "to_message", "to_truth")])


@F.pandas_udf(SIMILARITIES)
def _similarities(draft: pd.Series, evidence: pd.Series, message: pd.Series, truth: pd.Series) -> pd.DataFrame:
    """The draft beside each of the three corpora; its terms are counted once for all."""
    rows = []
    for reply, cited, asked, given in zip(draft, evidence, message, truth):
        first = _term_counts(reply)
        found = None if cited is None else _largest_cosine(first, list(cited))
        rows.append((found, _largest_cosine(first, [asked]), _largest_cosine(first, [given])))
    return pd.DataFrame(rows, columns=SIMILARITIES.names, dtype="float64")


def reply_similarities(replies: DataFrame) -> DataFrame:
    """Add the similarity of each draft to its evidence, its message and the true reply."""
    evidence = F.filter("evidence", lambda e: F.trim(e) != "")
    texts = [F.coalesce(c, F.lit("")) for c in ("draft_reply", "message", "true_reply")]
    scored = replies.withColumn("_s", _similarities(texts[0], evidence, *texts[1:]))
    return scored.withColumns(
        {
            "to_evidence": F.coalesce(half_up(F.col("_s.to_evidence"), 6), F.lit(0.0)),
            "to_message": F.coalesce(half_up(F.col("_s.to_message"), 6), F.lit(0.0)),
            "to_truth": half_up(F.col("_s.to_truth"), 6),
        }
    ).drop("_s")


def groundedness(draft: Column, evidence: Column, similarity: Column) -> Column:
    return (
        F.when(F.trim(draft) == "", F.lit(1))
        .when(F.coalesce(F.size(evidence), F.lit(0)) <= 0, F.lit(2))
        .otherwise(at_least(similarity, K.GROUNDEDNESS_CUTS, 1))
    )


def keyword_share(draft: Column, intent: Column) -> Column:
    """Part of the intent's keywords that occur in the reply; 0 for an unknown intent."""
    keywords = F.lit(None).cast("array<string>")
    for name, words in K.REPLY_KEYWORDS.items():
        keywords = F.when(intent == name, F.array(*[F.lit(w) for w in words])).otherwise(keywords)
    hits = F.size(F.filter(keywords, lambda w: F.contains(F.lower(draft), w)))
    return F.when(keywords.isNotNull(), hits / F.size(keywords)).otherwise(F.lit(0.0))


def relevance(draft: Column, intent: Column, similarity: Column) -> Column:
    combined = half_up(F.lit(0.5) * keyword_share(draft, intent) + F.lit(0.5) * similarity, 6)
    return F.when(F.trim(draft) == "", F.lit(1)).otherwise(at_least(combined, K.RELEVANCE_CUTS, 1))


def _marker_count(draft: Column, markers: list[str]) -> Column:
    text = F.lower(draft)
    return sum((F.contains(text, F.lit(m)).cast("int") for m in markers), F.lit(0))


def tone(draft: Column) -> Column:
    friendly = _marker_count(draft, K.POSITIVE_MARKERS)
    return (
        F.when(F.trim(draft) == "", F.lit(1))
        .when(_marker_count(draft, K.AGGRESSIVE_MARKERS) > 0, F.lit(1))
        .when(friendly >= 3, F.lit(5))
        .when(friendly == 2, F.lit(4))
        .when(friendly == 1, F.lit(3))
        .when(F.size(split_words(draft)) >= 10, F.lit(2))
        .otherwise(F.lit(1))
    )


def unsupported_claims(draft: Column) -> Column:
    """Text of the first match of each pattern that matches."""
    found = F.array(
        *[
            F.when(
                F.contains(fold_case(draft), F.lit(required_start(p).lower())),
                F.regexp_extract(draft, java_pattern(f"({p})", ignore_case=True), 1),
            ).otherwise(F.lit(""))
            for p in K.UNSUPPORTED_CLAIM_PATTERNS
        ]
    )
    return F.filter(found, lambda m: m != "")


def correctness(true_reply: Column, similarity: Column) -> Column:
    """Tenths of similarity to the true reply plus one, within 1..5; 3 if there is nothing to
    compare with."""
    scored = F.least(F.lit(5), F.greatest(F.lit(1), F.floor(similarity * 10).cast("int") + 1))
    nothing = (F.coalesce(true_reply, F.lit("")) == "") | similarity.isNull()
    return F.when(nothing, F.lit(3)).otherwise(scored)


def score_replies(replies: DataFrame) -> DataFrame:
    """Add all scores to rows with ``message``, ``intent``, ``draft_reply``, ``evidence`` and
    ``true_reply``. An empty draft scores 1 throughout."""
    draft = F.col("draft_reply")
    rows = reply_similarities(replies)
    scored = rows.withColumns(
        {
            "groundedness": groundedness(draft, F.col("evidence"), F.col("to_evidence")),
            "relevance": relevance(draft, F.col("intent"), F.col("to_message")),
            "tone": tone(draft),
            "correctness": F.when(F.trim(draft) == "", F.lit(1)).otherwise(
                correctness(F.col("true_reply"), F.col("to_truth"))
            ),
            "unsupported_claims": unsupported_claims(draft),
        }
    ).drop("to_evidence", "to_message", "to_truth")
    base = F.col("groundedness") + F.col("relevance") + F.col("tone")
    helpful = F.least(F.lit(5), F.greatest(F.lit(1), F.floor(base / 3).cast("int")))
    scored = scored.withColumns(
        {"helpfulness": helpful, "has_unsupported_claim": F.size("unsupported_claims") > 0}
    )
    return scored.withColumn(
        "overall", half_up((base + F.col("correctness") + F.col("helpfulness")) / 5.0, 2)
    )


def quality_summary(scored: DataFrame) -> DataFrame:
    """One row of average scores and the rate of unsupported claims, unescalated rows only."""
    auto = ~F.col("escalate") if "escalate" in scored.columns else F.lit(True)
    return scored.agg(
        F.count_if(auto).alias("replies"),
        *[half_up(F.avg(F.when(auto, F.col(s))), 3).alias(f"avg_{s}") for s in SCORES],
        share(F.count_if(auto & F.col("has_unsupported_claim")), F.count_if(auto)).alias("unsupported_claim_rate"),
    )


def quality_by_intent(scored: DataFrame, true_intent: str = "true_intent") -> DataFrame:
    auto = ~F.col("escalate") if "escalate" in scored.columns else F.lit(True)
    per_intent = scored.groupBy(true_intent).agg(
        half_up(F.avg(F.when(auto, F.col("overall"))), 3).alias("avg_overall"),
        F.count_if(auto).alias("replies"),
    )
    return per_intent.where(F.col("replies") > 0)
