import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseloom.functions.text import word_tokens
from caseloom.operators import tfidf, words

LETTERS = [
    "a", "b", "yz", "the", "İ", "ı", "ß", "Σ", "ς", "é", "é", "中", "𝒳", "𐐀", "1", "²", "Ⅷ", "١", "_", " ", " ", "  ", "-", ".",
    "😀", "\n", "\x00", "᠎", "ﬀ", "K",
]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [None, "", "a", "ab", "é", "éé", " é ", "𝒳", "𝒳𝒳", "ab"]
    return spark.createDataFrame([(i % 350, t) for i, t in enumerate(texts)], "id INT, text STRING").repartition(3).cache()


def test_words_of_a_batch_are_those_of_the_expression(spark, odd, monkeypatch):
    """Letters of one to four bytes, words at the edges of texts, and slices of few bytes."""
    monkeypatch.setattr(words, "SLICE_BYTES", 50)
    rows = odd.select(words.lowered("text").alias("text"), word_tokens(F.coalesce("text", F.lit(""))).alias("words")).collect()
    split = words.Splitter(words.word_characters(spark))
    texts = pa.array([r["text"] for r in rows])
    for some, expected in ((texts, rows), (texts.slice(7, 90), rows[7:97]), (texts.slice(0, 0), [])):
        found, lengths = [], []
        for part in words.slices(some):
            tokens, counts = split(part)
            found += tokens.to_pylist()
            lengths += counts.tolist()
        assert found == [w for r in expected for w in r["words"]]
        assert lengths == [len(r["words"]) for r in expected]


@pytest.mark.parametrize("most", [8, 0])
@pytest.mark.parametrize("held", [1 << 20, 3])
def test_terms_are_those_of_a_count_of_all(odd, monkeypatch, most, held):
    """Cuts among terms that are equally frequent, tasks that pass on counts early, and the way without word lists."""
    monkeypatch.setattr(tfidf, "MOST_WORDS", most)
    monkeypatch.setattr(tfidf, "TASK_COUNTS", held)
    counts = tfidf.term_counts(odd, "id")
    for min_df, size in ((1, 40), (2, 5), (2, 35_000), (3, 60)):
        expected = tfidf._numbered(tfidf.vocabulary(counts, odd.count(), min_df, None), size)[0]
        got = tfidf.fit_tfidf(odd, "id", min_df=min_df, max_features=size).terms
        assert got.schema.simpleString() == expected.schema.simpleString()
        assert got.orderBy("term").collect() == expected.orderBy("term").collect()


def test_tasks_pass_on_sums_and_no_rare_pairs(spark):
    """A row per word and task, where there was one per word and text; pairs that cannot be terms are not passed on."""
    texts = ["red apple pie"] * 200 + [f"red w{i} pie" for i in range(200)]
    docs = spark.createDataFrame([(t,) for t in texts], "text STRING").coalesce(1).select(words.lowered("text").alias("_text"))
    characters = words.word_characters(spark)
    totals = tfidf.word_totals(docs, characters)
    partial = [n for n in str(totals._jdf.queryExecution().optimizedPlan()).splitlines() if "MapInArrow" in n]
    assert len(partial) == 1 and "explode" not in str(totals._jdf.queryExecution()).lower()
    assert {(r["term"], r["df"], r["total"]) for r in totals.where("total > 1").collect()} == {("red", 400, 400), ("pie", 400, 400), ("apple", 200, 200)}
    known = pa.array(["apple", "pie", "red", "w7"])
    pairs = tfidf.pair_totals(docs, characters, known, 100)
    assert {tuple(r) for r in pairs.collect()} == {("red apple", 200, 200), ("apple pie", 200, 200)}


def test_values_of_known_terms(odd):
    """Weights by hand; a text without terms, and one with a pair whose words are no terms themselves."""
    model = tfidf.fit_tfidf(odd, "id")
    terms = {r["term"]: (r["term_index"], r["idf"]) for r in model.terms.collect()}
    tokens = odd.select("id", "text", word_tokens(F.coalesce("text", F.lit(""))).alias("words"))
    for row in model.transform(tokens, "id").collect():
        every = list(row["words"]) + [f"{a} {b}" for a, b in zip(row["words"], row["words"][1:])]
        raw = {terms[t][0]: terms[t][1] * (1 + np.log(every.count(t))) for t in every if t in terms}
        assert row["indices"] == sorted(raw) and row["n_known_terms"] == len(raw)
        length = np.sqrt(sum(v * v for v in raw.values()))
        assert np.allclose(row["values"], [raw[i] / length for i in sorted(raw)])
    table = words.Vocabulary.of(["red apple", "car"], [0, 1], [1.0, 2.0], words.word_characters(odd.sparkSession))
    indices, counts, lengths = words.Lookup(table)(pa.array(["red apple red apple", "apple red", "", "car red"]))
    assert (indices.tolist(), counts.tolist(), lengths.tolist()) == ([0, 1], [2, 1], [1, 0, 0, 1])
