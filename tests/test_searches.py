"""Sparse, stored and approximate search beside brute force."""

import math
import random
import re
import shutil
from collections import Counter, defaultdict

import numpy as np
import pytest

from caseloom.operators import sparse_search
from caseloom.operators.approximate_search import approximate_cases, recall
from caseloom.operators.sparse_search import build_term_index, sparse_topk
from caseloom.operators.vector_index import add_cases, open_index, search

VECTORS = "id bigint, embedding array<float>"


def plain_nearest(queries, cases, k):
    def unit(v):
        v = np.array(v, np.float32).astype(float)
        n = np.linalg.norm(v)
        return v / n if n else v

    result = []
    for q, v in queries:
        if v is None:
            continue
        scored = sorted((-math.floor(float(unit(v) @ unit(w)) * 1e6 + 0.5) / 1e6, c) for c, w in cases if w is not None)
        result += [(q, rank, c, math.floor(max(-s, 0.0) * 1e4 + 0.5) / 1e4) for rank, (s, c) in enumerate(scored[:k], 1)]
    return sorted(result)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def vectors():
    chance = np.random.default_rng(3)
    rows = [(k, [float(x) for x in chance.standard_normal(8)]) for k in range(120)]
    # Copies, a zero vector and a row without one.
    return rows + [(200 + k, rows[0][1]) for k in range(7)] + [(300, [0.0] * 8), (301, None)]


def test_stored_index(spark, vectors, tmp_path):
    path, raw = str(tmp_path / "index"), str(tmp_path / "raw")
    spark.createDataFrame(vectors, VECTORS).write.parquet(raw)
    cases = spark.read.parquet(raw)
    add_cases(spark, path, cases.where("id % 2 = 0"), "id", block_rows=10)
    add_cases(spark, path, cases.where("id % 2 = 1"), "id", block_rows=10)
    # No search reads the raw cases again: they are gone.
    shutil.rmtree(raw)
    index = open_index(spark, path)
    asked = vectors[:25] + [(400, vectors[0][1]), (401, vectors[0][1]), (402, [0.0] * 8), (403, None)]
    queries = spark.createDataFrame(asked, VECTORS)
    for _ in range(2):
        found = search(queries, index, "id", "bigint", 4, block_rows=6)
        assert rows_of(found.select("id", "rank", "case_id", "similarity_score")) == plain_nearest(asked, vectors, 4)
    others = search(queries, index, "id", "bigint", 3, exclude_self=True)
    assert not [r for r in others.collect() if r["id"] == r["case_id"]]
    assert search(queries, index, "id", "bigint", 0).count() == 0
    assert search(queries.where("false"), index, "id", "bigint").count() == 0
    # Two parts, each with its own row for the copies that it got.
    assert index.size() == 122


def test_stored_index_passes_and_missing(spark, vectors, tmp_path, monkeypatch):
    from caseloom.operators import vector_index

    monkeypatch.setattr(vector_index, "PASS_BLOCKS", 2)
    index = add_cases(spark, str(tmp_path / "one"), spark.createDataFrame(vectors, VECTORS), "id", block_rows=50)
    asked = vectors[:30]
    found = search(spark.createDataFrame(asked, VECTORS), index, "id", "bigint", 5, block_rows=4)
    assert rows_of(found.select("id", "rank", "case_id", "similarity_score")) == plain_nearest(asked, vectors, 5)
    with pytest.raises(FileNotFoundError):
        open_index(spark, str(tmp_path / "none"))


def test_approximate_search(spark):
    chance = np.random.default_rng(5)
    centres = chance.standard_normal((20, 16))
    rows = [(k, [float(x) for x in centres[k % 20] + 0.3 * chance.standard_normal(16)]) for k in range(1500)]
    rows += [(5000 + k, rows[1][1]) for k in range(30)] + [(6000, None), (6001, [0.0] * 16)]
    index = spark.createDataFrame(rows, VECTORS)
    asked = index.where("id % 50 = 0 or id = 6000")
    exact = plain_nearest([r for r in rows if r[0] % 50 == 0 and r[0] != 6000], rows, 5)
    truth = spark.createDataFrame(exact, "id bigint, rank int, case_id bigint, similarity_score double")
    # Buckets split into pieces find the same as whole ones.
    found = [approximate_cases(asked, index, "id", "id", 5, block_rows=n) for n in (4096, 20)]
    assert rows_of(found[0].select("id", "rank", "case_id", "similarity_score")) == rows_of(found[1].select("id", "rank", "case_id", "similarity_score"))
    measured = recall(found[0], truth, "id").first()
    assert measured["recall"] >= 0.9 and measured["queries"] == len({r[0] for r in exact})
    # What is found is scored exactly.
    known = {(q, c): s for q, _, c, s in plain_nearest([r for r in rows if r[0] % 50 == 0], rows, len(rows))}
    assert all(known[r["id"], r["case_id"]] == r["similarity_score"] for r in found[0].collect())
    assert approximate_cases(asked, index.limit(0), "id", "id").count() == 0
    assert approximate_cases(asked, index, "id", "id", 0).count() == 0


def plain_sparse(docs, queries, k, min_df=2):
    words = lambda t: re.findall(r"\w{2,}", (t or "").lower())
    df = Counter(w for _, t in docs for w in set(words(t)))
    idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items() if n >= min_df}

    def weights(t):
        raw = {w: (1 + math.log(n)) * idf[w] for w, n in Counter(words(t)).items() if w in idf}
        length = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / length for w, x in raw.items()}

    stored = {d: weights(t) for d, t in docs}
    result = defaultdict(list)
    for q, t in queries:
        own = weights(t)
        for d, w in stored.items():
            if own.keys() & w.keys():
                result[q].append((-math.floor(sum(own[x] * w[x] for x in own.keys() & w.keys()) * 1e6 + 0.5) / 1e6, d))
    return sorted((q, rank, d, -s) for q, found in result.items() for rank, (s, d) in enumerate(sorted(found)[:k], 1))


@pytest.mark.parametrize("seeds, sent", [(1, 200_000), (30, 200_000), (10_000, 200_000), (30, 20)])
def test_sparse_search(spark, seeds, sent, monkeypatch):
    monkeypatch.setattr(sparse_search, "SEED_POSTINGS", seeds)
    # The last case shuffles whatever may grow, and looks the vocabulary up in two parts.
    monkeypatch.setattr(sparse_search, "BROADCAST_ROWS", sent)
    pick = random.Random(8)
    vocabulary = [f"word{k}" for k in range(300)]
    text = lambda n: " ".join(vocabulary[min(int(pick.expovariate(0.02)), 299)] for _ in range(n))
    docs = [(k, text(pick.randint(1, 60)) + " the of and") for k in range(300)] + [(900, None), (901, "")]
    docs += [(902 + k, docs[5][1]) for k in range(8)]
    queries = [(k, text(pick.randint(1, 30)) + " the") for k in range(25)] + [(50, None), (51, "unknownword"), (52, "the"), (53, docs[5][1])]
    index = build_term_index(spark.createDataFrame(docs, "id bigint, text string"), "id")
    found = sparse_topk(spark.createDataFrame(queries, "item bigint, text string"), index, "item", k=5)
    got, expected = rows_of(found), plain_sparse(docs, queries, 5)
    assert [r[:3] for r in got] == [r[:3] for r in expected]
    assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, expected))


def test_frequent_terms_form_no_pairs(spark, monkeypatch):
    """Terms whose part cannot reach the score to beat are not looked up."""
    asked = []
    monkeypatch.setattr(sparse_search, "SEED_POSTINGS", 5)
    real = sparse_search.pair_scores
    monkeypatch.setattr(sparse_search, "pair_scores", lambda pairs, *rest: asked.append(pairs.count()) or real(pairs, *rest))
    docs = [(k, f"the common words of all topic{k // 4} topic{k // 4} rare{k // 2} rare{k // 2}") for k in range(400)]
    index = build_term_index(spark.createDataFrame(docs, "id bigint, text string"), "id")
    found = sparse_topk(spark.createDataFrame([(1, "the topic3 rare6 of")], "item bigint, text string"), index, "item", k=2)
    assert [r["case_id"] for r in found.orderBy("rank").collect()] == [12, 13]
    assert sum(asked) < 20


@pytest.mark.parametrize("sent", [200_000, 20])
def test_only_near_cases_are_scored_in_full(spark, monkeypatch, sent):
    """Cases that may be near by their rare terms are judged by the left out terms before their scores are added up."""
    asked = []
    real = sparse_search.pair_scores
    monkeypatch.setattr(sparse_search, "pair_scores", lambda pairs, *rest: asked.append(pairs.count()) or real(pairs, *rest))
    for name, value in (("SEED_POSTINGS", 5), ("PROBED", 5), ("BROADCAST_ROWS", sent)):
        monkeypatch.setattr(sparse_search, name, value, raising=False)
    pick = random.Random(3)
    text = lambda n: " ".join(f"word{min(int(pick.expovariate(0.08)), 99)}" for _ in range(n))
    docs = [(k, text(pick.randint(5, 60))) for k in range(600)]
    queries = [(k, text(40)) for k in range(10)]
    index = build_term_index(spark.createDataFrame(docs, "id bigint, text string"), "id")
    got = rows_of(sparse_topk(spark.createDataFrame(queries, "item bigint, text string"), index, "item", k=5))
    expected = plain_sparse(docs, queries, 5)
    assert [r[:3] for r in got] == [r[:3] for r in expected]
    assert asked[-1] < 50
