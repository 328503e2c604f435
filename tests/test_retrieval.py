import numpy as np
import pytest

from caseloom.operators import retrieval


def brute_force(queries, cases, k, exclude_self):
    def unit(v):
        length = np.linalg.norm(v)
        return v / (length if length > 0 else 1.0)

    ids = sorted(cases)
    matrix = np.array([unit(np.array(cases[i], dtype=float)) for i in ids])
    out = {}
    for q, v in queries.items():
        sims = np.floor((matrix @ unit(np.array(v, dtype=float))) * 1e6 + 0.5) / 1e6
        ranked = sorted(zip(-sims, ids))
        out[q] = [i for _, i in ranked if not (exclude_self and i == q)][:k]
    return out


def vectors(spark, data):
    return spark.createDataFrame(list(data.items()), "id BIGINT, embedding ARRAY<DOUBLE>")


def found(df, key="qid"):
    out = {}
    for r in df.orderBy(key, "rank").collect():
        out.setdefault(r[key], []).append(r["case_id"])
    return out


def clustered(n, seed, dim=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    points = {i: [float(x) for x in np.round(centres[i % 5] + 0.05 * rng.normal(size=dim), 4)] for i in range(n)}
    for i in range(0, n, 3):
        points[i] = points[0]  # a third of all rows are copies
    for i in range(5, n, 40):
        points[i] = [0.0] * dim
    return points


@pytest.mark.parametrize("block", [7, 40, 4096])
@pytest.mark.parametrize("exclude", [False, True])
def test_same_as_brute_force(spark, block, exclude):
    cases = clustered(300, 3)
    queries = cases if exclude else clustered(90, 4)
    got = retrieval.nearest_cases(
        vectors(spark, queries).withColumnRenamed("id", "qid"),
        vectors(spark, cases).withColumnRenamed("id", "cid"),
        "qid", "cid", 5, exclude, block_rows=block,
    )
    assert found(got) == brute_force(queries, cases, 5, exclude)


def test_fewer_cases_than_asked(spark):
    cases = {1: [1.0, 0.0], 2: [0.0, 1.0]}
    got = retrieval.nearest_cases(
        vectors(spark, {9: [1.0, 1.0]}).withColumnRenamed("id", "qid"),
        vectors(spark, cases).withColumnRenamed("id", "cid"), "qid", "cid", 5,
    )
    assert found(got) == {9: [1, 2]}
    assert retrieval.nearest_cases(
        vectors(spark, {9: [1.0, 1.0]}).withColumnRenamed("id", "qid"),
        vectors(spark, cases).withColumnRenamed("id", "cid"), "qid", "cid", 0,
    ).count() == 0


def test_metrics(spark):
    rows = [(1, "a", 1, "b"), (1, "a", 2, "a"), (2, "a", 1, "a"), (2, "a", 2, "b"), (3, "c", 1, "a")]
    df = spark.createDataFrame(rows, "query_id INT, true_intent STRING, rank INT, intent STRING")
    m = retrieval.retrieval_metrics(retrieval.judge_hits(df, "query_id")).head()
    assert (m["recall_at_1"], m["recall_at_3"], m["recall_at_5"], m["mrr"]) == (0.3333, 0.6667, 0.6667, 0.5)


def test_hot_vectors_are_spread(spark, monkeypatch):
    from caseloom.operators import skew

    monkeypatch.setattr(skew, "TARGET_ROWS", 1)
    cases = clustered(120, 3)
    frame = vectors(spark, cases)
    got = retrieval.nearest_cases(
        frame.withColumnRenamed("id", "qid"), frame.withColumnRenamed("id", "cid"), "qid", "cid", 5, True, 40
    )
    assert found(got) == brute_force(cases, cases, 5, True)


def test_similarities_come_in_bounded_slices():
    rng = np.random.default_rng(5)
    asked, known = rng.standard_normal((2 * retrieval.SLICE_ROWS + 3, 4)), rng.standard_normal((9, 4))
    slices = list(retrieval.similarities(asked, known))
    assert [first for first, _ in slices] == [0, retrieval.SLICE_ROWS, 2 * retrieval.SLICE_ROWS]
    assert max(len(part) for _, part in slices) == retrieval.SLICE_ROWS
    assert np.allclose(np.vstack([part for _, part in slices]), asked @ known.T, atol=1e-6)
    assert list(retrieval.similarities(asked[:0], known)) == []


def test_few_queries_go_to_the_cases(spark, monkeypatch):
    """Both ways of the search give the brute-force rows, with copies, equal scores, zero vectors and repeated ids."""
    rng = np.random.default_rng(8)
    distinct = rng.integers(-2, 3, (40, 3)).astype(float)
    rows = [(f"c{i % 110}", distinct[i % 40].tolist()) for i in range(130)] + [("none", None)]
    cases = spark.createDataFrame(rows, "case STRING, embedding ARRAY<FLOAT>").repartition(5)
    asked = [(i, distinct[i % 45].tolist() if i % 45 < 40 else [0.0] * 3) for i in range(60)] + [(99, None)]
    queries = spark.createDataFrame(asked, "id INT, embedding ARRAY<FLOAT>")

    def unit(v):
        return np.array(v) / (np.linalg.norm(v) or 1.0)

    expected = set()
    for i, vector in asked[:-1]:
        scored = [(-np.floor(float(unit(vector) @ unit(v)) * 1e6 + 0.5) / 1e6, c) for c, v in rows[:-1]]
        for rank, (score, case) in enumerate(sorted(scored)[:4], 1):
            expected.add((i, rank, case, round(max(-score, 0.0), 4)))
    found = {}
    for sent in (4096, 0):
        monkeypatch.setattr(retrieval, "SENT_QUERIES", sent)
        got = retrieval.nearest_cases(queries, cases, "id", "case", 4, block_rows=16)
        found[sent] = got.schema.simpleString(), {(r[0], r[1], r[2], round(r[3], 4)) for r in got.collect()}
    assert found[4096] == found[0] and found[0][1] == expected

    monkeypatch.setattr(retrieval, "SENT_QUERIES", 4096)
    monkeypatch.setattr(retrieval, "_nearest_to_many", None)
    plain = cases.select("case", "embedding")
    assert retrieval.nearest_cases(queries, plain.limit(0), "id", "case", 4).count() == 0
    assert retrieval.nearest_cases(queries.limit(0), plain, "id", "case", 4).count() == 0
