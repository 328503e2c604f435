import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext

from caseloom.operators import lsa
from caseloom.operators.classifiers import IntentModel, fit_intent_model
from caseloom.operators.lsa import LsaModel, fit_lsa, singular_vectors
from caseloom.operators.tfidf import fit_tfidf

TOPICS = {"A": "red apple pear plum", "B": "car road wheel motor", "C": "sea wave boat sail"}


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        label = "ABC"[i % 3]
        words = list(rng.choice(TOPICS[label].split(), 4)) + list(rng.choice(["the", "one", "see"], 2))
        rows.append((f"d{i}", " ".join(words), label))
    return spark.createDataFrame(rows, "id STRING, text STRING, label STRING").cache()


def matrix_of(model, docs):
    rows = model.transform(docs, "id").orderBy("id").collect()
    x = np.zeros((len(rows), model.size))
    for r, row in enumerate(rows):
        x[r, list(row["indices"])] = row["values"]
    return x


def test_rows_have_length_one_and_unknown_text_is_empty(spark, docs):
    model = fit_tfidf(docs, "id")
    x = matrix_of(model, docs)
    assert np.allclose(np.linalg.norm(x, axis=1), 1.0)
    odd = model.transform(spark.createDataFrame([("z", "zzz qqq")], "id STRING, text STRING"), "id").head()
    assert odd["n_known_terms"] == 0 and list(odd["indices"]) == []


def test_singular_vectors_agree_with_numpy(docs):
    model = fit_tfidf(docs, "id")
    x = matrix_of(model, docs)
    features = model.transform(docs, "id").select("indices", "values")
    v = singular_vectors(features, model.size, 4)
    expected = np.linalg.svd(x)[2][:4].T
    # same subspace
    assert np.allclose(np.linalg.svd(v.T @ expected)[1], 1.0, atol=1e-4)


def test_embedding_model_survives_storage(spark, docs, tmp_path):
    model = fit_lsa(docs, "id", components=4)
    model.save(str(tmp_path / "m"), spark)
    again = LsaModel.load(spark, str(tmp_path / "m"))
    a = np.array([r["embedding"] for r in model.embed(docs, "id").orderBy("id").collect()])
    b = np.array([r["embedding"] for r in again.embed(docs, "id").orderBy("id").collect()])
    assert np.allclose(a, b) and np.allclose(np.linalg.norm(a, axis=1), 1.0, atol=1e-5)


@pytest.mark.parametrize("places", [(0,), (1,), (0, 2), ()])
def test_partial_matrices_add_up_whatever_tasks_have_no_rows(spark, places):
    part = np.arange(4.0).reshape(2, 2)
    rows = [(part.tobytes() if k in places else b"",) for k in range(3)]
    pieces = spark.createDataFrame(rows, "rows BINARY").coalesce(1)
    total = lsa._folded(pieces, 2, lsa._add)
    assert total.tolist() == (part * len(places) if places else np.zeros((0, 2))).tolist()


def test_fewer_texts_than_cores_are_fitted(spark, monkeypatch):
    """Tasks without rows, so that parts without rows come after others when they are joined."""
    monkeypatch.setattr(SparkContext, "defaultParallelism", property(lambda self: 12))
    texts = ["red apple", "red pear", "blue sea", "blue sail", "red"]
    docs = spark.createDataFrame([(i, texts[i % 5]) for i in range(40)], "id INT, text STRING").repartition(12, "id")
    model = fit_lsa(docs, "id", components=3)
    x = matrix_of(model.tfidf, docs)
    expected = np.linalg.svd(x)[2][:3].T
    v = model.basis.loader()()
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-9) and np.allclose(v @ v.T, expected @ expected.T, atol=1e-6)


@pytest.mark.parametrize("embedding", [False, True])
def test_regression_learns_and_survives_storage(spark, docs, tmp_path, embedding):
    model = fit_intent_model(docs, "id", "text", "label", embedding=embedding, components=6, max_iter=50)
    model.save(str(tmp_path / "m"), spark)
    rows = IntentModel.load(spark, str(tmp_path / "m")).predict(docs, "id", "text").collect()
    right = sum(r["raw_intent"] == r["label"] for r in rows)
    assert right >= 0.95 * len(rows)
    for r in rows:
        assert set(r["all_probabilities"]) == {"A", "B", "C"}
        assert abs(sum(r["all_probabilities"].values()) - 1) < 0.001
        assert r["confidence"] == max(r["all_probabilities"].values())


def test_sparse_products_in_pieces(monkeypatch):
    """Rows over the size of a group, and groups of several rows, beside a dense product."""
    monkeypatch.setattr(lsa, "CHUNK", 7)
    rng = np.random.default_rng(2)
    lengths = np.array([3, 1, 20, 2, 2, 2, 5, 7, 1])
    indices = np.concatenate([rng.choice(40, n, replace=False) for n in lengths])
    values, matrix = rng.standard_normal(len(indices)), rng.standard_normal((40, 4))
    dense = np.zeros((len(lengths), 40))
    dense[np.repeat(np.arange(len(lengths)), lengths), indices] = values
    total, products, seen = np.zeros_like(matrix), [], []
    for rows, terms in lsa.row_groups(lengths):
        group = indices[terms], values[terms], lengths[rows]
        products.append(lsa.rows_times(*group, matrix))
        lsa.add_transposed(*group, products[-1], total)
        seen.append(rows.stop - rows.start)
    assert sum(seen) == len(lengths) and max(seen) > 1
    assert np.allclose(np.vstack(products), dense @ matrix)
    assert np.allclose(total, dense.T @ dense @ matrix)


def test_groups_of_short_rows_and_gathered_rows_are_bounded(monkeypatch):
    """A group is bounded in rows, since it has a dense product per row, and no large table is gathered."""
    monkeypatch.setattr(lsa, "GROUP_ROWS", 3)
    monkeypatch.setattr(lsa, "GATHERED", 2)
    rng = np.random.default_rng(3)
    lengths = np.array([1, 1, 1, 1, 9, 2, 1, 5])
    assert [r.stop - r.start for r, _ in lsa.row_groups(lengths)] == [3, 3, 2]
    indices = np.concatenate([rng.choice(12, n, replace=False) for n in lengths])
    values, matrix = rng.standard_normal(len(indices)), rng.standard_normal((12, 3))
    dense = np.zeros((len(lengths), 12))
    dense[np.repeat(np.arange(len(lengths)), lengths), indices] = values
    total = np.zeros_like(matrix)
    products = lsa.rows_times(indices, values, lengths, matrix)
    lsa.add_transposed(indices, values, lengths, products, total)
    assert np.allclose(products, dense @ matrix) and np.allclose(total, dense.T @ dense @ matrix)


def test_basis_of_several_blocks_counts_copies(spark):
    """More terms than a block has, rows with copies, an empty row, fewer directions than asked for."""
    rng = np.random.default_rng(4)
    n_terms, rows = lsa.BLOCK_TERMS * 2 + 9, []
    for k in range(24):
        indices = sorted(int(i) for i in rng.choice(n_terms, 60, replace=False))
        rows.append((indices, [float(x) for x in rng.standard_normal(60)], k % 5 + 1))
    rows.append(([], [], 3))
    dense = np.zeros((len(rows), n_terms))
    for k, (indices, values, n) in enumerate(rows):
        dense[k, indices] = np.array(values) * np.sqrt(n)
    features = spark.createDataFrame(rows, "indices array<int>, values array<double>, n bigint")
    few = singular_vectors(features, n_terms, 6, rounds=12)
    expected = np.linalg.svd(dense)[2]
    assert np.allclose(few.T @ few, np.eye(6), atol=1e-9)
    assert np.allclose(np.linalg.svd(few.T @ expected[:6].T)[1], 1.0, atol=1e-3)
    every = singular_vectors(features, n_terms, 50)
    assert every.shape == (n_terms, 24)
    assert np.allclose(np.linalg.svd(every.T @ expected[:24].T)[1], 1.0, atol=1e-6)
    assert singular_vectors(features.limit(0), n_terms, 5).shape == (n_terms, 0)
    assert singular_vectors(features.limit(0), 0, 5).shape == (0, 0)


def test_batches_are_put_together_to_groups(monkeypatch):
    """Each group costs time for every term that it has, so small batches do not make groups of their own."""
    monkeypatch.setattr(lsa, "GROUP_ROWS", 5)
    batches = [
        pa.RecordBatch.from_pydict({"indices": [[k], [], [k, 9]], "values": [[1.0], [], [0.5, k / 2]], "n": [1, 7, k]}) for k in range(4)
    ]
    tables = list(lsa.row_tables(iter(batches)))
    assert [t[2].tolist() for t in tables] == [[1, 2] * 3, [1, 2]]
    assert np.concatenate([t[0] for t in tables]).tolist() == [x for k in range(4) for x in (k, k, 9)]
    assert np.concatenate([t[3] for t in tables]).tolist() == [x for k in range(4) for x in (1, k)]
    assert list(lsa.row_tables(iter([]))) == []
