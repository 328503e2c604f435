import pytest

from caseloom.operators import classifiers as C
from caseloom.operators.tfidf import fit_tfidf
from caseloom.plans import train as T
from caseloom.plans.decide import DecisionPlan, build_case_index

TEXTS = {
    "BILLING": ["my card was charged twice", "refund the double charge please", "the invoice charge is wrong"],
    "WIFI": ["wifi connection drops at night", "my network connection is slow", "no wifi signal in the kitchen"],
    "SOUND": ["no sound from the speaker", "the speaker volume is too low", "sound crackles on the left speaker"],
}


@pytest.fixture(scope="module")
def rows(spark):
    data = []
    for i in range(90):
        label = list(TEXTS)[i % 3]
        split = "train" if i < 60 else "val" if i < 75 else "test"
        data.append((f"m{i}", TEXTS[label][i // 3 % 3] + (" now" if i % 2 else ""), label, split))
    data += [("null-label", "wifi wifi wifi", None, "train"), ("null-text", None, "BILLING", "train")]
    return spark.createDataFrame(data, "id STRING, message STRING, intent STRING, split STRING").cache()


@pytest.fixture(scope="module")
def models(rows):
    return T.train_models(rows.where("split = 'train'"), "id", "message", max_iter=60)


def records(df):
    return {r["id"]: tuple(r[c] for c in C.PREDICTION) for r in df.collect()}


def test_trained_models_learn_and_the_choice_is_the_best_on_validation(rows, models):
    held = {s: rows.where(f"split = '{s}'") for s in ("val", "test")}
    comparison = T.compare(models, held, "id", "message")
    f1 = {(r["model"], r["split"]): r["macro_f1"] for r in comparison.collect()}
    assert len(f1) == 10
    for name in ("centroid", "tfidf_logistic", "lsa_logistic"):
        assert f1[name, "val"] == f1[name, "test"] == 1.0
    assert f1["majority", "val"] < 0.4
    name, model = T.choose(models, comparison)
    assert name == "centroid" and model is models["centroid"]  # the first name of equal ones
    with pytest.raises(ValueError):
        T.choose(models, comparison, "other")


@pytest.mark.parametrize("name", ["majority", "rules", "centroid", "tfidf_logistic", "lsa_logistic"])
def test_a_stored_model_scores_as_before_also_text_by_text(spark, rows, models, tmp_path, name):
    T.save_model(spark, name, models[name], str(tmp_path / "m"))
    stored_name, again = T.load_model(spark, str(tmp_path / "m"))
    assert stored_name == name and type(again) is type(models[name])
    batch = records(again.predict(rows, "id", "message"))
    assert batch == records(models[name].predict(rows, "id", "message"))
    for row in rows.where("id IN ('m62', 'null-text')").collect():
        one = T.predict_one(spark, again, row["message"])
        assert tuple(one[c] for c in C.PREDICTION) == batch[row["id"]]


@pytest.mark.parametrize("name", ["centroid", "tfidf_logistic"])
def test_a_further_text_takes_one_job(spark, models, name):
    T.predict_one(spark, models[name], "no sound at all")
    spark.sparkContext.setJobGroup(f"one-{name}", "one text")
    try:
        T.predict_one(spark, models[name], "the wifi is slow")
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"one-{name}")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1


def test_centroids_count_copies_and_skip_rows_without_label(spark, rows, models):
    model = models["centroid"]
    assert [name for name, _ in model.centroids] == sorted(TEXTS)
    train = rows.where("split = 'train' AND intent IS NOT NULL")
    plain = C.class_centroids(model.features.embed(train, "id", "message"), "intent").collect()
    for r in plain:
        assert dict(model.centroids)[r["label"]] == pytest.approx(list(r["centroid"]), abs=1e-6)


def test_nothing_to_learn_from(rows):
    none = rows.where("intent IS NULL")
    with pytest.raises(ValueError):
        C.fit_majority(none)
    with pytest.raises(ValueError):
        C.fit_centroid_model(none, "id", "message")


def test_smaller_vocabulary_is_the_head_of_the_larger(rows):
    large = fit_tfidf(rows, "id", "message", max_features=1000)
    again = fit_tfidf(rows, "id", "message", max_features=7)
    small = large.most_frequent(7)
    assert small.size == again.size == 7 and large.most_frequent(1000) is large
    columns = ["term", "term_index", "df", "total", "idf"]
    assert sorted(small.terms.select(columns).collect()) == sorted(again.terms.select(columns).collect())


def test_decisions_with_a_trained_model(spark, rows, models):
    cases = rows.where("split = 'train' AND intent IS NOT NULL").selectExpr(
        "id AS conversation_id", "message AS customer_message", "'we can help with that today' AS brand_response",
        "intent", "'B' AS brand", "2L AS turns", "'' AS timestamp",
    )
    plan = DecisionPlan(T.as_classifier(models["centroid"]), build_case_index(cases, components=5))
    asked = rows.where("split = 'test'").select("id", "message")
    done = plan.run(asked, "id").select("id", "intent", "rule_id", "n_known_terms").collect()
    truth = {r["id"]: r["intent"] for r in rows.collect()}
    assert len(done) == 15 and all(r["intent"] == truth[r["id"]] and r["n_known_terms"] > 0 for r in done)
