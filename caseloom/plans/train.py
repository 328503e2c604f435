"""Training of the intent models: fit, compare, choose, store and load."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.constants import RULE_CLASSIFIER_PATTERNS
from caseloom.operators import classifiers as C
from caseloom.operators import metrics
from caseloom.operators.tfidf import fit_tfidf
from caseloom.session import cut_lineage, small_table


class Model(Protocol):
    """Adds the columns of a prediction record to rows with a text."""

    def predict(self, df: DataFrame, key: str, text: str = ...) -> DataFrame: ...

    def save(self, path: str, spark: SparkSession) -> None: ...


KINDS = {
    "majority": C.MajorityModel,
    "rules": C.RulesModel,
    "centroid": C.CentroidModel,
    "regression": C.IntentModel,
}


def train_models(
    train: DataFrame, key: str, text: str = "customer_message", label: str = "intent", max_iter: int = 1000
) -> dict[str, Model]:
    """The five models with the published settings.

    ``train`` is read several times and should be written before. Terms are counted once: the three vocabularies
    differ in their size only, and a smaller one is the head of a larger.
    """
    train = train.where(F.col(label).isNotNull())
    largest = fit_tfidf(train, key, text, max_features=35_000)
    given = {"text": text, "label": label}
    return {
        "majority": C.fit_majority(train, label),
        "rules": C.RulesModel(RULE_CLASSIFIER_PATTERNS),
        "centroid": C.fit_centroid_model(train, key, **given, tfidf=largest.most_frequent(25_000)),
        "tfidf_logistic": C.fit_intent_model(
            train, key, **given, max_iter=max_iter, tfidf=largest.most_frequent(30_000)
        ),
        "lsa_logistic": C.fit_intent_model(
            train, key, **given, embedding=True, max_iter=max_iter, tfidf=largest
        ),
    }


def compare(
    models: dict[str, Model], splits: dict[str, DataFrame], key: str, text: str = "customer_message",
    label: str = "intent",
) -> DataFrame:
    """``(model, split, metrics...)`` of every model on every split, written down."""
    scorers = {name: lambda df, m=model: m.predict(df, key, text) for name, model in models.items()}
    return cut_lineage(metrics.compare_models(scorers, splits, label))


def choose(models: dict[str, Model], comparison: DataFrame, select_on: str = "val") -> tuple[str, Model]:
    """Name and model of the best macro F1; ``select_on="test"`` repeats the published choice."""
    best = metrics.best_model(comparison, select_on).head()
    if best is None:
        raise ValueError(f"no metrics on {select_on}")
    return best["model"], models[best["model"]]


def save_model(spark: SparkSession, name: str, model: Model, path: str) -> None:
    """Store any of the models; its kind and name are written last."""
    kind = next(k for k, cls in KINDS.items() if isinstance(model, cls))
    model.save(f"{path}/fitted", spark)
    small_table(spark, [(kind, name)], "kind STRING, name STRING").write.mode("overwrite").json(f"{path}/kind")


def load_model(spark: SparkSession, path: str) -> tuple[str, Model]:
    stored = spark.read.schema("kind STRING, name STRING").json(f"{path}/kind").head()
    return stored["name"], KINDS[stored["kind"]].load(spark, f"{path}/fitted")


def as_classifier(model: Model, text: str = "message") -> Callable[[DataFrame], DataFrame]:
    """The form in which a :class:`~caseloom.plans.decide.DecisionPlan` takes a model."""
    return lambda df: model.predict(df, text, text).drop("n_known_terms")


def predict_one(spark: SparkSession, model: Model, text: str | None) -> dict:
    """The prediction record of one text.

    A model keeps what it has looked up, so that a further text costs one small job.
    """
    row = small_table(spark, [(text,)], "text STRING")
    found = model.predict(row, "text", "text").select(*C.PREDICTION).head()
    return found.asDict(recursive=True)
