"""Intent classifiers. Each adds the columns of a prediction record."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.constants import OTHER, RULE_CLASSIFIER_PATTERNS
from caseloom.functions.numbers import half_up
from caseloom.functions.text import count_matching, fold_case
from caseloom.functions.vectors import dot, softmax, unit
from caseloom.operators.intents import Rules
from caseloom.operators.lsa import LsaModel, fit_lsa
from caseloom.operators.tfidf import TfidfModel, fit_tfidf
from caseloom.session import cut_lineage, small_table

PREDICTION = ["predicted_intent", "raw_intent", "confidence", "is_uncertain", "all_probabilities"]


def settle(raw_intent: Column, confidence: Column, threshold: float, places: int = 4) -> dict[str, Column]:
    """Columns that map an unsure prediction to OTHER; the test uses the unrounded value."""
    unsure = confidence < F.lit(threshold)
    return {
        "predicted_intent": F.when(unsure, F.lit(OTHER)).otherwise(raw_intent),
        "raw_intent": raw_intent,
        "confidence": half_up(confidence, places),
        "is_uncertain": unsure,
    }


# --- most frequent label ------------------------------------------------------------------


def predict_majority(train: DataFrame, df: DataFrame, label: str = "intent") -> DataFrame:
    """Give every row the most frequent training label; its share is the confidence."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    best = F.min_by(label, F.struct((-F.col("n")).alias("n"), F.col(label)))
    top = counts.agg(
        F.struct(
            best.alias("label"),
            (F.max("n") / F.sum("n")).alias("share"),
            F.array_sort(F.collect_set(label)).alias("labels"),
        ).alias("m")
    ).select("m").scalar()
    with_top = df.withColumn("_m", top)
    winner = F.col("_m.label")
    return with_top.withColumns(
        {
            "predicted_intent": winner,
            "raw_intent": winner,
            "confidence": F.col("_m.share"),
            "is_uncertain": F.lit(False),
            "all_probabilities": F.map_from_entries(
                F.transform(
                    F.col("_m.labels"),
                    lambda c: F.struct(c, F.when(c == winner, F.lit(1.0)).otherwise(F.lit(0.0))),
                )
            ),
        }
    ).drop("_m")


@dataclass
class MajorityModel:
    """The most frequent training label, its share and all labels."""

    label: str
    share: float
    labels: list[str]

    def predict(self, df: DataFrame, key: str, text: str = "customer_message") -> DataFrame:
        entries = [F.lit(x) for name in self.labels for x in (name, 1.0 if name == self.label else 0.0)]
        return df.withColumns(
            {
                "predicted_intent": F.lit(self.label),
                "raw_intent": F.lit(self.label),
                "confidence": F.lit(self.share),
                "is_uncertain": F.lit(False),
                "all_probabilities": F.create_map(*entries),
            }
        )

    def save(self, path: str, spark: SparkSession) -> None:
        small_table(spark, [(self.label, self.share, self.labels)], self.DDL).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MajorityModel:
        return cls(**spark.read.schema(cls.DDL).json(path).head().asDict())


MajorityModel.DDL = "label STRING, share DOUBLE, labels ARRAY<STRING>"


def fit_majority(train: DataFrame, label: str = "intent") -> MajorityModel:
    """Of labels with one count the first in order wins. The number of labels bounds what is gathered."""
    counts = train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).collect()
    if not counts:
        raise ValueError("no labelled rows to learn from")
    best = min(counts, key=lambda r: (-r["n"], r[label]))
    return MajorityModel(best[label], best["n"] / sum(r["n"] for r in counts), sorted(r[label] for r in counts))


# --- rules ----------------------------------------------------------------------------------


def predict_by_rules(
    df: DataFrame,
    message: str = "customer_message",
    rules: Rules = RULE_CLASSIFIER_PATTERNS,
    threshold: float = 0.30,
) -> DataFrame:
    """Share of an intent's hits in all hits; a single hit counts as one half."""
    hits = F.array(*[count_matching(message, p, ignore_case=True, folded="_folded") for p in rules.values()])
    names = F.array(*[F.lit(n) for n in rules])
    scored = df.withColumn("_folded", fold_case(F.col(message))).withColumn("_hits", hits).withColumns(
        {
            "_total": F.aggregate("_hits", F.lit(0), lambda acc, x: acc + x),
            "_top": F.array_max("_hits"),
        }
    )
    found = F.col("_total") > 0
    winner = F.element_at(names, F.array_position(F.col("_hits"), F.col("_top")).cast("int"))
    raw = F.coalesce(F.when(found, winner), F.lit(OTHER))
    confidence = (
        F.when(~found, F.lit(1.0))
        .when(F.col("_top") == 1, F.lit(0.5))
        .otherwise(half_up(F.col("_top") / F.col("_total"), 4))
    )
    shares = F.transform(
        "_hits", lambda h: F.when(h > 0, half_up(h / F.col("_total"), 4)).otherwise(F.lit(0.0))
    )
    rest = F.when(found, F.lit(0.0)).otherwise(F.lit(1.0))
    probabilities = F.map_from_arrays(
        F.array(*[F.lit(n) for n in rules], F.lit(OTHER)), F.concat(shares, F.array(rest))
    )
    return scored.withColumns(
        settle(raw, confidence, threshold) | {"all_probabilities": probabilities}
    ).drop("_hits", "_total", "_top", "_folded")


@dataclass
class RulesModel:
    """Patterns by intent, in the order in which ties are broken; nothing is learned."""

    rules: Rules
    threshold: float = 0.30

    def predict(self, df: DataFrame, key: str, text: str = "customer_message") -> DataFrame:
        return predict_by_rules(df, text, self.rules, self.threshold)

    def save(self, path: str, spark: SparkSession) -> None:
        rules = [(name, list(patterns)) for name, patterns in self.rules.items()]
        small_table(spark, [(rules, self.threshold)], self.DDL).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RulesModel:
        stored = spark.read.schema(cls.DDL).json(path).head()
        return cls({r["name"]: r["patterns"] for r in stored["rules"]}, stored["threshold"])


RulesModel.DDL = "rules ARRAY<STRUCT<name: STRING, patterns: ARRAY<STRING>>>, threshold DOUBLE"


# --- nearest centroid -----------------------------------------------------------------------


def class_centroids(
    train: DataFrame, label: str = "intent", vector: str = "embedding", copies: str | None = None
) -> DataFrame:
    """``(label, centroid)``: mean of the unit vectors of each class, scaled to length 1.

    A row counts ``copies`` times, if that column is given.
    """
    times = F.col(copies).cast("double") if copies else None
    mean = Summarizer.mean(array_to_vector(unit(F.col(vector))), times)
    means = train.groupBy(label).agg(vector_to_array(mean).alias("mean"))
    return means.select(F.col(label).alias("label"), unit(F.col("mean")).alias("centroid"))


def predict_by_centroid(
    df: DataFrame,
    centroids: DataFrame,
    vector: str = "embedding",
    threshold: float = 0.35,
    temperature: float = 5.0,
) -> DataFrame:
    """Class of the most similar centroid; the table of classes is a one-row scalar subquery."""
    classes = centroids.agg(
        F.array_sort(F.collect_list(F.struct(F.col("label").cast("string").alias("label"), "centroid"))).alias("c")
    ).scalar()
    return _nearest_class(df, classes, vector, threshold, temperature)


def _nearest_class(df: DataFrame, classes: Column, vector: str, threshold: float, temperature: float) -> DataFrame:
    """``classes`` is an array of ``(label, centroid)`` in the order in which ties are broken."""
    scored = (
        df.withColumn("_c", classes)
        .withColumn("_u", unit(F.col(vector)))
        .withColumn("_s", F.transform("_c", lambda c: half_up(dot(c["centroid"], F.col("_u")), 6)))
    )
    top = F.array_max("_s")
    raw = F.element_at(
        F.transform("_c", lambda c: c["label"]), F.array_position(F.col("_s"), top).cast("int")
    )
    probabilities = F.map_from_arrays(
        F.transform("_c", lambda c: c["label"]),
        F.transform(softmax(F.col("_s"), temperature), lambda p: half_up(p, 4)),
    )
    return scored.withColumns(settle(raw, top, threshold) | {"all_probabilities": probabilities}).drop(
        "_c", "_u", "_s"
    )


@dataclass
class CentroidModel:
    """Embedding of texts and the centroid of each class, classes x components numbers."""

    features: LsaModel
    centroids: list[tuple[str, list[float]]]
    threshold: float = 0.35
    temperature: float = 5.0

    def predict(self, df: DataFrame, key: str, text: str = "customer_message") -> DataFrame:
        rows = [{"label": name, "centroid": centre} for name, centre in self.centroids]
        # A constant of the plan: no job gathers the classes again.
        classes = F.from_json(F.lit(json.dumps(rows)), self.DDL)
        embedded = self.features.embed(df, key, text)
        return _nearest_class(embedded, classes, "embedding", self.threshold, self.temperature).drop("embedding")

    def save(self, path: str, spark: SparkSession) -> None:
        self.features.save(f"{path}/features", spark)
        settings = [(self.centroids, self.threshold, self.temperature)]
        small_table(spark, settings, self.SETTINGS).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CentroidModel:
        stored = spark.read.schema(cls.SETTINGS).parquet(f"{path}/settings").head()
        centroids = [(r["label"], list(r["centroid"])) for r in stored["classes"]]
        return cls(LsaModel.load(spark, f"{path}/features"), centroids, stored["threshold"], stored["temperature"])


CentroidModel.DDL = "ARRAY<STRUCT<label: STRING, centroid: ARRAY<DOUBLE>>>"
CentroidModel.SETTINGS = f"classes {CentroidModel.DDL}, threshold DOUBLE, temperature DOUBLE"


def fit_centroid_model(
    train: DataFrame,
    key: str,
    text: str = "customer_message",
    label: str = "intent",
    components: int = 250,
    max_features: int = 25_000,
    threshold: float = 0.35,
    tfidf: TfidfModel | None = None,
) -> CentroidModel:
    """Nearest centroid over embedded texts. Equal texts of one label are embedded once."""
    train = train.where(F.col(label).isNotNull())
    features = fit_lsa(train, key, text, components, max_features=max_features, tfidf=tfidf)
    copies = train.groupBy(text, label).agg(F.count("*").alias("_copies"))
    centroids = class_centroids(features.embed(copies, text, text), label, copies="_copies").collect()
    if not centroids:
        raise ValueError("no labelled rows to learn from")
    classes = sorted((r["label"], list(r["centroid"])) for r in centroids)
    return CentroidModel(features, classes, threshold)


# --- logistic regression ----------------------------------------------------------------------


@dataclass
class IntentModel:
    """Multinomial logistic regression over TF-IDF or LSA features."""

    features: TfidfModel | LsaModel
    model: LogisticRegressionModel
    labels: list[str]
    threshold: float = 0.40

    def _featurise(self, df: DataFrame, key: str, text: str) -> DataFrame:
        if isinstance(self.features, LsaModel):
            dense = self.features.embed(df, key, text, normalise=False)
            return dense.withColumn("features", array_to_vector("embedding")).drop("embedding")
        return self.features.features(df, key, text).drop("indices", "values")

    def predict(self, df: DataFrame, key: str, text: str = "customer_message") -> DataFrame:
        names = F.array(*[F.lit(x) for x in self.labels])
        scored = self.model.transform(self._featurise(df, key, text)).withColumn(
            "_p", vector_to_array("probability")
        )
        top = F.array_max("_p")
        raw = F.element_at(names, F.array_position(F.col("_p"), top).cast("int"))
        probabilities = F.map_from_arrays(names, F.transform("_p", lambda p: half_up(p, 4)))
        return scored.withColumns(
            settle(raw, top, self.threshold) | {"all_probabilities": probabilities}
        ).drop("features", "rawPrediction", "probability", "prediction", "_p")

    def save(self, path: str, spark: SparkSession) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        kind = "lsa" if isinstance(self.features, LsaModel) else "tfidf"
        if kind == "lsa":
            self.features.save(f"{path}/features", spark)
        else:
            self.features.save(f"{path}/features")
        spark.createDataFrame(
            [(kind, self.labels, self.threshold)], "kind STRING, labels ARRAY<STRING>, threshold DOUBLE"
        ).write.mode("overwrite").json(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IntentModel:
        settings = spark.read.schema("kind STRING, labels ARRAY<STRING>, threshold DOUBLE").json(
            f"{path}/settings"
        ).head()
        kind = LsaModel if settings["kind"] == "lsa" else TfidfModel
        return cls(
            kind.load(spark, f"{path}/features"),
            LogisticRegressionModel.load(f"{path}/model"),
            list(settings["labels"]),
            settings["threshold"],
        )


def fit_intent_model(
    train: DataFrame,
    key: str,
    text: str = "customer_message",
    label: str = "intent",
    embedding: bool = False,
    c: float = 2.0,
    components: int = 300,
    max_features: int | None = None,
    max_iter: int = 1000,
    threshold: float = 0.40,
    tfidf: TfidfModel | None = None,
) -> IntentModel:
    """Fit with balanced class weights, which add up to the number of rows.

    A vocabulary that was counted before can be given as ``tfidf``.

    The number of classes is bounded by the model itself (it keeps one coefficient row per
    class), so the table of class weights may be broadcast.
    """
    if embedding:
        features: TfidfModel | LsaModel = fit_lsa(
            train, key, text, components, max_features=max_features or 35_000, tfidf=tfidf
        )
    else:
        features = tfidf or fit_tfidf(train, key, text, max_features=max_features or 30_000)
    # Equal rows count as one with their number as a factor of the weight, in each of many passes.
    copies = cut_lineage(train.groupBy(text, label).agg(F.count("*").alias("_copies")))
    indexer = StringIndexer(
        inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc"
    ).fit(copies)
    counts = copies.groupBy(label).agg(F.sum("_copies").alias("n"))
    n_rows = copies.agg(F.sum("_copies")).head()[0]
    class_weights = counts.select(
        label, (F.lit(float(n_rows)) / (F.lit(float(len(indexer.labels))) * F.col("n"))).alias("weight")
    )
    shell = IntentModel(features, None, list(indexer.labels), threshold)
    rows = shell._featurise(indexer.transform(copies), text, text).join(
        F.broadcast(class_weights), label
    ).withColumn("weight", F.col("weight") * F.col("_copies"))
    rows = rows.select("features", "label_index", "weight").persist()
    try:
        regression = LogisticRegression(
            family="multinomial",
            labelCol="label_index",
            weightCol="weight",
            standardization=False,
            elasticNetParam=0.0,
            regParam=1.0 / (c * n_rows),
            maxIter=max_iter,
        )
        shell.model = regression.fit(rows)
    finally:
        rows.unpersist()
    return shell
