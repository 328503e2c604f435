from caseloom.operators import metrics

CLASSES = "ACCOUNT APP AUDIO BATTERY BILLING CONNECTIVITY DISPLAY ORDER OTHER SOFTWARE STORE".split()
# Published confusion matrix of the selected classifier: true rows, predicted columns.
MATRIX = [
    [389, 4, 0, 0, 1, 1, 3, 9, 4, 0, 3],
    [0, 443, 0, 0, 4, 0, 2, 5, 6, 1, 9],
    [0, 0, 21, 0, 0, 0, 0, 0, 3, 0, 0],
    [4, 2, 0, 94, 1, 0, 0, 2, 4, 0, 1],
    [6, 1, 0, 1, 898, 0, 4, 15, 9, 0, 9],
    [0, 0, 0, 0, 0, 40, 0, 0, 9, 0, 1],
    [0, 0, 0, 0, 0, 0, 78, 0, 5, 0, 3],
    [14, 16, 0, 5, 33, 1, 11, 3345, 65, 5, 54],
    [1, 0, 0, 0, 3, 0, 0, 2, 5897, 0, 0],
    [2, 10, 0, 0, 5, 0, 2, 6, 5, 165, 2],
    [0, 1, 0, 1, 2, 0, 0, 1, 11, 0, 462],
]


def published(spark):
    rows = [
        (CLASSES[i], CLASSES[j], n) for i, row in enumerate(MATRIX) for j, n in enumerate(row) if n
    ]
    return spark.createDataFrame(rows, "truth STRING, predicted STRING, n BIGINT")


def test_published_scores(spark):
    row = metrics.overall_scores(metrics.class_scores(published(spark))).head()
    assert row["rows"] == 12222
    assert (row["accuracy"], row["macro_precision"], row["macro_recall"], row["macro_f1"]) == (
        0.9681, 0.9325, 0.912, 0.9199,
    )


def test_class_table_and_matrix(spark):
    counts = published(spark)
    table = {r["class"]: r for r in metrics.per_class_table(metrics.class_scores(counts)).collect()}
    assert (table["STORE"]["precision"], table["STORE"]["recall"], table["STORE"]["support"]) == (0.8493, 0.9665, 478)
    wide = {r["truth"]: r for r in metrics.confusion_matrix(counts, CLASSES).collect()}
    assert [[wide[t][p] for p in CLASSES] for t in CLASSES] == MATRIX
    worst = metrics.most_confused(counts, 2).collect()
    assert [(r["truth"], r["predicted"], r["n"]) for r in worst] == [("ORDER", "OTHER", 65), ("ORDER", "STORE", 54)]


def test_class_seen_on_one_side_only(spark):
    counts = spark.createDataFrame([("a", "b", 2), ("a", "a", 2)], "truth STRING, predicted STRING, n BIGINT")
    row = metrics.overall_scores(metrics.class_scores(counts)).head()
    assert (row["accuracy"], row["macro_precision"], row["macro_recall"]) == (0.5, 0.5, 0.25)
