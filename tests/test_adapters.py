"""Models of pyspark.ml: the adapted model predicts the same, and whole models are scored."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from brevispark.operators.adapters import combined_model, components_model, explain_model, fit_ml, from_ml, score_model
from brevispark.operators.anomalies import AnomalyDetector
from brevispark.operators.automl import Classifier, Regressor
from brevispark.operators.combined import COMPONENTS, CombinedScore
from brevispark.operators.models import MLP, GaussianNB, LinearClassifier

NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 2))
    data = [
        (i, *map(float, r), float(r[0] > 0) + float(r[1] > 0.5), float(r[0] > 0), float(2 * r[0] - r[1]))
        for i, r in enumerate(x)
    ]
    df = spark.createDataFrame(data, "id int, a double, b double, three double, two double, y double").repartition(3)
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).persist()


ESTIMATORS = {
    "linear": ("y", lambda: LinearRegression()),
    "tree of numbers": ("y", lambda: DecisionTreeRegressor(maxDepth=3)),
    "tree": ("three", lambda: DecisionTreeClassifier(maxDepth=3)),
    "logistic 3": ("three", lambda: LogisticRegression(regParam=0.01)),
    "logistic 2": ("two", lambda: LogisticRegression(regParam=0.01)),
    "svc": ("two", lambda: LinearSVC(maxIter=20)),
    "one against the rest": ("three", lambda: OneVsRest(classifier=LinearSVC(maxIter=20))),
    "naive Bayes": ("three", lambda: NaiveBayes(modelType="gaussian")),
    "perceptron 3": ("three", lambda: MultilayerPerceptronClassifier(layers=[2, 3, 3], maxIter=30, seed=1)),
    "perceptron 2": ("two", lambda: MultilayerPerceptronClassifier(layers=[2, 4, 3, 2], maxIter=30, seed=1)),
}


@pytest.mark.parametrize("kind", ESTIMATORS)
def test_adapted_models_predict_alike(rows, kind):
    label, make = ESTIMATORS[kind]
    estimator = make()
    fitted = estimator.fit(rows, {estimator.labelCol: label})
    own = from_ml(fitted, NAMES)
    got = own.transform(fitted.transform(rows), "own").select("prediction", "own").collect()
    assert all(abs(r["prediction"] - r["own"]) < 1e-9 for r in got)
    assert set(own.subset()) <= {0, 1} and own.text().endswith("\n")
    if label != "y" and "probability" in fitted.transform(rows).columns:
        both = fitted.transform(rows).select("probability", F.array(*own.probabilities()).alias("p")).collect()
        assert all(np.allclose(r["probability"].toArray(), r["p"], atol=1e-9) for r in both)


def test_refused_models(rows):
    bits = VectorAssembler(inputCols=["two", "two"], outputCol="features").transform(rows.drop("features"))
    for label, e, data in (
        ("two", RandomForestClassifier(numTrees=2), rows),
        ("y", GBTRegressor(maxIter=1), rows),
        ("two", NaiveBayes(modelType="bernoulli"), bits),
        ("two", LogisticRegression(threshold=0.7), rows),
    ):
        with pytest.raises(TypeError):
            fit_ml(e, data.withColumn("label", F.col(label)), NAMES)
    with pytest.raises(ValueError):
        from_ml(LinearRegression(labelCol="y").fit(rows), ["a"])
    with pytest.raises(TypeError):
        from_ml(object(), NAMES)


def test_scores_of_whole_models(rows):
    metric = CombinedScore("numeric", "numeric").fit(rows, NAMES, "y")
    fitted = LinearRegression(labelCol="y").fit(rows)
    c = components_model(metric, fitted)
    assert set(c) == set(COMPONENTS) and c[
        "inaccuracy"
    ] < 0.05 and c["deficiency"] == metric.metric.measures([0, 1])["deficiency"]
    assert combined_model(metric, fitted) == pytest.approx(
        1 - score_model(metric, fitted)
    ) and explain_model(metric, fitted)["components"] == pytest.approx(c)


def test_explicit_candidates_of_pyspark_ml(rows):
    fitted = DecisionTreeRegressor(maxDepth=2, labelCol="y").fit(rows)
    auto = Regressor(["linear_regression"]).fit(
        rows, NAMES, "y", candidates={"plain": LinearRegression(), "tree": fitted}
    )
    table = {r["candidate"]: r for r in auto.results_dataframe().collect()}
    assert table["plain"]["native_estimator_score"] > 0.999 and table["tree"]["model_type"] == "DecisionTree"
    with pytest.raises(TypeError):
        Regressor(["linear_regression"]).fit(rows, NAMES, "y", candidates=[GBTRegressor(maxIter=1)])
    nb = Classifier(["naive_bayes"]).fit(rows, NAMES, "three")
    assert len(nb.decision_function(rows).first()["decision"]) == 3


def test_probabilities_of_a_model_find_anomalies(rows):
    m = LinearClassifier(["a"], [0.0, 1.0], [[4.0]], [0.0])
    d = AnomalyDetector(
        "classification", anomaly_rule="probability_quantile", anomaly_quantile=0.9
    ).fit(rows, NAMES, "two", "id", model=m)
    table = d.anomaly_table(only_anomalies=False).collect()
    assert 10 <= sum(r["is_anomaly"] for r in table) <= 20 and all(0 <= r["anomaly_score"] <= 0.5 for r in table)
    with pytest.raises(ValueError):
        AnomalyDetector("classification", anomaly_rule="probability_quantile").fit(rows, NAMES, "three", "id", model=m)
    none = AnomalyDetector("classification").fit(rows, NAMES, "two", "id", prediction="two")
    assert none.group_points("a").count() == 0


@pytest.mark.parametrize(
    "kind,f",
    [
        ("identity", lambda v: v),
        ("relu", lambda v: np.maximum(v, 0)),
        ("logistic", lambda v: 1 / (1 + np.exp(-v))),
        ("tanh", np.tanh),
    ],
)
def test_activations(rows, kind, f):
    w, v = np.array([[1.0, -0.5], [0.3, 2.0]]), np.array([[1.5], [-1.0]])
    net = MLP(NAMES, None, [w, v], [np.array([0.1, -0.2]), np.array([0.4])], activation=kind)
    scope: dict = {}
    exec(net.text(), scope)  # the description is a program that predicts
    for r in rows.select("a", "b", net.column().alias("p")).limit(5).collect():
        want = (f(np.array([r["a"], r["b"]]) @ w + [0.1, -0.2]) @ v + 0.4)[0]
        assert r["p"] == pytest.approx(want) and scope["predict"]([r["a"], r["b"]]) == pytest.approx(want, abs=0.05)
    with pytest.raises(ValueError):
        MLP(NAMES, activation="step")
    assert GaussianNB(["a"], [0, 1], [0.5, 0.5], [[0.0], [1.0]], [[1.0], [1.0]]).scores()
