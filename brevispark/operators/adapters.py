"""Fitted models of pyspark.ml as models of this library, and scores of a whole model.

Only kinds that have a description are taken: trees, linear and logistic regression, linear support vectors (also one
against the rest), Gaussian naive Bayes and perceptrons. All others, ensembles included, are refused.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from brevispark.operators.models import MLP, DecisionTree, GaussianNB, LinearClassifier, LinearRegressor, LinearSVC, Model, TreeNode, artifacts


def tree_of(node, by_class: bool, total: float) -> TreeNode:
    """A node of a pyspark.ml tree and all below it; risks are shares of `total` training weight."""
    stats = list(node.impurityStats().stats())
    weight = sum(stats) if by_class else stats[0]
    out = TreeNode(
        [float(x) for x in stats] if by_class else float(node.prediction()),
        weight,
        float(node.impurity()) * weight / total,
    )
    if node.getClass().getSimpleName() == "InternalNode":
        if node.split().getClass().getSimpleName() != "ContinuousSplit":
            raise TypeError("no description for splits over categories")
        out.feature, out.threshold = node.split().featureIndex(), float(node.split().threshold())
        out.left, out.right = tree_of(node.leftChild(), by_class, total), tree_of(node.rightChild(), by_class, total)
    return out


def _tree(m, features: list[str], classes: list | None) -> Model:
    root, by_class = m._java_obj.rootNode(), classes is not None
    stats = list(root.impurityStats().stats())
    return DecisionTree(features, tree_of(root, by_class, sum(stats) if by_class else stats[0]), classes)


def _linear(m, features: list[str], classes: None) -> Model:
    return LinearRegressor(features, m.coefficients.toArray().tolist(), float(m.intercept))


def _logistic(m, features: list[str], classes: list) -> Model:
    if m.isSet("thresholds") or len(classes) == 2 and m.getThreshold() != 0.5:
        raise TypeError("no description for thresholds of one's own")
    return LinearClassifier(
        features, classes, m.coefficientMatrix.toArray().tolist(), m.interceptVector.toArray().tolist()
    )


def _svc(m, features: list[str], classes: list) -> Model:
    if m.getThreshold() != 0.0:
        raise TypeError("no description for thresholds of one's own")
    return LinearSVC(features, classes, [m.coefficients.toArray().tolist()], [float(m.intercept)])


def _one_vs_rest(m, features: list[str], classes: list) -> Model:
    if any(type(x).__name__ not in ("LinearSVCModel", "LogisticRegressionModel") for x in m.models):
        raise TypeError(f"no description for {type(m.models[0]).__name__} against the rest")
    rows, b = [x.coefficients.toArray().tolist() for x in m.models], [float(x.intercept) for x in m.models]
    if len(rows) == 1 or len(rows) != len(classes):
        raise TypeError("one model is needed for each class")
    return LinearSVC(features, classes, rows, b)


def _naive_bayes(m, features: list[str], classes: list) -> Model:
    if m.getOrDefault("modelType") != "gaussian" or m.isSet("thresholds"):
        raise TypeError("only Gaussian naive Bayes has a description")
    return GaussianNB(
        features, classes, [math.exp(x) for x in m.pi.toArray()], m.theta.toArray().tolist(), m.sigma.toArray().tolist()
    )


def _perceptron(m, features: list[str], classes: list) -> Model:
    sizes, flat, at, W, B = list(m.getOrDefault("layers")), m.weights.toArray(), 0, [], []
    for a, b in zip(sizes, sizes[1:]):  # a layer's weights column by column, then its biases
        W.append(flat[at : at + a * b].reshape(a, b))
        B.append(flat[at + a * b : at + a * b + b])
        at += a * b + b
    return MLP(features, classes, W, B, activation="logistic")


REGRESSORS = {"DecisionTreeRegressionModel": _tree, "LinearRegressionModel": _linear}
CLASSIFIERS = {
    "DecisionTreeClassificationModel": _tree,
    "LogisticRegressionModel": _logistic,
    "LinearSVCModel": _svc,
    "OneVsRestModel": _one_vs_rest,
    "NaiveBayesModel": _naive_bayes,
    "MultilayerPerceptronClassificationModel": _perceptron,
}


def _n_classes(m) -> int:
    return len(m.models) if hasattr(m, "models") else m.numClasses


def from_ml(model, features: Sequence[str], classes: Sequence | None = None) -> Model:
    """A model of this library that predicts what the fitted pyspark.ml model does.

    features are the columns of its feature vector, in order; classes are the values its label indices stand for (else the
    indices themselves, as pyspark.ml predicts them). Models of this library come back as they are.
    """
    if isinstance(model, Model):
        return model
    kind, features = type(model).__name__, list(features)
    if kind in REGRESSORS and type(model).__module__.startswith("pyspark.ml"):
        out = REGRESSORS[kind](model, features, None)
    elif kind in CLASSIFIERS and type(model).__module__.startswith("pyspark.ml"):
        n = _n_classes(model)
        if classes is not None and len(classes) != n:
            raise ValueError(f"the model has {n} classes")
        out = CLASSIFIERS[kind](model, features, [float(k) for k in range(n)] if classes is None else list(classes))
    else:
        raise TypeError(f"no description for {kind}; there are {', '.join([*REGRESSORS, *CLASSIFIERS])}")
    width = getattr(model, "numFeatures", len(features))
    if width not in (-1, len(features)):
        raise ValueError(f"the model has {width} features")
    return out


def fit_ml(estimator, rows: DataFrame, features: Sequence[str], classes: Sequence | None = None) -> Model:
    """from_ml() of an unfitted pyspark.ml estimator, fitted on rows (features vector, label index)."""
    name = type(estimator).__name__
    if f"{name}Model" not in REGRESSORS | CLASSIFIERS and name.replace(
        "Classifier", "ClassificationModel"
    ).replace("Regressor", "RegressionModel") not in REGRESSORS | CLASSIFIERS:
        raise TypeError(f"no description for {name}")
    return from_ml(
        estimator.fit(rows, {estimator.featuresCol: "features", estimator.labelCol: "label"}), features, classes
    )


def components_model(
    metric,
    model,
    df: DataFrame | None = None,
    *,
    features: Sequence[str] | None = None,
    classes: Sequence | None = None,
) -> dict[str, float]:
    """The four components of a model, for a fitted CombinedScore; features are the model's own, by default all of the metric's."""
    own = from_ml(model, features or metric.features, classes)
    a = artifacts(own, metric.features, "_prediction")
    rows = own.transform(metric.df if df is None else df, a.predictions)
    return metric.from_inaccuracy(
        a.subset, metric.inaccuracy.inaccuracy_predictions(rows, a.predictions), a.model_string, as_mask=False
    )


def combined_model(metric, model, df: DataFrame | None = None, **options) -> float:
    return metric.total(components_model(metric, model, df, **options))


def score_model(metric, model, df: DataFrame | None = None, **options) -> float:
    return 1 - combined_model(metric, model, df, **options)


def explain_model(metric, model, df: DataFrame | None = None, **options) -> dict:
    return metric.explain_components(components_model(metric, model, df, **options))
