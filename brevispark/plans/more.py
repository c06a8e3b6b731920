"""Further queries over the driver's tables: refusals, texts, components, searches, refits. more_oracle.py holds their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevispark.functions.text import class_token, feature_token, fixed_number, sci_number
from brevispark.operators import timeseries as ts
from brevispark.operators.anomalies import AnomalyDetector
from brevispark.operators.automl import Classifier, Regressor, gaussian_moments
from brevispark.operators.codelength import code_length_from_counts, empirical_distribution, encode
from brevispark.operators.combined import CombinedScore, resolve_weights
from brevispark.operators.inaccuracy import Inaccuracy, inaccuracy_score
from brevispark.operators.miscoding import Miscoding, feature_mask
from brevispark.operators.models import MLP, DecisionTree, GaussianNB, LinearClassifier, LinearRegressor, LinearSVC, LinearSVR, TreeNode, artifacts, gram, solve_ols
from brevispark.operators.surfeit import Surfeit, surfeit_score
from brevispark.plans import queries as q
from brevispark.plans.more_oracle import DESCRIPTION
from brevispark.plans.oracle import LINE, LINE_Y
from brevispark.sources.tables import table


def _refused(f: Callable[[], object]) -> bool:
    try:
        f()
    except (ValueError, TypeError, KeyError):
        return True
    return False


def refusals(spark: SparkSession, d: str) -> DataFrame:
    """Which inputs are refused; missing values are those of the tables."""
    nation, docs = table(spark, d, "nation"), table(spark, d, "documents")
    odd = nation.withColumn(
        "x", F.when(F.col("n_nationkey") == 3, float("inf")).otherwise(F.col("n_nationkey").cast("double"))
    )
    odd = odd.withColumn("list", F.array("n_nationkey")).withColumn(
        "text", F.concat(F.lit("v"), F.col("n_nationkey").cast("string"))
    )
    fit = lambda df, cols, y="n_regionkey", kind="auto": Miscoding(kind, "categorical").fit(df, cols, y)
    good = fit(nation, ["n_nationkey", "n_regionkey"])
    series = lambda df: ts.TimeSeries(window_size=2, models=["moving_average"]).fit(df, "x", ["n_nationkey"])
    detector = q._detector(spark, d, "residual_quantile")
    cases = {
        "documents_lang_as_feature": lambda: encode(docs, ["lang"], [False], cache=False),
        "documents_n_chars_as_feature": lambda: encode(docs, ["n_chars"], [True], cache=False),
        "infinite_feature": lambda: fit(odd, ["x"]),
        "letters_as_numbers": lambda: fit(odd, ["text"], kind="numeric"),
        "nested_feature": lambda: fit(odd, ["list"]),
        "unknown_feature": lambda: fit(nation, ["nothing"]),
        "no_feature_column": lambda: encode(nation, [], []),
        "flags_of_other_length": lambda: encode(nation, ["n_nationkey"], [True, True]),
        "empty_table": lambda: fit(nation.limit(0), ["n_nationkey"]),
        "plain_table": lambda: fit(nation, ["n_nationkey"]),
        "repeated_feature": lambda: fit(nation, ["n_nationkey", "n_nationkey"]),
        "unknown_type": lambda: fit(nation, ["n_nationkey"], kind="ordinal"),
        "subset_index_out_of_range": lambda: good.subset_analysis([2], as_mask=False),
        "subset_index_repeats": lambda: good.subset_analysis([1, 1], as_mask=False),
        "subset_of_names": lambda: good.subset_analysis(["n_nationkey"]),
        "subset_as_mask": lambda: good.subset_analysis([0, 1], as_mask=True),
        "negative_min_improvement": lambda: Miscoding(min_improvement=-1.0),
        "max_features_of_zero": lambda: good.select_features(max_features=0),
        "unknown_mode": lambda: good.miscoding_subset([0], "other"),
        "mask_out_of_range": lambda: feature_mask([3], 2),
        "negative_counts": lambda: code_length_from_counts([1, -1]),
        "counts_of_zero": lambda: code_length_from_counts([0, 0]),
        "counts": lambda: code_length_from_counts([1, 0, 2]),
        "bins_of_zero": lambda: fit(nation, ["n_nationkey"]) and encode(nation, ["n_nationkey"], [True], 0, cache=False),
        "predictions_with_gaps": lambda: inaccuracy_score(odd.withColumn("p", F.when(F.col("n_nationkey") > 1, 1.0)), "n_nationkey", "p", y_type="numeric"),
        "weights_of_zero": lambda: resolve_weights([0, 0, 0, 0]),
        "weights_of_unknown_component": lambda: resolve_weights({"other": 1.0}),
        "weights_of_one_component": lambda: resolve_weights({"surfeit": 2.0}),
        "unknown_aggregation": lambda: CombinedScore(aggregation="median"),
        "negative_threshold_fraction": lambda: CombinedScore(threshold_fraction=-0.1),
        "negative_surplus_penalty": lambda: CombinedScore(surplus_penalty=-1.0),
        "zlib_level_of_ten": lambda: CombinedScore(zlib_level=10),
        "empty_description": lambda: surfeit_score("", nation, "n_regionkey", y_type="categorical"),
        "family_as_string": lambda: Classifier("naive_bayes"),
        "unknown_family": lambda: Regressor(["logistic_regression"]),
        "one_class": lambda: Classifier(["naive_bayes"]).fit(nation.withColumn("y", F.lit(1)), ["n_nationkey"], "y"),
        "series_with_infinity": lambda: series(odd),
        "series_of_two_rows": lambda: series(nation.where("n_nationkey < 2").withColumn("x", F.col("n_nationkey"))),
        "series": lambda: series(nation.withColumn("x", F.col("n_nationkey"))),
        "window_as_long_as_the_series": lambda: ts.window_size(5, 5),
        "alpha_of_one": lambda: ts.TimeSeries(smoothing_alphas=(1.0,)),
        "unknown_anomaly_rule": lambda: AnomalyDetector(anomaly_rule="other"),
        "rule_of_other_task": lambda: AnomalyDetector("regression", anomaly_rule="misclassification"),
        "quantile_of_one": lambda: AnomalyDetector(anomaly_quantile=1.0),
        "kind_of_other_task": lambda: detector.anomalies("misclassified"),
        "unknown_attribute": lambda: detector.group_points("nothing"),
        "attribute_out_of_range": lambda: detector.group_points(7),
    }
    return spark.createDataFrame([(name, _refused(f)) for name, f in cases.items()], "input string, refused boolean")


def numeric_text(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in text columns, with signs, fractions and exponents."""
    price, part = F.col("l_extendedprice") / F.lit(-1000.0), F.col("l_discount") * F.lit(0.0001)
    df = q._line(spark, d).select(price.cast("string").alias("t_price"), part.cast("string").alias("t_part"), LINE_Y)
    return q.r6(Miscoding("numeric").fit(df, ["t_price", "t_part"], LINE_Y).feature_analysis())


def formats(spark: SparkSession, d: str) -> DataFrame:
    rows = q._line(spark, d).groupBy(LINE_Y, "l_linestatus").agg(
        F.avg("l_extendedprice").alias("a"), F.avg("l_discount").alias("b"), F.count("*").alias("n")
    ).collect()
    out = [
        (
            r[0],
            r[1],
            sci_number(r["a"]),
            sci_number(-r["b"]),
            fixed_number(r["b"], 4),
            fixed_number(r["n"]),
            sci_number(0.0),
            f"{feature_token(r['n'])} {class_token(0)}",
        )
        for r in rows
    ]
    return spark.createDataFrame(
        out,
        f"{LINE_Y} string, l_linestatus string, sci_price string, sci_discount string, fixed_discount string, fixed_n string, sci_zero string, tokens string",
    )


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of models: two learned from the table, the others of given parameters."""
    line, x = q._line(spark, d), ["l_quantity", "l_tax"]
    w, b = solve_ols(gram(line, ["l_quantity"], "l_extendedprice"), 1)
    rows = gaussian_moments(line, ["l_quantity"], LINE_Y).collect()
    n = sum(r["n"] for r in rows)
    bayes = GaussianNB(
        ["l_quantity"],
        [r["class"] for r in rows],
        [r["n"] / n for r in rows],
        [[r["mean_0"]] for r in rows],
        [[r["var_0"]] for r in rows],
    )
    leaf = lambda v: TreeNode(v, 1.0, 0.0)
    tree = TreeNode(2.0, 2.0, 0.0, 0, 25.5, leaf(1.0), TreeNode(3.0, 1.0, 0.0, 1, 0.04, leaf(2.5), leaf(-30.0)))
    models = {
        "ols": LinearRegressor(["l_quantity"], w, b),
        "naive_bayes": bayes,
        "linear": LinearRegressor(x, [-0.5, 0.0], 12.0),
        "svr": LinearSVR(x, [1.5, -2.0], 0.25),
        "logistic_two": LinearClassifier(x, ["A", "B"], [[1.0, -0.125]], [3.0]),
        "logistic_three": LinearClassifier(x, ["A", "B", "C"], [[1.0, 0.0], [0.0, 2.0], [0.0, 0.0]], [0.0, 1.0, -1.0]),
        "svc": LinearSVC(x, ["A", "B"], [[0.0, 4.0]], [0.0]),
        "tree": DecisionTree(x, tree, None),
        "mlp": MLP(
            x,
            None,
            [np.array([[1.0, 2.0], [0.5, 0.0]]), np.array([[1.0], [-1.0]])],
            [np.array([0.0, 1.0]), np.array([2.0])],
            [1.0, 2.0],
            [4.0, 1.0],
        ),
    }
    out = []
    for name, m in models.items():
        a = artifacts(m, m.features)
        out.append((name, a.model_string, ",".join(map(str, a.subset)), type(m).__name__))
    return spark.createDataFrame(out, "model string, text string, subset string, model_type string")


def components(spark: SparkSession, d: str) -> DataFrame:
    """The four components and the score of predictions for the region of a nation, for each single feature."""
    df = table(spark, d, "nation").withColumn("length", F.length("n_name")).withColumn("p", F.col("n_nationkey") % 5)
    score = CombinedScore("numeric", "categorical").fit(df, ["n_nationkey", "length"], "n_regionkey")
    out = []
    for k in (0, 1):
        e = score.explain([k], "p", DESCRIPTION)
        out.append(
            (
                k,
                *[e["components"][c] for c in ("deficiency", "surplus", "inaccuracy", "surfeit")],
                e["combined"],
                score.score([k], "p", DESCRIPTION),
                e["dominant_component"],
                e["profile"],
            )
        )
    return q.r6(
        spark.createDataFrame(
            out,
            "feature int, deficiency double, surplus double, inaccuracy double, surfeit double, combined double, score double, dominant string, profile string",
        )
    )


def description_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Raw length of descriptions and their surfeit where the target's code is shorter than any compressed text."""
    names = [r["n_name"] for r in table(spark, d, "nation").select("n_name").collect()]
    s = Surfeit("categorical").fit_y(table(spark, d, "region"), "r_regionkey")
    out = [(x, s.description_lengths(x + DESCRIPTION)[0], s.surfeit_string(x + DESCRIPTION)) for x in names]
    return q.r6(spark.createDataFrame(out, "n_name string, length long, surfeit double"))


def model_inaccuracy(spark: SparkSession, d: str) -> DataFrame:
    m = LinearRegressor(["l_quantity"], [1000.0], 50.0)
    fit = Inaccuracy("numeric").fit_y(q._line(spark, d), "l_extendedprice")
    return q.r6(
        spark.createDataFrame(
            [(fit.inaccuracy_model(m), fit.score(m), fit.y_length)], "inaccuracy double, score double, y_length double"
        )
    )


def feature_order(spark: SparkSession, d: str) -> DataFrame:
    fit = q._fit_line(spark, d)
    mask = feature_mask(fit.select_features(), len(LINE))
    return spark.createDataFrame(
        [(k, j, LINE[j], mask[j]) for k, j in enumerate(fit.feature_order())],
        "place int, feature_index int, feature_name string, selected int",
    )


def series_windows(spark: SparkSession, d: str) -> DataFrame:
    w = ts.window_size(table(spark, d, "events").count())
    rows = [(w, ts.window_size(10, 3), m["source"], m["attribute"], m["lag"]) for m in ts.lag_metadata(3, ["k"])]
    return spark.createDataFrame(rows, "auto_window int, window int, source string, attribute string, lag int")


def _search_rows(spark: SparkSession, fit) -> DataFrame:
    cols = [
        "candidate",
        "family",
        "model_type",
        "native_estimator_score",
        "inaccuracy",
        "deficiency",
        "surplus",
        "n_selected_features",
    ]
    return q.r6(fit.results_dataframe().select(*cols))


def bayes_search(spark: SparkSession, d: str) -> DataFrame:
    return _search_rows(spark, Classifier(["naive_bayes"]).fit(q._line(spark, d), ["l_quantity"], LINE_Y))


def linear_search(spark: SparkSession, d: str) -> DataFrame:
    return _search_rows(
        spark, Regressor(["linear_regression"]).fit(q._line(spark, d), ["l_quantity"], "l_extendedprice")
    )


def stump_search(spark: SparkSession, d: str) -> DataFrame:
    fit = Regressor(
        ["decision_tree"], options={"decision_tree": {"max_depth": 1}}
    ).fit(q._line(spark, d), ["l_quantity"], "l_extendedprice")
    return _search_rows(spark, fit)


def search_notes(spark: SparkSession, d: str) -> DataFrame:
    """A search goes on without the candidates that cannot be fitted, and says which."""
    options = {"linear_svr": {"C_values": (0.0, 1.0), "epsilons": (0.1,)}}
    fit = Regressor(
        ["linear_svr", "linear_regression"], options=options
    ).fit(q._line(spark, d), ["l_quantity"], "l_extendedprice")
    notes = fit.diagnostics_dataframe().select("family", "reason", F.col("details")["candidate"].alias("candidate"))
    left = fit.results_dataframe().select("family", F.lit("evaluated").alias("reason"), "candidate")
    return notes.unionByName(left)


def by_model(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a given model misclassifies."""
    line = q._line(spark, d).withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    m = LinearClassifier(["l_quantity"], ["F", "O"], [[1.0]], [-25.0])
    found = AnomalyDetector("classification").fit(line, ["l_quantity"], "l_linestatus", "row_id", model=m)
    return found.anomaly_table().select("sample_index", "y_true", "y_pred", "anomaly_score", "anomaly_kind")


def points(spark: SparkSession, d: str) -> DataFrame:
    found = q._detector(spark, d, "residual_quantile").group_points("l_quantity")
    return q.r6(found.select("sample_index", "cluster", "anomaly_score", "l_quantity"))


def no_groups(spark: SparkSession, d: str) -> DataFrame:
    """Without two anomalies there is no view: an empty table of the usual columns."""
    return q._detector(spark, d, "standardized_residual", z_score_threshold=1e9).group_anomalies()


def autoregression(spark: SparkSession, d: str) -> DataFrame:
    fit = ts.TimeSeries(window_size=1, models=["autoregressive"]).fit(q._events(spark, d), "y", q.ORDER)
    m, r, e = fit.get_model(), fit.get_model().results, fit.explain()
    row = (
        m.name,
        m.weights[0],
        m.intercept,
        r["estimator_score"],
        fit.score(fit.df),
        r["deficiency"],
        r["surplus"],
        r["inaccuracy"],
        fit.model_string(),
        e["selected_lags"][0]["feature_name"],
        e["selected_lags"][0]["lag"],
    )
    schema = "model string, weight double, intercept double, estimator_score double, score double, deficiency double, surplus double, inaccuracy double, text string, lag_name string, lag int"
    return q.r6(spark.createDataFrame([row], schema))


def refits(spark: SparkSession, d: str) -> DataFrame:
    return q.r6(ts.rolling_autoregression(q._events(spark, d), "y", q.ORDER, 1000, 500), 5)


def state_summary(spark: SparkSession, d: str) -> DataFrame:
    s = empirical_distribution(table(spark, d, "orders"), ["o_totalprice", "o_orderstatus"], [True, False], 8)
    return q.r6(s.states)


QUERIES = {
    "refused_inputs": refusals,
    "feature_analysis_numeric_text": numeric_text,
    "number_formats": formats,
    "model_texts": texts,
    "components_nation": components,
    "description_lengths_nation": description_lengths,
    "inaccuracy_of_model": model_inaccuracy,
    "feature_order_lineitem": feature_order,
    "series_windows_and_lags": series_windows,
    "naive_bayes_search": bayes_search,
    "linear_regression_search": linear_search,
    "decision_stump_search": stump_search,
    "search_diagnostics": search_notes,
    "anomaly_by_model": by_model,
    "anomaly_group_points": points,
    "anomaly_no_groups": no_groups,
    "anomaly_group_views_2d": lambda s, d: q.r6(
        q._detector(s, d, "residual_quantile").group_anomalies(
            dimensions=2, filter_redundant=False, filter_balanced=False, filter_repeated_attributes=False
        ),
        3,
    ),
    "ts_autoregressive_lag_1": autoregression,
    "rolling_autoregression": refits,
    "empirical_states_orders": state_summary,
}
