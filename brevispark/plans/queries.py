"""The library's queries over the driver's tables; oracle.py holds their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevispark.functions.binning import bin_of, rice_bins
from brevispark.operators import timeseries as ts
from brevispark.operators.anomalies import AnomalyDetector, two_means_1d
from brevispark.operators.automl import Classifier, Regressor, gaussian_moments
from brevispark.operators.codelength import code_lengths, empirical_distribution, encode
from brevispark.operators.combined import COMPONENTS, MODES, aggregate, dominant, pareto, profile
from brevispark.operators.inaccuracy import inaccuracy_of_candidates
from brevispark.operators.miscoding import Miscoding
from brevispark.operators.models import GaussianNB, gram, solve_ols
from brevispark.operators.surfeit import surfeit_from_lengths, zlib_length
from brevispark.plans.oracle import CANDIDATES, LINE, LINE_CAT, LINE_NUM, LINE_Y, _tables
from brevispark.sources.tables import table
from brevispark.streaming.code_length import code_length, joint_counts


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


def _lengths(spark: SparkSession, d: str, sets: list[list[str]]):
    e = encode(_line(spark, d), [*LINE, LINE_Y], [*[True] * len(LINE_NUM), *[False] * len(LINE_CAT), False])
    out = code_lengths(e, sets)
    e.close()
    return e.n, out


def _fit_line(spark: SparkSession, d: str) -> Miscoding:
    return Miscoding().fit(_line(spark, d), LINE, LINE_Y)


def rice(spark: SparkSession, d: str) -> DataFrame:
    rows = [(t, n, rice_bins("auto", n)) for t in _tables for n in [table(spark, d, t).count()]]
    return spark.createDataFrame(rows, "table_name string, n long, bins int")


def discretize(spark: SparkSession, d: str) -> DataFrame:
    e = encode(_line(spark, d), ["l_extendedprice"], [True], cache=False)
    return e.frame.groupBy(F.col("l_extendedprice").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def entropies(spark: SparkSession, d: str) -> DataFrame:
    n, got = _lengths(spark, d, [[c] for c in [*LINE, LINE_Y]])
    return r6(
        spark.createDataFrame(
            [(c, got[frozenset([c])][0] / n, *got[frozenset([c])]) for c in [*LINE, LINE_Y]],
            "feature_name string, entropy double, code_length double, n_states long",
        )
    )


def joint(spark: SparkSession, d: str) -> DataFrame:
    s = empirical_distribution(_line(spark, d), ["l_extendedprice", LINE_Y], [True, False])
    return r6(
        spark.createDataFrame(
            [(s.code_length, s.entropy, s.n_samples, s.n_states)],
            "code_length double, entropy double, n_samples long, n_states long",
        )
    )


def conditional(spark: SparkSession, d: str) -> DataFrame:
    _, got = _lengths(spark, d, [[LINE_Y], *[[f] for f in LINE], *[[f, LINE_Y] for f in LINE]])
    k = lambda *c: got[frozenset(c)][0]
    return r6(
        spark.createDataFrame(
            [(f, max(0.0, k(f, LINE_Y) - k(f)), max(0.0, k(f, LINE_Y) - k(LINE_Y))) for f in LINE],
            "feature_name string, target_given_feature double, feature_given_target double",
        )
    )


def subsets(spark: SparkSession, d: str) -> DataFrame:
    m = _fit_line(spark, d)
    rows = [
        (",".join(map(str, s)), x["deficiency"], x["surplus"], x["miscoding"])
        for s in ([0], [0, 1], [0, 1, 2, 3], [1, 4])
        for x in [m.measures(s)]
    ]
    return r6(spark.createDataFrame(rows, "subset string, deficiency double, surplus double, miscoding double"))


def documents_analysis(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source").join(
        table(spark, d, "labels").select("doc_id", "quality"), "doc_id"
    )
    return r6(Miscoding(y_type="categorical").fit(docs, ["n_chars", "lang", "source"], "quality").feature_analysis())


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return _line(spark, d).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
        "l_quantity",
        "l_discount",
        "l_tax",
        F.col("l_extendedprice").alias("y"),
        (1000.0 * F.col("l_quantity") + 50.0 * F.col("l_discount")).alias("p"),
    )


def inaccuracies(spark: SparkSession, d: str, which: dict[str, str]) -> DataFrame:
    df = _line(spark, d).select(F.col("l_extendedprice").alias("y"), *[F.expr(x).alias(c) for c, x in which.items()])
    return r6(inaccuracy_of_candidates(df, "y", list(which), y_type="numeric"))


def surfeit_lengths(spark: SparkSession, d: str) -> DataFrame:
    _, got = _lengths(spark, d, [[LINE_Y]])
    v = spark.range(10, 400_000, 9973).select(
        F.col("id").alias("length"), (F.floor(F.col("id") / 2) + 20).alias("compressed")
    )
    return r6(
        v.withColumn(
            "surfeit", surfeit_from_lengths(F.col("length"), F.col("compressed"), F.lit(got[frozenset([LINE_Y])][0]))
        )
    )


def surfeit_documents(spark: SparkSession, d: str) -> DataFrame:
    """Surfeit of every document text, against the code length of the quality labels."""
    k = empirical_distribution(table(spark, d, "labels"), ["quality"], [False]).code_length
    docs = table(spark, d, "documents").select(
        "doc_id", F.octet_length("text").alias("length"), zlib_length("text").alias("compressed")
    )
    return docs.withColumn("surfeit", surfeit_from_lengths(F.col("length"), F.col("compressed"), F.lit(k)))


def _grid(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(625).select(
        "id", *[((F.floor(i / x) % 5) / 4.0).alias(c) for c, x in zip(COMPONENTS, (1, 5, 25, 125))]
    )


def modes(spark: SparkSession, d: str) -> DataFrame:
    return r6(
        _grid(spark).select(
            "id", *[aggregate([F.col(c) for c in COMPONENTS], m, (1.0, 2.0, 1.0, 0.5)).alias(m) for m in MODES]
        )
    )


def profiles(spark: SparkSession, d: str) -> DataFrame:
    cols = [F.col(c) for c in COMPONENTS]
    return _grid(spark).select("id", profile(*cols).alias("profile"), dominant(*cols).alias("dominant"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "ts",
        "event_id",
        F.col("value").alias("y"),
        F.regexp_extract("props", r'"k": *(-?[0-9.]+)', 1).cast("double").alias("k"),
    )


ORDER = ["ts", "event_id"]


def lag_matrix(spark: SparkSession, d: str) -> DataFrame:
    return r6(
        ts.lag_matrix(
            _events(spark, d), "y", 4, ORDER, exogenous=["k"]
        ).select("event_id", "y", *ts.lag_names(4, ["k"]))
    )


def forecast_of(spark: SparkSession, d: str, weights: list[float]) -> DataFrame:
    lags = ts.lag_matrix(_events(spark, d), "y", len(weights), ORDER)
    return r6(lags.select("event_id", ts.weighted(ts.lag_names(len(weights)), weights).alias("prediction")))


def _series(spark: SparkSession, d: str, **options) -> ts.TimeSeries:
    s = ts.TimeSeries(window_size=3, **options)
    s.df, s.y, s.order_by, s.exogenous, s.w = _events(spark, d), "y", ORDER, ["k"], 3
    s.n = s.df.count()
    return s


def candidates_of_series(spark: SparkSession, d: str) -> DataFrame:
    return ts.TimeSeries(window_size=3).fit(_events(spark, d), "y", ORDER, ["k"]).results_dataframe()


def fixed_candidates_of_series(spark: SparkSession, d: str) -> DataFrame:
    fit = ts.TimeSeries(
        window_size=3, models=["moving_average", "exponential_smoothing"]
    ).fit(_events(spark, d), "y", ORDER)
    return r6(fit.results_dataframe().select(F.col("model_name").alias("candidate"), "inaccuracy", "estimator_score"))


def recursive_forecast(spark: SparkSession, d: str) -> DataFrame:
    s = ts.TimeSeries(
        window_size=4, models=["moving_average"], moving_average_windows=[4]
    ).fit(_events(spark, d), "y", ORDER)
    return r6(spark.createDataFrame(list(enumerate(s.forecast(5), 1)), "step int, forecast double"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    df = _events(spark, d)
    lo, hi = df.agg(F.min("y"), F.max("y")).first()
    s = ts.rolling_segments(df, ORDER, 1000, 500)
    counts = s.groupBy("segment", bin_of(F.col("y"), lo, hi, 8).alias("state")).count()
    return r6(code_length(counts, ["segment"]).drop("n"))


def _detector(spark: SparkSession, d: str, rule: str, **options) -> AnomalyDetector:
    return AnomalyDetector("regression", y_type="numeric", anomaly_rule=rule, **options).fit(
        _predicted(spark, d), ["l_quantity", "l_discount", "l_tax"], "y", "row_id", prediction="p"
    )


def residual_rule(spark: SparkSession, d: str, rule: str, **options) -> DataFrame:
    return r6(_detector(spark, d, rule, **options).anomaly_table().select("sample_index", "anomaly_score", "direction"))


def misclassification(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderstatus").alias("y"),
        F.when(F.col("o_totalprice") > 250000, "O").otherwise("F").alias("p"),
        "o_totalprice",
    )
    return AnomalyDetector("classification").fit(
        df, ["o_totalprice"], "y", "row_id", prediction="p"
    ).anomaly_table().select("sample_index", "y_true", "y_pred")


def probability_quantile(spark: SparkSession, d: str) -> DataFrame:
    """Probability of the observed class from shares within each priority."""
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("y"), F.col("o_orderpriority").alias("g")
    )
    cells = o.groupBy("g", "y").agg(F.count(F.lit(1)).alias("c"))
    share = cells.join(
        cells.groupBy("g").agg(F.sum("c").alias("s")), "g"
    ).select("g", "y", (F.col("c") / F.col("s")).alias("q"))
    df = o.join(share, ["g", "y"]).withColumn("p", F.lit("F"))
    found = AnomalyDetector(
        "classification", anomaly_rule="probability_quantile", anomaly_quantile=0.9
    ).fit(df, ["g"], "y", "row_id", prediction="p", probability="q")
    return r6(found.anomaly_table().select("sample_index", "anomaly_score"))


def summary(spark: SparkSession, d: str) -> DataFrame:
    s = _detector(spark, d, "residual_quantile").summary()
    names = [
        "n_samples",
        "n_anomalies",
        "mean_absolute_residual",
        "median_absolute_residual",
        "n_under_predicted",
        "n_over_predicted",
        "threshold",
    ]
    return r6(
        spark.createDataFrame(
            [tuple(s[c] for c in names)],
            "n_samples long, n_anomalies long, mean_absolute_residual double, median_absolute_residual double, n_under_predicted long, n_over_predicted long, threshold double",
        ),
        4,
    )


def two_means(spark: SparkSession, d: str) -> DataFrame:
    out = two_means_1d(_detector(spark, d, "residual_quantile")._views("all"), "attribute", "value")
    return out.select(
        "attribute",
        F.round("cut", 6).alias("cut"),
        F.round("inertia", 4).alias("inertia"),
        "cluster_0_size",
        "cluster_1_size",
    )


def ols(spark: SparkSession, d: str) -> DataFrame:
    w, b = solve_ols(gram(_line(spark, d), ["l_quantity"], "l_extendedprice"), 1)
    return r6(spark.createDataFrame([(w[0], b)], "slope double, intercept double"), 4)


def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    g = gram(_line(spark, d), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return r6(
        spark.createDataFrame(
            [(i, j, float(v / g[0, 0])) for i, row in enumerate(g) for j, v in enumerate(row)], "i int, j int, v double"
        ),
        2,
    )


NB = ["l_quantity", "l_extendedprice"]


def gnb_moments(spark: SparkSession, d: str) -> DataFrame:
    m = gaussian_moments(_line(spark, d), NB, LINE_Y)
    return m.select(
        "class", "n", *[F.round(c, k).alias(c) for c, k in (("mean_0", 4), ("var_0", 4), ("mean_1", 4), ("var_1", 1))]
    )


def gnb_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = gaussian_moments(_line(spark, d), NB, LINE_Y).collect()
    n = sum(r["n"] for r in rows)
    m = GaussianNB(
        NB,
        [r["class"] for r in rows],
        [r["n"] / n for r in rows],
        [[r["mean_0"], r["mean_1"]] for r in rows],
        [[r["var_0"], r["var_1"]] for r in rows],
    )
    return r6(
        m.transform(_line(spark, d)).agg(F.avg((F.col("prediction") == F.col(LINE_Y)).cast("double")).alias("accuracy"))
    )


def automl_classifier(spark: SparkSession, d: str) -> DataFrame:
    return Classifier().fit(
        table(spark, d, "orders").withColumn("month", F.month("o_orderdate").cast("double")),
        ["o_totalprice", "month"],
        "o_orderstatus",
    ).results_dataframe()


def automl_regressor(spark: SparkSession, d: str) -> DataFrame:
    return Regressor().fit(
        _line(spark, d), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"
    ).results_dataframe()


def windowed(spark: SparkSession, d: str) -> DataFrame:
    counts = joint_counts(table(spark, d, "events"), ["event_type"], {}, time="ts", size="1 day")
    return r6(code_length(counts.withColumn("day", F.date_format("window.start", "yyyy-MM-dd")), ["day"]))


def greedy_path(spark: SparkSession, d: str) -> DataFrame:
    path = _fit_line(spark, d).select_features(min_improvement=-1.0, return_details=True)[1]
    names = ("selected_feature_indices", "selected_feature_names")
    return r6(path.withColumns({c: F.concat_ws(",", F.col(c).cast("array<string>")) for c in names}))


QUERIES = {
    "feature_analysis_lineitem": lambda s, d: r6(_fit_line(s, d).feature_analysis()),
    "rice_bins": rice,
    "discretize_extendedprice": discretize,
    "empirical_states_flag_status": lambda s, d: r6(
        empirical_distribution(_line(s, d), [LINE_Y, "l_linestatus"], [False, False]).states
    ),
    "entropy_code_length_by_column": entropies,
    "joint_code_length_price_flag": joint,
    "conditional_code_lengths": conditional,
    "feature_analysis_numeric_target": lambda s, d: r6(
        Miscoding().fit(
            _line(s, d), ["l_quantity", "l_discount", "l_tax", "l_linestatus"], "l_extendedprice"
        ).feature_analysis()
    ),
    "feature_redundancy_lineitem": lambda s, d: r6(_fit_line(s, d).feature_redundancy()),
    "subset_measures_lineitem": subsets,
    "greedy_selection_path": greedy_path,
    "greedy_first_step": lambda s, d: r6(
        _fit_line(s, d).feature_analysis().orderBy(
            "miscoding", "deficiency", "surplus", "feature_index"
        ).limit(1).select(
            "feature_index", "feature_name", "deficiency", "surplus", "miscoding"
        )
    ),
    "feature_analysis_documents": documents_analysis,
    "feature_analysis_orders": lambda s, d: r6(
        Miscoding().fit(table(s, d, "orders"), ["o_totalprice", "o_orderpriority"], "o_orderstatus").feature_analysis()
    ),
    "inaccuracy_rule": lambda s, d: inaccuracies(s, d, {"p": "1000.0D * l_quantity + 50.0D * l_discount"}),
    "inaccuracy_constant_prediction": lambda s, d: inaccuracies(s, d, {"p": "1.0D"}),
    "inaccuracy_batch_candidates": lambda s, d: inaccuracies(
        s, d, {c: x.replace("1000.0", "1000.0D").replace("(1.0 -", "(1.0D -") for c, x in CANDIDATES.items()}
    ),
    "surfeit_from_lengths": surfeit_lengths,
    "surfeit_documents": surfeit_documents,
    "aggregate_components_all_modes": modes,
    "profiles_and_dominant": profiles,
    "pareto_candidates": lambda s, d: pareto(
        _grid(s).where("deficiency + surplus + inaccuracy + surfeit >= 1.5"), "id"
    ).select("id"),
    "lag_matrix_events": lag_matrix,
    "moving_average_forecast": lambda s, d: forecast_of(s, d, ts.moving_average_weights(4)),
    "exp_smoothing_forecast": lambda s, d: forecast_of(s, d, ts.exponential_smoothing_weights(4, 0.3)),
    "auto_lag_analysis_events": lambda s, d: r6(_series(s, d).auto_lag_analysis()),
    "cross_lag_analysis_events": lambda s, d: r6(_series(s, d).cross_lag_analysis("k")),
    "lag_analysis_union": lambda s, d: r6(_series(s, d).lag_analysis(2)),
    "ts_candidate_scores": candidates_of_series,
    "ts_fixed_candidate_scores": fixed_candidates_of_series,
    "recursive_forecast_ma": recursive_forecast,
    "rolling_segments_code_length": segments,
    "anomaly_residual_quantile": lambda s, d: residual_rule(s, d, "residual_quantile"),
    "anomaly_standardized_residual": lambda s, d: residual_rule(s, d, "standardized_residual", z_score_threshold=2.0),
    "anomaly_bin_mismatch": lambda s, d: residual_rule(s, d, "bin_mismatch").drop("direction"),
    "anomaly_misclassification": misclassification,
    "anomaly_probability_quantile": probability_quantile,
    "anomaly_summary": summary,
    "anomaly_by_kind": lambda s, d: _detector(s, d, "residual_quantile").anomalies("under_predicted"),
    "anomaly_two_means_1d": two_means,
    "anomaly_group_views": lambda s, d: r6(
        _detector(s, d, "residual_quantile").group_anomalies(filter_redundant=False), 4
    ),
    "anomaly_groups": lambda s, d: r6(_detector(s, d, "residual_quantile").group_anomalies(), 4),
    "ols_single_feature": ols,
    "ols_gram_matrix": gram_matrix,
    "gnb_moments": gnb_moments,
    "gnb_scores_accuracy": gnb_accuracy,
    "automl_classifier_results": automl_classifier,
    "automl_regressor_results": automl_regressor,
    "windowed_code_length": windowed,
}
