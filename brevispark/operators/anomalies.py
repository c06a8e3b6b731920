"""Anomalies relative to a model: rules, tables, summaries, and grouping of anomalies by two-means views."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevispark.functions.binning import bin_of, rice_bins
from brevispark.operators.codelength import profile
from brevispark.operators.miscoding import Miscoding
from brevispark.operators.models import Model
from brevispark.operators.order import prefix_sums, quantile
from brevispark.sources.shared import cut
from brevispark.sources.tables import as_number, resolve_numeric, resolve_target

RULES = {
    "classification": ("misclassification", "probability_quantile"),
    "regression": ("residual_quantile", "standardized_residual", "bin_mismatch"),
}
KINDS = ("all", "misclassified", "under_predicted", "over_predicted")
_GROUP = "dimensions int, inertia double, cluster_0_size long, cluster_1_size long, balance double, n_anomalies long"
GROUPS = f"attribute_1 int, attribute_1_name string, {_GROUP}"
GROUPS_2 = f"attribute_1 int, attribute_1_name string, attribute_2 int, attribute_2_name string, {_GROUP}"


def robust_scale(df: DataFrame, column: str) -> float:
    """1.4826 times the median absolute deviation; if that is 0, the population deviation; if that is 0, 1."""
    spread = F.when(F.max(column) > F.min(column), F.stddev_pop(column)).otherwise(0.0)  # exactly 0 for a constant
    r = df.agg(F.count(column).alias("n"), spread.alias("s")).first()
    middle = quantile(df, column, 0.5, r["n"])
    mad = quantile(df.select(F.abs(F.col(column) - F.lit(middle)).alias("d")), "d", 0.5, r["n"])
    return 1.4826 * mad or r["s"] or 1.0


def two_means_1d(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, cut, inertia, cluster_0_size, cluster_1_size): the best split of each group's values in order, exactly.

    Values are standardised within the group (population deviation; a constant stays 0). Sums over sorted prefixes give
    the inertia of every split, so no iteration and no seed are needed. Equal values are never parted. Values are counted
    first and dealt by ranges, so no task holds a group.
    """
    spread = F.when(F.max(value) > F.min(value), F.stddev_pop(value)).otherwise(0.0)  # exactly 0 for a constant
    scale = df.groupBy(group).agg(F.avg(value).alias("_mean"), spread.alias("_scale"))
    counted = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    z = (F.col(value) - F.col("_mean")) / F.when(F.col("_scale") > 0, F.col("_scale")).otherwise(1.0)
    t = counted.join(F.broadcast(scale), group).select(group, F.col(value).alias("v"), z.alias("z"), "c")  # scale: a row a group
    t = t.withColumn("s", F.col("c") * F.col("z")).withColumn("q", F.col("s") * F.col("z"))
    t = cut(prefix_sums(t, group, "v", ["c", "s", "q"]))
    whole = t.groupBy(group).agg(*[F.sum(c).alias(f"all_{c}") for c in "csq"])
    t = t.join(F.broadcast(whole), group)
    n0, n1 = F.col("up_c"), F.col("all_c") - F.col("up_c")
    s0, s1 = F.col("up_s"), F.col("all_s") - F.col("up_s")
    left = F.col("all_q") - s0 * s0 / n0 - F.when(n1 > 0, s1 * s1 / F.when(n1 > 0, n1)).otherwise(0.0)
    inertia = F.greatest(F.lit(0.0), left)
    rank = F.when(n1 > 0, inertia).otherwise(float("inf"))
    key = F.struct(rank.alias("i"), inertia.alias("inertia"), F.col("v").alias("cut"), n0.alias("n0"), n1.alias("n1"))
    best = t.groupBy(group).agg(F.min(key).alias("b"))
    return best.select(
        group, "b.cut", "b.inertia", F.col("b.n0").alias("cluster_0_size"), F.col("b.n1").alias("cluster_1_size")
    )


class AnomalyDetector:
    """fit() takes a table with a prediction column (and, for probability_quantile, a column with the probability of the observed class).

    Without that column the probability comes from the model, which must know every observed class.
    """

    def __init__(
        self,
        task: str = "auto",
        X_type: str = "auto",
        y_type: str = "auto",
        anomaly_rule: str = "auto",
        anomaly_quantile: float = 0.95,
        z_score_threshold: float = 3.0,
        n_bins: int | str = "auto",
        fit_model: bool = False,
        auto_model_kwargs: dict | None = None,
        min_cluster_fraction: float = 0.1,
        redundancy_threshold: float = 0.85,
        random_state: int | None = None,
    ):
        if task not in ("auto", *RULES) or anomaly_rule not in ("auto", *RULES["classification"], *RULES["regression"]):
            raise ValueError("unknown task or rule")
        if task in RULES and anomaly_rule != "auto" and anomaly_rule not in RULES[task]:
            raise ValueError("the rule does not fit the task")
        if not 0 < anomaly_quantile < 1 or z_score_threshold <= 0 or not 0 <= min_cluster_fraction <= 0.5 or not 0 <= redundancy_threshold <= 1:
            raise ValueError("a threshold is out of range")
        self.task, self.X_type, self.y_type = task, X_type, y_type
        self.rule, self.quantile, self.z, self.n_bins = anomaly_rule, anomaly_quantile, z_score_threshold, n_bins
        self.fit_model, self.kwargs, self.seed = fit_model, auto_model_kwargs or {}, random_state or 0
        self.min_fraction, self.max_redundancy = min_cluster_fraction, redundancy_threshold

    def fit(
        self,
        df: DataFrame,
        features: Sequence[str],
        target: str,
        row_id: str,
        *,
        prediction: str | None = None,
        model=None,
        probability: str | None = None,
    ) -> "AnomalyDetector":
        if prediction is not None and model is not None:
            raise ValueError("give predictions or a model, not both")
        self.features, self.target, self.model, self.model_score = list(features), target, model, None
        task = self.task
        if task == "auto":
            task = "regression" if resolve_target(df, target, self.y_type) else "classification"
        if prediction is None:
            prediction = "prediction"
            if model is None:
                from brevispark.operators.automl import Classifier, Regressor

                auto = (Classifier if task == "classification" else Regressor)(**self.kwargs).fit(df, features, target)
                self.model, self.model_score = auto, auto.best_result.combined
            elif self.fit_model and hasattr(model, "fit"):
                self.model = model.copy().fit(df)
            df = self.model.transform(df)
            own = self.model.get_model() if hasattr(self.model, "get_model") else self.model
            if probability is None and self.rule == "probability_quantile" and isinstance(own, Model):
                probability = "_true_class_probability"
                by_class = F.create_map(
                    *[x for c, p in zip(own.classes or [], own.probabilities()) for x in (F.lit(c), p)]
                )
                df = df.withColumn(probability, F.try_element_at(by_class, F.col(target)))
        self.task_, rule = task, self.rule
        if rule == "auto":
            rule = RULES[task][0]
        if rule not in RULES[task]:
            raise ValueError("the rule does not fit the task")
        self.rule_, self.df, self.id = rule, df, row_id
        base = df.select(
            F.col(row_id).alias("sample_index"),
            F.col(target).alias("y_true"),
            F.col(prediction).alias("y_pred"),
            *[F.col(f).alias(f"x_{k}") for k, f in enumerate(self.features)],
            *([F.col(probability).alias("true_class_probability")] if probability else []),
        )
        self.threshold = None
        if task == "classification":
            wrong = F.col("y_true").cast("string") != F.col("y_pred").cast("string")
            base = base.withColumn("correct", ~wrong)
            if rule == "probability_quantile":
                if not probability:
                    raise ValueError("probability_quantile needs the probability of the observed class")
                if base.where(F.col("true_class_probability").isNull()).limit(1).count():
                    raise ValueError("an observed class has no probability")
                base = base.withColumn("anomaly_score", 1 - F.col("true_class_probability"))
                mask = self._quantile(base)
            else:
                base, mask = base.withColumn("anomaly_score", wrong.cast("double")), wrong
            kind = F.when(~mask, "regular").when(wrong, "misclassified").otherwise("low_probability")
        else:
            n, bounds = profile(base, ["y_true", "y_pred"], [True, True])
            r = as_number(base, "y_true") - as_number(base, "y_pred")
            base = base.withColumn("residual", r).withColumn("absolute_residual", F.abs(r))
            scale = robust_scale(base, "residual")
            base = base.withColumn("standardized_residual", F.col("residual") / F.lit(scale))
            direction = F.when(
                F.col("residual") > 0, "under_predicted"
            ).when(F.col("residual") < 0, "over_predicted").otherwise("exact")
            base = base.withColumn("direction", direction)
            if rule == "residual_quantile":
                base = base.withColumn("anomaly_score", F.col("absolute_residual"))
                mask = self._quantile(base)
            elif rule == "standardized_residual":
                base = base.withColumn("anomaly_score", F.abs("standardized_residual"))
                self.threshold, mask = self.z, F.col("anomaly_score") >= self.z
            else:
                bins = rice_bins(self.n_bins, n)
                base = base.withColumn(
                    "anomaly_score",
                    F.abs(
                        bin_of(as_number(base, "y_true"), *bounds["y_true"], bins)
                        - bin_of(as_number(base, "y_pred"), *bounds["y_pred"], bins)
                    ).cast("double"),
                )
                mask = F.col("anomaly_score") > 0
            kind = F.when(~mask, "regular").otherwise(F.col("direction"))
        self.rows = base.withColumn("is_anomaly", mask).withColumn("anomaly_kind", kind)
        return self

    def _quantile(self, df: DataFrame) -> Column:
        self.threshold = quantile(df, "anomaly_score", self.quantile)
        return F.col("anomaly_score") >= F.lit(self.threshold)

    def _of_kind(self, kind: str) -> Column:
        if kind not in KINDS or (kind == "misclassified") > (
            self.task_ == "classification"
        ) or (kind in KINDS[2:]) > (self.task_ == "regression"):
            raise ValueError("the kind does not fit the task")
        more = {
            "all": F.lit(True),
            "misclassified": ~F.col("correct") if self.task_ == "classification" else None,
            "under_predicted": F.col("residual") > 0 if self.task_ == "regression" else None,
            "over_predicted": F.col("residual") < 0 if self.task_ == "regression" else None,
        }
        return F.col("is_anomaly") & more[kind]

    def anomaly_scores(self) -> DataFrame:
        return self.rows.select("sample_index", "anomaly_score")

    def anomalies(self, kind: str = "all") -> DataFrame:
        return self.rows.where(self._of_kind(kind)).select("sample_index")

    def anomaly_table(self, only_anomalies: bool = True) -> DataFrame:
        out = self.rows.where("is_anomaly") if only_anomalies else self.rows
        return out.drop(*[f"x_{k}" for k in range(len(self.features))])

    def summary(self) -> dict:
        aggs = [F.count(F.lit(1)).alias("n_samples"), F.count_if("is_anomaly").alias("n_anomalies")]
        if self.task_ == "classification":
            aggs.append(F.count_if(~F.col("correct")).alias("n_misclassified"))
        else:
            aggs += [
                F.avg("absolute_residual").alias("mean_absolute_residual"),
                F.count_if(self._of_kind("under_predicted")).alias("n_under_predicted"),
                F.count_if(self._of_kind("over_predicted")).alias("n_over_predicted"),
            ]
        r = self.rows.agg(*aggs).first().asDict()
        if self.task_ == "regression":
            r["median_absolute_residual"] = quantile(self.rows, "absolute_residual", 0.5, r["n_samples"])
        out = {
            "task": self.task_,
            "anomaly_rule": self.rule_,
            "n_features": len(self.features),
            "anomaly_rate": r["n_anomalies"] / r["n_samples"] if r["n_samples"] else 0.0,
            "model_type": type(self.model).__name__ if self.model is not None else None,
            "threshold": self.threshold,
        }
        return out | r | ({"model_combined": self.model_score} if self.model_score is not None else {})

    def explain(self) -> dict:
        s = self.summary()
        return s | {"explanation": f"{s['n_anomalies']} of {s['n_samples']} rows are anomalous by {self.rule_}."}

    def _views(self, kind: str) -> DataFrame:
        """(sample_index, attribute, value) of the anomalies."""
        parts = [
            F.struct(F.lit(k).alias("attribute"), as_number(self.rows, f"x_{k}").alias("value"))
            for k in range(len(self.features))
        ]
        return self.rows.where(self._of_kind(kind)).select(
            "sample_index", F.explode(F.array(*parts)).alias("v")
        ).select("sample_index", "v.attribute", "v.value")

    def group_anomalies(
        self,
        dimensions: int = 1,
        kind: str = "all",
        max_groups: int | None = None,
        filter_balanced: bool = True,
        filter_redundant: bool = True,
        filter_repeated_attributes: bool = True,
        min_cluster_fraction: float | None = None,
        redundancy_threshold: float | None = None,
    ) -> DataFrame:
        """Views of one or two attributes that part the anomalies in two, best first. One job covers all single attributes."""
        if dimensions not in (1, 2) or max_groups is not None and max_groups < 1:
            raise ValueError("dimensions is 1 or 2 and max_groups at least one")
        spark, schema = self.rows.sparkSession, GROUPS if dimensions == 1 else GROUPS_2
        n = self.rows.where(self._of_kind(kind)).count()
        if n < 2:
            return spark.createDataFrame([], schema)
        if dimensions == 1:
            found = [
                ((r["attribute"],), r["inertia"], r["cluster_0_size"], r["cluster_1_size"])
                for r in two_means_1d(self._views(kind), "attribute", "value").collect()
            ]
        else:
            found = [(pair, *self._kmeans(pair, kind)[1:]) for pair in combinations(range(len(self.features)), 2)]
        fraction = self.min_fraction if min_cluster_fraction is None else min_cluster_fraction
        rows = sorted(((*f, abs(f[2] - f[3]) / n) for f in found), key=lambda f: (f[1], f[4], f[0]))
        if filter_balanced:
            rows = [f for f in rows if min(f[2], f[3]) / n >= fraction]
        limit = self.max_redundancy if redundancy_threshold is None else redundancy_threshold
        red = Miscoding(
            self.X_type, self.y_type, self.n_bins
        ).fit(self.df, self.features, self.target).redundancy if filter_redundant else None
        taken: set[int] = set()
        kept = []
        for f in rows:
            if filter_repeated_attributes and taken & set(f[0]) or red and any(
                red[a][b] >= limit for a in f[0] for b in taken
            ):
                continue
            taken |= set(f[0])
            kept.append(f)
        names = lambda f: [x for a in f[0] for x in (a, self.features[a])]
        return spark.createDataFrame(
            [(*names(f), dimensions, float(f[1]), f[2], f[3], float(f[4]), n) for f in kept[:max_groups]], schema
        )

    def _kmeans(self, pair: tuple[int, int], kind: str):
        """(the anomalies with column cluster, inertia, both sizes) of the best of three two-means runs on standardised values."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import VectorAssembler

        base = self.rows.where(self._of_kind(kind))
        x = [as_number(base, f"x_{k}") for k in pair]
        m = base.agg(*[f(v) for v in x for f in (F.avg, F.stddev_pop)]).first()
        z = base.withColumns({f"_z{i}": (v - F.lit(m[2 * i])) / F.lit(m[2 * i + 1] or 1.0) for i, v in enumerate(x)})
        rows = VectorAssembler(inputCols=["_z0", "_z1"], outputCol="_z").transform(z).persist()
        try:
            fits = [
                KMeans(k=2, seed=self.seed + s, featuresCol="_z", predictionCol="cluster").fit(rows) for s in range(3)
            ]
            best = min(fits, key=lambda fit: fit.summary.trainingCost)
        finally:
            rows.unpersist()
        sizes = [*best.summary.clusterSizes, 0][:2]
        return best.transform(rows), best.summary.trainingCost, *map(int, sizes)

    def group_points(self, attribute_1, attribute_2=None, kind: str = "all") -> DataFrame:
        given = [a for a in (attribute_1, attribute_2) if a is not None]
        for a in given:
            if a not in (self.features if isinstance(a, str) else range(len(self.features))):
                raise ValueError(f"no attribute {a}; there are {', '.join(self.features)}")
        at = [self.features.index(a) if isinstance(a, str) else int(a) for a in given]
        if len(at) == 1:
            found = two_means_1d(self._views(kind).where(F.col("attribute") == at[0]), "attribute", "value").first()
            cut_at = found["cut"] if found else 0.0  # without an anomaly there is no point either
            above = as_number(self.rows, f"x_{at[0]}") > F.lit(cut_at)
            rows = self.rows.where(self._of_kind(kind)).withColumn("cluster", above.cast("int"))
        else:
            rows = self._kmeans((at[0], at[1]), kind)[0]
        cols = ["cluster", "y_true", "y_pred", "anomaly_score", *[F.col(f"x_{k}").alias(self.features[k]) for k in at]]
        return rows.select("sample_index", *cols).orderBy("cluster", F.desc("anomaly_score"))


def anomaly_table(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    row_id: str,
    prediction: str,
    *,
    task: str = "auto",
    anomaly_rule: str = "auto",
    **options,
) -> DataFrame:
    return AnomalyDetector(task=task, anomaly_rule=anomaly_rule, **options).fit(
        df, features, target, row_id, prediction=prediction
    ).anomaly_table()
