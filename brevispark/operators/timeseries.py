"""Ordered series: lag matrices, moving-average, smoothing and autoregressive forecasters, lag analyses, forecasts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevispark.functions.binning import bin_of, clip01, rice_bins, safe_divide
from brevispark.functions.text import fixed_number
from brevispark.operators.codelength import length_of
from brevispark.operators.combined import ADVICE, CombinedScore
from brevispark.operators.inaccuracy import inaccuracy_of_candidates
from brevispark.operators.models import gram, solve_ols
from brevispark.sources.shared import cut

MODELS = ("autoregressive", "moving_average", "exponential_smoothing")
ALPHAS = (0.1, 0.2, 0.3, 0.5, 0.8)
CHUNK = 1 << 16
#: The first line of a forecaster's text: a name of the library's own, as long as is usual in this grammar.
SCHEMA = "canonical_weighting_time_series_model_v1"


def window_size(n: int, window: int | str = "auto") -> int:
    w = max(1, math.isqrt(n)) if window == "auto" else window
    if not isinstance(w, int) or not 1 <= w < n:
        raise ValueError("a window is at least one and shorter than the series")
    return w


def indexed(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """df with its position _t in the order, without bringing the series to one task: range partitions, their counts, offsets.

    The order should have no ties; tied rows get positions in no particular order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = df.repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by).withColumn(
        "_p", F.spark_partition_id()
    ).withColumn(
        "_m", F.monotonically_increasing_id()
    )
    own = cut(own)
    counts = {r["_p"]: r["count"] for r in own.groupBy("_p").count().collect()}  # a row for each partition
    at, offsets = 0, []
    for p in range(max(counts, default=-1) + 1):
        offsets.append(at)
        at += counts.get(p, 0)
    start = F.element_at(F.array(*[F.lit(o) for o in offsets] or [F.lit(0)]), F.col("_p") + 1)
    return own.withColumn("_t", (start + F.col("_m").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_p", "_m")


def lag_matrix(
    df: DataFrame,
    y: str,
    window: int,
    order_by: Sequence[str],
    *,
    exogenous: Sequence[str] = (),
    key: str | None = None,
    complete: bool = True,
) -> DataFrame:
    """df with columns y_lag_k and <exogenous>_lag_k (lag 1 is the row before), for rows that have all of them (complete) or all rows.

    A keyed series uses a window for each key. One long series is cut to chunks of positions that overlap by the window, so
    no task sees more than a chunk.
    """
    cols = [("y", y), *[(x, x) for x in exogenous]]
    if key:
        w = Window.partitionBy(key).orderBy(*order_by)
        out = df.withColumn("_t", F.row_number().over(w) - 1)
        own = F.lit(True)
    else:
        size = max(CHUNK, 4 * window)
        base, chunk, tail = indexed(df, order_by), F.floor(F.col("_t") / size), F.col("_t") % size >= size - window
        out = base.withColumn("_chunk", F.explode(F.when(tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
        w, own = Window.partitionBy("_chunk").orderBy("_t"), F.col("_chunk") == chunk
    out = out.select(
        "*", *[F.lag(c, k).over(w).alias(f"{name}_lag_{k}") for name, c in cols for k in range(1, window + 1)]
    ).where(own).drop("_chunk")
    return out.where(F.col("_t") >= window) if complete else out


def lag_names(window: int, exogenous: Sequence[str] = ()) -> list[str]:
    return [f"{name}_lag_{k}" for name in ("y", *exogenous) for k in range(1, window + 1)]


def lag_metadata(window: int, exogenous: Sequence[str] = ()) -> list[dict]:
    own = [{"source": "target", "attribute": "y", "lag": k} for k in range(1, window + 1)]
    return own + [
        {"source": "exogenous", "attribute": x, "attribute_index": i, "lag": k}
        for i, x in enumerate(exogenous)
        for k in range(1, window + 1)
    ]


def moving_average_weights(window: int) -> list[float]:
    if window < 1:
        raise ValueError("a window is at least one")
    return [1.0 / window] * window


def exponential_smoothing_weights(window: int, alpha: float) -> list[float]:
    if window < 1 or not 0 < alpha < 1:
        raise ValueError("a window is at least one and alpha between 0 and 1")
    raw = [alpha * (1 - alpha) ** k for k in range(window)]
    return [x / sum(raw) for x in raw]


def weighted(columns: Sequence[str], weights: Sequence[float], intercept: float = 0.0) -> Column:
    out = F.lit(float(intercept))
    for c, w in zip(columns, weights):
        out = out + F.lit(float(w)) * F.col(c)
    return out


def description(
    kind: str,
    name: str,
    inputs: Sequence[str],
    weights: Sequence[float],
    intercept: float,
    learned: bool,
    precision: int = 6,
) -> str:
    lines = [
        f"SCHEMA {SCHEMA}",
        f"MODEL {kind}",
        "TASK forecasting",
        f"NAME {name}",
        f"INPUTS {', '.join(inputs) or '<none>'}",
        "PARAMETERS",
        f"    n_features = {len(inputs)}",
        f"    learned_coefficients = {str(learned).lower()}",
        "RULE",
        f"    y_hat = {fixed_number(intercept, precision)}",
    ]
    return "\n".join(
        [
            *lines,
            *[f"    y_hat += {fixed_number(w, precision)} * {c}" for w, c in zip(weights, inputs)],
            "    return y_hat",
        ]
    ) + "\n"


@dataclass
class Forecaster:
    name: str
    family: str
    window: int
    inputs: list[str]
    weights: list[float]
    intercept: float = 0.0
    learned: bool = False
    results: dict = field(default_factory=dict)

    def column(self) -> Column:
        return weighted(self.inputs, self.weights, self.intercept)

    def text(self) -> str:
        kind = f"{self.family}_linear" if self.learned else self.family
        return description(kind, self.name, self.inputs, self.weights, self.intercept, self.learned)


def lag_analysis_of(
    lags: DataFrame, n: int, names: Sequence[tuple[str, str, int]], y: str, n_bins: int | str
) -> DataFrame:
    """(attribute, lag, feature_name, deficiency, surplus, miscoding) of (column, attribute, lag), all in one grouping.

    Each lag uses the rows that have it, with bins from its own rows.
    """
    parts = [
        F.struct(
            F.lit(c).alias("feature_name"),
            F.lit(a).alias("attribute"),
            F.lit(k).alias("lag"),
            F.col(c).cast("double").alias("x"),
        )
        for c, a, k in names
    ]
    long = lags.select(
        F.col("_t"), F.col(y).cast("double").alias("y"), F.explode(F.array(*parts)).alias("v")
    ).select("_t", "y", "v.*").where("_t >= lag")
    bounds = long.groupBy("feature_name").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    bins = F.element_at(
        F.create_map(*[F.lit(v) for k in sorted({k for *_, k in names}) for v in (k, rice_bins(n_bins, n - k))]),
        F.col("lag"),
    )
    long = long.join(F.broadcast(bounds), "feature_name").withColumn("b", bins)  # a row for each lag
    states = long.select(
        "attribute",
        "lag",
        "feature_name",
        bin_of(F.col("x"), F.col("x0"), F.col("x1"), F.col("b")).alias("xb"),
        bin_of(F.col("y"), F.col("y0"), F.col("y1"), F.col("b")).alias("yb"),
    )
    keys, m = ["attribute", "lag", "feature_name"], F.lit(n) - F.col("lag")
    counts = states.groupBy(*keys, "xb", "yb").agg(F.count(F.lit(1)).alias("c"))
    joint = counts.groupBy(*keys).agg(F.sum(-F.col("c") * F.log2(F.col("c") / m)).alias("xy"))

    def one(c: str) -> DataFrame:
        own = counts.groupBy(*keys, c).agg(F.sum("c").alias("c"))
        return own.groupBy(*keys).agg(F.sum(-F.col("c") * F.log2(F.col("c") / m)).alias(f"k_{c}"))

    out = joint.join(one("xb"), keys).join(one("yb"), keys)
    d = clip01(safe_divide(F.col("xy") - F.col("k_xb"), F.col("k_yb"), 0.0))
    s = clip01(safe_divide(F.col("xy") - F.col("k_yb"), F.col("k_xb"), 0.0))
    return out.select(
        "lag",
        "feature_name",
        d.alias("deficiency"),
        s.alias("surplus"),
        F.greatest(d, s).alias("miscoding"),
        "attribute",
    )


class TimeSeries:
    def __init__(
        self,
        window_size: int | str = "auto",
        models: Sequence[str] | str = "auto",
        n_bins: int | str = "auto",
        aggregation: str = "euclidean",
        weights=None,
        moving_average_windows: Sequence[int] | None = None,
        smoothing_alphas: Sequence[float] = ALPHAS,
        min_improvement: float = 0.0,
    ):
        self.models = MODELS if models == "auto" else tuple(dict.fromkeys(models))
        if set(self.models) - set(MODELS) or not self.models:
            raise ValueError(f"models are of {', '.join(MODELS)}")
        if any(not 0 < a < 1 for a in smoothing_alphas):
            raise ValueError("alpha is between 0 and 1")
        self.window, self.n_bins, self.aggregation, self.weights = window_size, n_bins, aggregation, weights
        self.windows, self.alphas, self.min_improvement = moving_average_windows, tuple(smoothing_alphas), min_improvement

    def fit(self, df: DataFrame, y: str, order_by: Sequence[str], exogenous: Sequence[str] = ()) -> "TimeSeries":
        self.df, self.y, self.order_by, self.exogenous = df, y, list(order_by), list(exogenous)
        x = lambda c: F.col(c).cast("double")
        bad = lambda c: x(c).isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf"))
        r = df.agg(
            F.count(F.lit(1)).alias("n"), *[F.count_if(bad(c)).alias(f"bad{k}") for k, c in enumerate([y, *exogenous])]
        ).first()
        if r["n"] < 3 or any(r[f"bad{k}"] for k in range(1 + len(exogenous))):
            raise ValueError("a series has three rows or more and no missing or non-finite values")
        self.n, self.w = r["n"], window_size(r["n"], self.window)
        names = lag_names(self.w, exogenous)
        self.lags = lag_matrix(df, y, self.w, order_by, exogenous=exogenous).select(
            "_t", F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in names]
        ).persist()
        self.score_ = CombinedScore(
            "numeric", "numeric", self.aggregation, self.weights, self.n_bins
        ).fit(self.lags, names, "y")
        metric, specs = self.score_.metric, []
        if "autoregressive" in self.models:
            chosen = sorted(
                metric.select_features(min_improvement=self.min_improvement)
            ) or [min(range(len(names)), key=metric.miscoding.__getitem__)]
            inputs = [names[j] for j in chosen]
            coef, intercept = solve_ols(gram(self.lags, inputs, "y"), len(inputs))
            specs.append(Forecaster("autoregressive", "autoregressive", self.w, inputs, coef, intercept, True))
        windows = list(self.windows or range(1, self.w + 1))
        if any(not 1 <= w <= self.w for w in windows):
            raise ValueError("a moving-average window is within the lag window")
        if "moving_average" in self.models:
            specs += [
                Forecaster(f"moving_average_w{w}", "moving_average", w, names[:w], moving_average_weights(w))
                for w in windows
            ]
        if "exponential_smoothing" in self.models:
            specs += [
                Forecaster(
                    f"exponential_smoothing_w{w}_a{a:g}",
                    "exponential_smoothing",
                    w,
                    names[:w],
                    exponential_smoothing_weights(w, a),
                )
                for w in windows
                for a in self.alphas
            ]
        wide = self.lags.select("y", *[s.column().alias(f"p{k}") for k, s in enumerate(specs)])
        found = {
            r["candidate"]: r["inaccuracy"]
            for r in inaccuracy_of_candidates(
                wide, "y", [f"p{k}" for k in range(len(specs))], y_type="numeric", n_bins=self.n_bins
            ).collect()
        }
        fits = wide.agg(
            F.var_pop("y").alias("v"),
            *[F.avg((F.col("y") - F.col(f"p{k}")) ** 2).alias(f"e{k}") for k in range(len(specs))],
        ).first()
        for k, s in enumerate(specs):
            own = [names.index(c) for c in s.inputs]
            c = self.score_.metric.measures(own)
            parts = {
                "deficiency": c["deficiency"],
                "surplus": c["surplus"],
                "inaccuracy": found[f"p{k}"],
                "surfeit": self.score_.surfeit.surfeit_string(s.text()),
            }
            s.results = {
                "combined": self.score_.total(parts),
                "estimator_score": 1 - fits[f"e{k}"] / fits["v"] if fits["v"] else 0.0,
                "selected": own,
                "miscoding": c["miscoding"],
                **parts,
            }
        self.lags.unpersist()  # what is asked for later is computed again from the indexed series
        self.candidates = sorted(specs, key=lambda s: s.results["combined"])
        self.best = self.candidates[0]
        return self

    def results_dataframe(self) -> DataFrame:
        schema = (
            "model_name string, model_family string, window_size int, combined double, estimator_score double, "
            "n_selected_features int, description_length int, selected_feature_indices array<int>, "
            "selected_feature_names array<string>, miscoding double, deficiency double, surplus double, "
            "inaccuracy double, surfeit double"
        )
        rows = [
            (
                s.name,
                s.family,
                s.window,
                r["combined"],
                r["estimator_score"],
                len(s.inputs),
                len(s.text().encode()),
                r["selected"],
                s.inputs,
                r["miscoding"],
                r["deficiency"],
                r["surplus"],
                r["inaccuracy"],
                r["surfeit"],
            )
            for s in self.candidates
            for r in [s.results]
        ]
        return self.df.sparkSession.createDataFrame(rows, schema).orderBy("combined")

    def predict(self, lags: DataFrame | None = None) -> DataFrame:
        return (self.lags if lags is None else lags).withColumn("prediction", self.best.column())

    def score(self, df: DataFrame) -> float:
        """R squared on another series."""
        lags = lag_matrix(
            df, self.y, self.w, self.order_by, exogenous=self.exogenous
        ).withColumn("_y", F.col(self.y).cast("double"))
        r = lags.agg(F.var_pop("_y").alias("v"), F.avg((F.col("_y") - self.best.column()) ** 2).alias("e")).first()
        return 1 - r["e"] / r["v"] if r["v"] else 0.0

    def forecast(self, steps: int = 1, future: Sequence[Sequence[float]] | None = None) -> list[float]:
        """Recursive forecast from the last rows; exogenous values are given for each step or stay as they were last."""
        if steps < 1 or future is not None and (not self.exogenous or len(future) != steps):
            raise ValueError("at least one step, and a row of exogenous values for each")
        cols = [self.y, *self.exogenous]
        last = self.df.orderBy(
            *[F.desc(c) for c in self.order_by]
        ).limit(self.w).select(*cols, *self.order_by).collect()[::-1]
        held = {name: [float(r[c]) for r in last] for name, c in zip(("y", *self.exogenous), cols)}
        out = []
        for step in range(steps):
            value = self.best.intercept
            for c, w in zip(self.best.inputs, self.best.weights):
                name, _, k = c.rpartition("_lag_")
                value += w * held[name][-int(k)]
            out.append(value)
            held["y"].append(value)
            for i, x in enumerate(self.exogenous):
                held[x].append(float(future[step][i]) if future is not None else held[x][-1])
        return out

    def _analysis(self, columns: Sequence[str], min_lag: int, max_lag: int | None, with_y: bool) -> DataFrame:
        top = min(max_lag or self.w, self.n - 1)
        if not 1 <= min_lag <= top:
            raise ValueError("lags begin at one and end within the series")
        lags = lag_matrix(self.df, self.y, top, self.order_by, exogenous=columns, complete=False)
        names = [
            (f"{c}_lag_{k}", c, k) for c in [*(["y"] if with_y else []), *columns] for k in range(min_lag, top + 1)
        ]
        return lag_analysis_of(lags, self.n, names, self.y, self.n_bins)

    def auto_lag_analysis(self, min_lag: int = 1, max_lag: int | None = None) -> DataFrame:
        return self._analysis([], min_lag, max_lag, True).drop("attribute").orderBy("lag")

    def cross_lag_analysis(self, attribute: str | int, min_lag: int = 1, max_lag: int | None = None) -> DataFrame:
        name = self.exogenous[attribute] if isinstance(attribute, int) else attribute
        if name not in self.exogenous:
            raise ValueError(f"no attribute named {name}")
        return self._analysis([name], min_lag, max_lag, False).orderBy("lag")

    def lag_analysis(self, max_lag: int | None = None) -> DataFrame:
        return self._analysis(self.exogenous, 1, max_lag, True).orderBy("attribute", "lag")

    def selected_lags(self) -> list[dict]:
        meta = lag_metadata(self.w, self.exogenous)
        return [
            meta[j] | {"feature_index": j, "feature_name": self.best.inputs[k]}
            for k, j in enumerate(self.best.results["selected"])
        ]

    def get_model(self) -> Forecaster:
        return self.best

    def combined_score(self) -> float:
        return self.best.results["combined"]

    def model_string(self) -> str:
        return self.best.text()

    def components(self) -> dict[str, float]:
        return {k: self.best.results[k] for k in ADVICE}

    def explain(self) -> dict:
        out = self.score_.explain_components(self.components())
        return out | {
            "profile": f"{out['dominant_component']}_dominated",
            "model_name": self.best.name,
            "model_family": self.best.family,
            "selected_lags": self.selected_lags(),
        }


def rolling_segments(df: DataFrame, order_by: Sequence[str], size: int, step: int) -> DataFrame:
    """df with a segment id for each sliding segment of `size` rows, every `step` rows, that a row lies in; only full segments."""
    base = indexed(df, order_by)
    n = base.count()
    last = (n - size) // step
    low = F.greatest(F.lit(0), F.floor((F.col("_t") - size) / step) + 1)
    return base.withColumn(
        "_hi", F.least(F.lit(last), F.floor(F.col("_t") / step))
    ).withColumn("_lo", low).where("_lo <= _hi").withColumn(
        "segment", F.explode(F.sequence("_lo", "_hi"))
    ).drop("_lo", "_hi")


def rolling_autoregression(df: DataFrame, y: str, order_by: Sequence[str], size: int, step: int) -> DataFrame:
    """(segment, slope, intercept, r2, n): the first-order autoregression fitted again to each sliding segment.

    A segment's lags come from its own rows. Segments are grouped by their number, so a task sees a few segments of `size`
    rows, whatever the length of the series.
    """
    base = rolling_segments(df.select(*order_by, F.col(y).cast("double").alias("_y")), order_by, size, step)
    w = Window.partitionBy("segment").orderBy("_t")
    pairs = base.withColumn("_before", F.lag("_y").over(w)).where("_before IS NOT NULL")
    fits = [
        F.regr_slope("_y", "_before").alias("slope"),
        F.regr_intercept("_y", "_before").alias("intercept"),
        F.regr_r2("_y", "_before").alias("r2"),
    ]
    return pairs.groupBy("segment").agg(*fits, F.count(F.lit(1)).alias("n"))
