"""One score from deficiency, surplus, inaccuracy and surfeit (lower is better), with profiles and recommendations."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevispark.operators.inaccuracy import Inaccuracy
from brevispark.operators.miscoding import Miscoding
from brevispark.operators.surfeit import Surfeit

COMPONENTS = ("deficiency", "surplus", "inaccuracy", "surfeit")
MODES = ("euclidean", "arithmetic", "geometric", "harmonic", "maximum", "addition", "product")
HIGH, LOW = 0.50, 0.25
ADVICE = {
    "deficiency": "Add features that carry more about the target.",
    "surplus": "Drop features, or parts of them, that the target does not need.",
    "inaccuracy": "Try another learner or tune this one; the predictions miss the target.",
    "surfeit": "Simplify the model; its description is longer than it has to be.",
}


def resolve_weights(weights: Mapping[str, float] | Sequence[float] | None) -> list[float]:
    if weights is None:
        return [1.0] * 4
    if isinstance(weights, Mapping):
        if set(weights) - set(COMPONENTS):
            raise ValueError("unknown component among the weights")
        w = [float(weights.get(c, 1.0)) for c in COMPONENTS]
    else:
        w = [float(x) for x in weights]
    if len(w) != 4 or any(not math.isfinite(x) or x < 0 for x in w) or not sum(w):
        raise ValueError("four finite weights, none negative and not all zero")
    return w


def aggregate(
    values: Sequence[Column], mode: str, weights: Mapping[str, float] | Sequence[float] | None = None
) -> Column:
    """The score of a whole table of candidates as one expression."""
    pairs = [(v, w) for v, w in zip(values, resolve_weights(weights)) if w > 0]
    total = sum(w for _, w in pairs)

    def add(terms: list[Column]) -> Column:
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    zero = add([(v <= 0).cast("int") for v, _ in pairs]) > 0
    if mode == "euclidean":
        return F.sqrt(add([v * v * w for v, w in pairs]) / total)
    if mode == "arithmetic":
        return add([v * w for v, w in pairs]) / total
    if mode == "geometric":
        return F.when(zero, 0.0).otherwise(F.exp(add([F.ln(v) * w for v, w in pairs]) / total))
    if mode == "harmonic":
        return F.when(zero, 0.0).otherwise(F.lit(total) / add([F.lit(w) / v for v, w in pairs]))
    if mode == "maximum":
        return F.greatest(*[v for v, _ in pairs]) if len(pairs) > 1 else pairs[0][0]
    if mode == "addition":
        return add([v * w for v, w in pairs])
    if mode == "product":
        return F.when(zero, 0.0).otherwise(F.exp(add([F.ln(v) * w for v, w in pairs])))
    raise ValueError(f"a mode is one of {', '.join(MODES)}")


def aggregate_values(values: Mapping[str, float], mode: str, weights=None) -> float:
    """aggregate() for one candidate on the driver."""
    pairs = [(min(1.0, max(0.0, values[c])), w) for c, w in zip(COMPONENTS, resolve_weights(weights)) if w > 0]
    total = sum(w for _, w in pairs)
    zero = any(v <= 0 for v, _ in pairs)
    forms = {
        "euclidean": lambda: math.sqrt(sum(w * v * v for v, w in pairs) / total),
        "arithmetic": lambda: sum(w * v for v, w in pairs) / total,
        "geometric": lambda: 0.0 if zero else math.exp(sum(w * math.log(v) for v, w in pairs) / total),
        "harmonic": lambda: 0.0 if zero else total / sum(w / v for v, w in pairs),
        "maximum": lambda: max(v for v, _ in pairs),
        "addition": lambda: sum(w * v for v, w in pairs),
        "product": lambda: math.prod(v**w for v, w in pairs),
    }
    if mode not in forms:
        raise ValueError(f"a mode is one of {', '.join(MODES)}")
    return forms[mode]()


def profile(d: Column, s: Column, i: Column, f: Column) -> Column:
    """The first profile that fits, from thresholds HIGH and LOW."""
    high, low = (lambda c: c >= HIGH), (lambda c: c <= LOW)
    return (
        F.when(low(d) & low(s) & low(i) & low(f), "low_combined_model")
        .when(high(d) & ~high(s), "under_informed_model")
        .when(high(s) & ~high(d), "over_fed_model")
        .when(low(d) & low(s) & high(i), "bad_learner")
        .when(low(d) & low(s) & low(i) & high(f), "over_complex_model")
        .when(high(d) & high(s), "poor_input_representation")
        .when(high(i) & high(f), "complex_but_inaccurate_model")
        .otherwise("mixed_profile")
    )


def dominant(d: Column, s: Column, i: Column, f: Column) -> Column:
    """The first largest component."""
    values = F.array(d, s, i, f)
    return F.element_at(F.array(*map(F.lit, COMPONENTS)), F.array_position(values, F.array_max(values)).cast("int"))


def pareto(candidates: DataFrame, key: str, columns: Sequence[str] = COMPONENTS, *, small: int = 20_000) -> DataFrame:
    """The candidates that no other is as good as in all columns and better in one; lower is better.

    Up to `small` distinct points are broadcast (a counted bound). More are dealt to blocks of that many, and every point is
    held against each block by an equi-join on the block, so no task holds more than a block of them.
    """
    points = candidates.select(*columns).distinct()
    other = points.select(*[F.col(c).alias(f"_{c}") for c in columns])
    no_worse, better = F.lit(True), F.lit(False)
    for c in columns:
        no_worse, better = no_worse & (F.col(f"_{c}") <= F.col(c)), better | (F.col(f"_{c}") < F.col(c))
    blocks = -(-points.count() // small)
    if blocks <= 1:
        return candidates.join(F.broadcast(other), no_worse & better, "left_anti")
    dealt = other.withColumn("_block", F.pmod(F.xxhash64(*other.columns), F.lit(blocks)))
    each = points.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).cast("long"))
    beaten = each.join(
        dealt, (F.col("_at") == F.col("_block")) & no_worse & better, "left_semi"
    ).select(*columns).distinct()
    return candidates.join(beaten, list(columns), "left_anti").select(*candidates.columns)


class CombinedScore:
    """Fits the feature metrics, inaccuracy and surfeit on one table and scores (subset, predictions, description) triples."""

    def __init__(
        self,
        X_type: str = "auto",
        y_type: str = "auto",
        aggregation: str = "euclidean",
        weights=None,
        n_bins: int | str = "auto",
        threshold_fraction: float = 0.0,
        surplus_penalty: float = 0.0,
        zlib_level: int = 9,
        zlib_overhead: int = 6,
    ):
        if aggregation not in MODES:
            raise ValueError(f"a mode is one of {', '.join(MODES)}")
        resolve_weights(weights)
        if threshold_fraction < 0 or surplus_penalty < 0:
            raise ValueError("threshold_fraction and surplus_penalty are not negative")
        Surfeit(zlib_level=zlib_level, zlib_overhead=zlib_overhead)
        if X_type not in ("auto", "numeric", "categorical") or y_type not in ("auto", "numeric", "categorical"):
            raise ValueError("a type is auto, numeric or categorical")
        # threshold_fraction and surplus_penalty are checked and have no further effect
        self.X_type, self.y_type, self.aggregation, self.weights, self.n_bins, self.zlib = X_type, y_type, aggregation, weights, n_bins, (
            zlib_level, zlib_overhead
        )

    def fit(self, df: DataFrame, features: Sequence[str], target: str) -> "CombinedScore":
        self.df, self.features, self.target = df, list(features), target
        self.metric = Miscoding(self.X_type, self.y_type, self.n_bins).fit(df, features, target)
        kind = "numeric" if self.metric.y_numeric else "categorical"
        self.inaccuracy = Inaccuracy(kind, self.n_bins)
        own = self.inaccuracy
        own.df, own.target, own.y_numeric, own.y_length = df, target, self.metric.y_numeric, self.metric.y_length
        self.surfeit = Surfeit(kind, self.n_bins, *self.zlib)
        self.surfeit.y_length = self.metric.y_length
        return self

    def from_inaccuracy(
        self, subset: Sequence, inaccuracy: float, description: str, as_mask: bool | None = None
    ) -> dict[str, float]:
        m = self.metric.subset_analysis(subset, as_mask)
        return dict(
            zip(COMPONENTS, (m["deficiency"], m["surplus"], inaccuracy, self.surfeit.surfeit_string(description)))
        )

    def components(
        self, subset: Sequence, prediction: str, description: str, df: DataFrame | None = None
    ) -> dict[str, float]:
        return self.from_inaccuracy(subset, self.inaccuracy.inaccuracy_predictions(df, prediction), description)

    def total(self, components: Mapping[str, float]) -> float:
        return aggregate_values(components, self.aggregation, self.weights)

    def combined(self, subset: Sequence, prediction: str, description: str, df: DataFrame | None = None) -> float:
        return self.total(self.components(subset, prediction, description, df))

    def score(self, subset: Sequence, prediction: str, description: str, df: DataFrame | None = None) -> float:
        return 1 - self.combined(subset, prediction, description, df)

    def explain_components(self, c: Mapping[str, float]) -> dict:
        row = self.df.sparkSession.createDataFrame(
            [tuple(c[k] for k in COMPONENTS)], ", ".join(f"{k} double" for k in COMPONENTS)
        )
        cols = [F.col(k) for k in COMPONENTS]
        r = row.select(profile(*cols).alias("profile"), dominant(*cols).alias("dominant")).first()
        return {
            "combined": self.total(c),
            "aggregation": self.aggregation,
            "weights": dict(zip(COMPONENTS, resolve_weights(self.weights))),
            "components": dict(c),
            "dominant_component": r["dominant"],
            "profile": r["profile"],
            "recommendation": ADVICE[r["dominant"]],
        }

    def explain(self, subset: Sequence, prediction: str, description: str, df: DataFrame | None = None) -> dict:
        return self.explain_components(self.components(subset, prediction, description, df))


def components(
    df: DataFrame, features: Sequence[str], target: str, subset: Sequence, prediction: str, description: str, **options
) -> dict[str, float]:
    return CombinedScore(**options).fit(df, features, target).components(subset, prediction, description)


def combined_score(
    df: DataFrame, features: Sequence[str], target: str, subset: Sequence, prediction: str, description: str, **options
) -> float:
    return CombinedScore(**options).fit(df, features, target).combined(subset, prediction, description)
