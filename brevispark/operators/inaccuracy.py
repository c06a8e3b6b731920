"""Inaccuracy: the normalised code-length distance between a target and predictions, for one or many candidates at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevispark.functions.binning import bin_of, clip01, rice_bins
from brevispark.operators.codelength import code_lengths, encode, length_of
from brevispark.sources.tables import as_number, resolve_target


def distance(joint: Column, y: Column, p: Column, equal: Column) -> Column:
    """(K(y, p) - min) / max; where both lengths are 0, 0 if the values are equal and else 1."""
    top = F.greatest(y, p)
    return F.when(top > 0, clip01((joint - F.least(y, p)) / top)).otherwise(F.when(equal, 0.0).otherwise(1.0))


def inaccuracy_of_candidates(
    df: DataFrame,
    target: str,
    predictions: Sequence[str],
    *,
    y_type: str = "auto",
    n_bins: int | str = "auto",
    weight: str | None = None,
    state: str | None = None,
    low: float | None = None,
) -> DataFrame:
    """(candidate, inaccuracy) for each prediction column, in two jobs however many there are.

    Bounds and validity of all columns are plain aggregates of one row. Target and predictions are binned each within its
    own bounds; then states, not values, become a row for each candidate and are counted in one grouping.
    A row can stand for several: weight is the column of their number, state that of the target's state, and low its bound.
    """
    numeric = resolve_target(df, target, y_type)
    names = list(predictions)
    cast = (lambda c: as_number(df, c)) if numeric else (lambda c: F.col(c).cast("string"))
    wide = df.select(
        cast(target).alias("y"),
        *[cast(p).alias(f"p{k}") for k, p in enumerate(names)],
        (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("w"),
        *([] if state is None else [F.col(state).alias("s")]),
    )
    bad = (lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) if numeric else (lambda c: c.isNull())
    columns = wide.columns[: len(names) + 1]
    aggs = [f(c).alias(f"{g}_{c}") for c in columns for f, g in ((F.min, "lo"), (F.max, "hi"))]
    aggs += [F.count_if(bad(F.col(c))).alias(f"bad_{c}") for c in columns]
    seen = wide.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"), *aggs).first()
    n = seen["n"]
    if not n:
        raise ValueError("the table is empty")
    if any(seen[f"bad_{c}"] for c in columns):
        raise ValueError("missing or non-finite values")

    def state_of(c: str) -> Column:
        if c == "y" and state is not None:
            return F.col("s")
        return bin_of(F.col(c), seen[f"lo_{c}"], seen[f"hi_{c}"], rice_bins(n_bins, n)) if numeric else F.col(c)

    cells = [F.struct(F.lit(p).alias("candidate"), state_of(f"p{k}").alias("p")) for k, p in enumerate(names)]
    states = wide.select("w", state_of("y").alias("y"), F.explode(F.array(*cells)).alias("x")).select(
        "w", "y", "x.candidate", "x.p"
    )

    def equal_first(k: int) -> bool:
        a, b = seen["lo_y"] if low is None else low, seen[f"lo_p{k}"]
        return abs(a - b) <= 1e-8 + 1e-5 * abs(b) if numeric else a == b

    same = [p for k, p in enumerate(names) if equal_first(k)]
    equal = F.col("candidate").isin(same) if same else F.lit(False)
    counts = states.groupBy("candidate", "y", "p").agg(F.sum("w").alias("c"))
    joint = counts.groupBy("candidate").agg(length_of(F.col("c"), n).alias("joint"))

    def one(c: str) -> DataFrame:
        own = counts.groupBy("candidate", c).agg(F.sum("c").alias("c"))
        return own.groupBy("candidate").agg(length_of(F.col("c"), n).alias(f"k_{c}"))

    out = joint.join(one("y"), "candidate").join(one("p"), "candidate")
    return out.select("candidate", distance(F.col("joint"), F.col("k_y"), F.col("k_p"), equal).alias("inaccuracy"))


class Inaccuracy:
    def __init__(self, y_type: str = "auto", n_bins: int | str = "auto"):
        self.y_type, self.n_bins = y_type, n_bins

    def fit(self, df: DataFrame, target: str) -> "Inaccuracy":
        self.df, self.target = df, target
        self.y_numeric = resolve_target(df, target, self.y_type)
        e = encode(df, [target], [self.y_numeric], self.n_bins, cache=False)
        self.n_samples, self.y_length = e.n, code_lengths(e, [[target]])[frozenset([target])][0]
        return self

    fit_y = fit

    def inaccuracy_predictions(self, df: DataFrame | None, prediction: str) -> float:
        """Of a column of predictions beside the target."""
        kind = "numeric" if self.y_numeric else "categorical"
        return inaccuracy_of_candidates(
            self.df if df is None else df, self.target, [prediction], y_type=kind, n_bins=self.n_bins
        ).first()["inaccuracy"]

    def inaccuracy_model(self, model, df: DataFrame | None = None, prediction: str = "prediction") -> float:
        return self.inaccuracy_predictions(model.transform(self.df if df is None else df), prediction)

    def score(self, model, df: DataFrame | None = None) -> float:
        return 1 - self.inaccuracy_model(model, df)


def inaccuracy_score(df: DataFrame, target: str, prediction: str, **options) -> float:
    return inaccuracy_of_candidates(df, target, [prediction], **options).first()["inaccuracy"]
