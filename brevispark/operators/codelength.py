"""Encoded frames and empirical code lengths: n * H(joint states), from grouping sets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevispark.functions.binning import bin_of, rice_bins
from brevispark.sources.tables import as_number, check_columns

#: Grouping sets in one job: Spark expands each row that often before it combines.
SETS_A_JOB = 96


@dataclass
class Encoded:
    """States of columns (bins of numeric ones, values of others), their row count and, for numeric ones, their bounds."""

    frame: DataFrame
    columns: list[str]
    n: int
    bounds: dict[str, tuple[float, float, int]]

    def close(self) -> None:
        self.frame.unpersist()


def profile(
    df: DataFrame, columns: Sequence[str], numeric: Sequence[bool]
) -> tuple[int, dict[str, tuple[float, float]]]:
    """Row count and bounds of numeric columns in one pass; missing or non-finite values are an error."""
    check_columns(df, columns, numeric)
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    for k, (c, num) in enumerate(zip(columns, numeric)):
        if num:
            x = as_number(df, c)
            aggs += [
                F.min(x).alias(f"lo{k}"),
                F.max(x).alias(f"hi{k}"),
                F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).alias(f"bad{k}"),
            ]
        else:
            aggs.append(F.count_if(F.col(c).isNull()).alias(f"bad{k}"))
    r = df.agg(*aggs).first()
    if not r["n"]:
        raise ValueError("the table is empty")
    bad = [c for k, c in enumerate(columns) if r[f"bad{k}"]]
    if bad:
        raise ValueError(f"missing or non-finite values in {', '.join(bad)}")
    return r["n"], {c: (r[f"lo{k}"], r[f"hi{k}"]) for k, (c, num) in enumerate(zip(columns, numeric)) if num}


def encode(
    df: DataFrame,
    columns: Sequence[str],
    numeric: Sequence[bool],
    n_bins: int | str = "auto",
    *,
    keep: Sequence[str] = (),
    cache: bool = True,
) -> Encoded:
    """The states of columns, with the columns in keep beside them."""
    n, found = profile(df, columns, numeric)
    bins = rice_bins(n_bins, n)
    bounds = {c: (lo, hi, bins) for c, (lo, hi) in found.items()}
    states = [bin_of(as_number(df, c), *bounds[c]).alias(c) if c in bounds else F.col(c) for c in columns]
    frame = df.select(*states, *[F.col(c).alias(f"_{c}") for c in keep])
    return Encoded(frame.persist() if cache else frame, list(columns), n, bounds)


def length_of(c: Column, n: Column | float) -> Column:
    """Code length in bits of states with counts c out of n."""
    return F.sum(-c * F.log2(c / (n if isinstance(n, Column) else F.lit(float(n)))))


def code_lengths(e: Encoded, sets: Iterable[Sequence[str]]) -> dict[frozenset[str], tuple[float, int]]:
    """(code length, states) of each set of columns; one scan for SETS_A_JOB sets. The empty set has length 0."""
    wanted = list(dict.fromkeys(frozenset(s) for s in sets))
    out = {frozenset(): (0.0, 1)}
    wanted = [s for s in wanted if s]
    for at in range(0, len(wanted), SETS_A_JOB):
        part = wanted[at : at + SETS_A_JOB]
        cols = [c for c in e.columns if any(c in s for s in part)]
        flags = [F.grouping(c).cast("string") for c in cols]
        counted = e.frame.groupingSets(
            [[F.col(c) for c in cols if c in s] for s in part], *[F.col(c) for c in cols]
        ).agg(F.count(F.lit(1)).alias("_c"), F.concat(*flags).alias("_set"))
        for r in counted.groupBy("_set").agg(
            length_of(F.col("_c"), e.n).alias("length"), F.count(F.lit(1)).alias("states")
        ).collect():
            out[frozenset(c for c, flag in zip(cols, r["_set"]) if flag == "0")] = (r["length"] + 0.0, r["states"])
    return out


@dataclass
class EmpiricalSummary:
    states: DataFrame
    entropy: float
    code_length: float
    n_samples: int
    n_states: int


def empirical_distribution(
    df: DataFrame, columns: Sequence[str], numeric: Sequence[bool], n_bins: int | str = "auto"
) -> EmpiricalSummary:
    """Joint states with count and probability, and their entropy and code length."""
    e = encode(df, columns, numeric, n_bins, cache=False)
    states = e.frame.groupBy(*columns).agg(F.count(F.lit(1)).alias("count")).withColumn(
        "probability", F.col("count") / F.lit(float(e.n))
    )
    r = states.agg(length_of(F.col("count"), e.n).alias("length"), F.count(F.lit(1)).alias("k")).first()
    return EmpiricalSummary(states.orderBy(*columns), r["length"] / e.n + 0.0, r["length"] + 0.0, e.n, r["k"])


def entropy_from_counts(counts: Sequence[float]) -> float:
    return code_length_from_counts(counts) / sum(counts)


def code_length_from_counts(counts: Sequence[float]) -> float:
    import math

    if not len(counts) or any(
        isinstance(c, (list, tuple)) or not math.isfinite(c) or c < 0 for c in counts
    ) or not sum(counts):
        raise ValueError("counts are finite, not negative and not all zero")
    n = float(sum(counts))
    return math.fsum(-c * math.log2(c / n) for c in counts if c) + 0.0
