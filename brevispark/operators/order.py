"""Order statistics and prefix sums without bringing a column to one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brevispark.sources.shared import cut

#: Distinct values that are collected at most to pick order statistics from.
FEW = 50_000
ACCURACY = 10_000


def order_statistics(df: DataFrame, column: str, places: Sequence[int]) -> list[float]:
    """The values at these places (from 0) of the column in order, all within one bracket that is narrowed until it holds
    at most FEW rows or one value.

    Each round takes two approximate percentiles around the places within the bracket and counts what lies below, so a
    round keeps about one part in ACCURACY / 8 of it; no task sees more than its own rows. Nulls are left out.
    """
    x = F.col(column).cast("double")
    first, last = min(places), max(places)
    inside = df.select(x.alias("x")).where("x IS NOT NULL")
    r = inside.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    lo, hi, n, below = r["lo"], r["hi"], r["n"], 0
    if not 0 <= first <= last < n:
        raise ValueError("a place is outside the column")
    while n > FEW and lo < hi:
        bracket = inside.where(F.col("x").between(lo, hi))
        low = max(0.0, (first - below) / n - 2 / ACCURACY)
        high = min(1.0, (last - below + 1) / n + 2 / ACCURACY)
        a, b = bracket.agg(F.percentile_approx("x", [low, high], ACCURACY)).first()[0]
        tests = [F.count_if(F.col("x") < a), F.count_if(F.col("x") <= a), F.count_if(F.col("x") <= b)]
        under_a, upto_a, upto_b = (below + k for k in bracket.agg(*tests).first())
        if under_a <= first and last < upto_a:
            return [a] * len(places)
        if upto_a <= first and last < upto_b and a < b:  # above a
            lo, hi, n, below = math.nextafter(a, math.inf), b, upto_b - upto_a, upto_a
        elif under_a <= first and last < upto_b:
            if (lo, hi) == (a, b):
                break
            lo, hi, n, below = a, b, upto_b - under_a, under_a
        elif last < under_a:
            hi, n = math.nextafter(a, -math.inf), under_a - below
        else:
            lo, n, below = (a, n - (under_a - below), under_a) if first < upto_b else (math.nextafter(b, math.inf), n - (upto_b - below), upto_b)
    found = inside.where(F.col("x").between(lo, hi)).groupBy("x").agg(F.count("x").alias("c")).orderBy("x").collect()
    out, at, k = {}, below, 0
    for place in sorted(set(places)):
        while at + found[k]["c"] <= place:
            at += found[k]["c"]
            k += 1
        out[place] = found[k]["x"]
    return [out[p] for p in places]


def quantile(df: DataFrame, column: str, q: float, n: int | None = None) -> float | None:
    """The exact quantile, interpolated between the two values around (n - 1) * q. None for an empty column."""
    n = df.agg(F.count(column)).first()[0] if n is None else n
    if not n:
        return None
    at = (n - 1) * q
    low, high = math.floor(at), math.ceil(at)
    a, b = order_statistics(df, column, [low, high])
    return a if low == high or a == b else (high - at) * a + (at - low) * b


def prefix_sums(df: DataFrame, group: str, order: str, sums: Sequence[str]) -> DataFrame:
    """df, whose rows are distinct in (group, order), with up_<c>: the sum of c over the group's rows up to this one.

    Rows are dealt by ranges of (group, order); sums within a range are added to those of the ranges before it, a table
    with a row for each range and group.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, group, order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy(group, "_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        group, "_part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums]
    )
    up = Window.partitionBy(group, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.select("*", *[F.sum(c).over(up).alias(f"up_{c}") for c in sums]).join(totals, [group, "_part"])
    return out.select(*df.columns, *[(F.col(f"_{c}") + F.col(f"up_{c}")).alias(f"up_{c}") for c in sums])
