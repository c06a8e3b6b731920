"""Incremental code lengths: joint state counts can be added up, so a stream keeps them under fixed bin edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brevispark.functions.binning import bin_of


def joint_counts(
    stream: DataFrame,
    columns: Sequence[str],
    bounds: Mapping[str, tuple[float, float, int]],
    *,
    time: str | None = None,
    size: str | None = None,
    slide: str | None = None,
    delay: str = "1 hour",
) -> DataFrame:
    """Counts of joint states, of everything so far or of sliding event-time windows behind a watermark. Works on batch tables as well."""
    states = [bin_of(F.col(c).cast("double"), *bounds[c]).alias(c) if c in bounds else F.col(c) for c in columns]
    if time is None:
        return stream.select(*states).groupBy(*columns).count()
    rows = stream.withWatermark(time, delay).select(F.col(time).alias("_at"), *states)
    return rows.groupBy(F.window("_at", size, slide), *columns).count()


def code_length(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Code length and row count of counted states, for each value of `by`: n log2 n - sum c log2 c, so one aggregation does."""
    c = F.col("count").cast("double")
    return counts.groupBy(*by).agg(
        (F.sum(c) * F.log2(F.sum(c)) - F.sum(c * F.log2(c))).alias("code_length"), F.sum("count").alias("n")
    )
