"""Equal-width bins whose edges are lo + i * step, to the last bit."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rice_bins(n_bins: int | str, n: int) -> int:
    """Bins for n rows: an explicit number of at least one, or twice the cube root of n, rounded up, at most n."""
    if n_bins == "auto":
        return max(1, min(math.ceil(2 * n ** (1 / 3)), n))
    if isinstance(n_bins, bool) or not isinstance(n_bins, int) or n_bins < 1:
        raise ValueError("n_bins is auto or an integer of at least one")
    return n_bins


def bin_of(x: Column, lo: float | Column, hi: float | Column, bins: int | Column) -> Column:
    """The number of inner edges at or below x.

    A division guesses the bin; comparing with the two edges around it makes it exact, within generated code.
    """
    lo, hi, bins = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi, bins))
    step = (hi - lo) / bins
    guess = F.least(bins - 1, F.greatest(F.lit(0), F.floor((x - lo) / step).cast("int")))
    down = (guess > 0) & (x < lo + guess * step)
    up = (guess < bins - 1) & (x >= lo + (guess + 1) * step)
    exact = guess - down.cast("int") + up.cast("int")
    return F.when((bins <= 1) | (lo == hi) | (step == 0), F.lit(0)).otherwise(exact).cast("int")


def safe_divide(a: Column, b: Column, default: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(default))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
