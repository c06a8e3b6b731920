"""Number formats and tokens of model descriptions."""

from __future__ import annotations

import math


def sci_number(value: float) -> str:
    """Two decimals in scientific notation; exactly zero is 0."""
    value = float(value)
    if math.isnan(value):
        return "nan"
    if math.isinf(value):
        return "inf" if value > 0 else "-inf"
    return "0" if value == 0 else f"{value:.2e}"


def fixed_number(value: float, precision: int = 6) -> str:
    """Rounded, without trailing zeros but with one decimal."""
    if not math.isfinite(value):
        raise ValueError("a description needs finite numbers")
    text = f"{float(value):.{precision}f}".rstrip("0").rstrip(".") if precision else f"{float(value):.0f}"
    return text if "." in text else f"{text}.0"


def feature_token(i: int) -> str:
    return f"X{i}"


def class_token(i: int) -> str:
    return f"C{i}"
