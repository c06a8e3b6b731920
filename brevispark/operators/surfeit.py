"""Surfeit: how much shorter than a model's description the target's code, or the compressed description, is."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from brevispark.operators.inaccuracy import Inaccuracy


@F.udf(IntegerType(), useArrow=False)
def zlib_length(text: str | None) -> int | None:
    """Bytes of the compressed UTF-8 text at level 9 (null: null).

    Plain, as Arrow would bring 10,000 texts of any length to a worker at once, and this brings 100.
    """
    return None if text is None else len(zlib.compress(text.encode(), 9))


def surfeit_from_lengths(length: Column, compressed: Column, y_length: Column, overhead: int = 6) -> Column:
    """1 - min(target bits, effective compressed bytes) / length, within 0 and 1; the units are mixed on purpose.

    An empty or missing description has none: null.
    """
    effective = F.greatest(F.lit(0), F.least(length, compressed - overhead))
    part = F.least(y_length, effective) / F.when(length > 0, length)
    return F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - part)))


#: Bytes of a text between two states of the compressor that are kept.
STEP = 1 << 14


class Surfeit:
    def __init__(self, y_type: str = "auto", n_bins: int | str = "auto", zlib_level: int = 9, zlib_overhead: int = 6):
        if zlib_level not in range(10) or zlib_overhead < 0:
            raise ValueError("zlib_level is 0 to 9 and zlib_overhead not negative")
        self.y_type, self.n_bins, self.level, self.overhead = y_type, n_bins, zlib_level, zlib_overhead

    def fit(self, df: DataFrame, target: str) -> "Surfeit":
        self.y_length = Inaccuracy(self.y_type, self.n_bins).fit(df, target).y_length
        return self

    fit_y = fit

    def description_lengths(self, text: str) -> tuple[int, int]:
        if not isinstance(text, str) or not text:
            raise ValueError("a description is a non-empty string")
        raw = text.encode()
        return len(raw), len(zlib.compress(raw, self.level))

    def effective_length(self, length: int, compressed: int) -> int:
        return max(0, min(length, compressed - self.overhead))

    def surfeit_string(self, text: str) -> float:
        return self._surfeit(*self.description_lengths(text))

    def _surfeit(self, length: int, compressed: int) -> float:
        return min(1.0, max(0.0, 1 - min(self.y_length, self.effective_length(length, compressed)) / length))

    def surfeit_strings(self, texts: Sequence[str]) -> list[float]:
        """surfeit_string of each text; a beginning that a text shares with the one before it is compressed once.

        The compressor's state is kept every STEP bytes, and a text goes on from the last state before its first difference.
        """
        out, before, states = [], b"", []  # a state: bytes read, bytes written, compressor
        for text in texts:
            if not isinstance(text, str) or not text:
                raise ValueError("a description is a non-empty string")
            raw = text.encode()
            n = min(len(raw), len(before))
            differ = np.frombuffer(raw, np.uint8, n) != np.frombuffer(before, np.uint8, n)
            same = int(differ.argmax()) if differ.any() else n
            states = [x for x in states if x[0] <= same]
            at, written, c = states[-1] if states else (0, 0, zlib.compressobj(self.level))
            c = c.copy()
            while at < len(raw):
                written += len(c.compress(raw[at : at + STEP]))
                at += STEP
                if at < len(raw):
                    states.append((at, written, c.copy()))
            out.append(self._surfeit(len(raw), written + len(c.flush())))
            before = raw
        return out


def surfeit_score(text: str, df: DataFrame, target: str, **options) -> float:
    return Surfeit(**options).fit(df, target).surfeit_string(text)
