"""Feature metrics: deficiency, surplus, redundancy, subset measures and greedy selection.

All code lengths a fit needs come from grouping sets over one encoded frame; the rest is arithmetic on those scalars.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brevispark.operators.codelength import code_lengths, encode
from brevispark.sources.tables import resolve_numeric, resolve_target

ANALYSIS = (
    "feature_index int, feature_name string, is_numeric boolean, code_length double, deficiency double, "
    "surplus double, miscoding double"
)
PATH = (
    "step int, feature_index int, feature_name string, deficiency double, surplus double, miscoding double, "
    "improvement double, selected_feature_indices array<int>, selected_feature_names array<string>"
)


def _ratio(a: float, b: float, default: float) -> float:
    return min(1.0, max(0.0, a / b)) if b > 0 else default


class Miscoding:
    def __init__(
        self, X_type: str = "auto", y_type: str = "auto", n_bins: int | str = "auto", min_improvement: float = 0.0
    ):
        if not math.isfinite(min_improvement) or min_improvement < 0:
            raise ValueError("min_improvement is finite and not negative")
        self.X_type, self.y_type, self.n_bins, self.min_improvement = X_type, y_type, n_bins, min_improvement

    def fit(self, df: DataFrame, features: Sequence[str], target: str) -> "Miscoding":
        self.spark, self.features = df.sparkSession, list(features)
        if len(set(self.features)) < len(self.features):
            raise ValueError("feature names repeat")
        self.numeric = resolve_numeric(df, self.features, self.X_type)
        self.y_numeric = resolve_target(df, target, self.y_type)
        y = "\x00y"  # the target may be a feature as well
        e = encode(
            df.select(*self.features, F.col(target).alias(y)),
            [*self.features, y],
            [*self.numeric, self.y_numeric],
            self.n_bins,
        )
        pairs = list(combinations(self.features, 2))
        got = code_lengths(e, [[y], *[[f] for f in self.features], *[[f, y] for f in self.features], *pairs])
        e.close()
        K = lambda *cols: got[frozenset(cols)][0]
        self.n_samples, self.y_length = e.n, K(y)
        self.lengths = [K(f) for f in self.features]
        joint = [K(f, y) for f in self.features]
        self.deficiency = [_ratio(j - k, self.y_length, 0.0) for j, k in zip(joint, self.lengths)]
        self.surplus = [_ratio(j - self.y_length, k, 0.0) for j, k in zip(joint, self.lengths)]
        self.miscoding = list(map(max, self.deficiency, self.surplus))
        p = len(self.features)
        self.redundancy = [[1.0] * p for _ in range(p)]
        for i, j in combinations(range(p), 2):
            a, b = self.lengths[i], self.lengths[j]
            top = max(a, b)
            r = 1.0 if top <= 0 else min(1.0, max(0.0, 1 - (K(self.features[i], self.features[j]) - min(a, b)) / top))
            self.redundancy[i][j] = self.redundancy[j][i] = r
        return self

    def _per_feature(self, values: list[float], name: str) -> DataFrame:
        return self.spark.createDataFrame(
            list(zip(range(len(values)), self.features, values)),
            f"feature_index int, feature_name string, {name} double",
        )

    def feature_deficiency(self) -> DataFrame:
        return self._per_feature(self.deficiency, "deficiency")

    def feature_surplus(self) -> DataFrame:
        return self._per_feature(self.surplus, "surplus")

    def feature_miscoding(self) -> DataFrame:
        return self._per_feature(self.miscoding, "miscoding")

    def feature_analysis(self) -> DataFrame:
        rows = list(
            zip(
                range(len(self.features)),
                self.features,
                self.numeric,
                self.lengths,
                self.deficiency,
                self.surplus,
                self.miscoding,
            )
        )
        return self.spark.createDataFrame(rows, ANALYSIS).orderBy("miscoding", "deficiency", "surplus")

    def feature_redundancy(self) -> DataFrame:
        """Long form: feature_i, feature_j, redundancy, with both directions and the diagonal."""
        rows = [(a, b, self.redundancy[i][j]) for i, a in enumerate(self.features) for j, b in enumerate(self.features)]
        return self.spark.createDataFrame(rows, "feature_i string, feature_j string, redundancy double")

    def redundancy_matrix(self) -> DataFrame:
        return self.feature_redundancy().groupBy("feature_i").pivot(
            "feature_j", self.features
        ).agg(F.first("redundancy"))

    def indices(self, subset: Sequence, as_mask: bool | None = None) -> list[int]:
        """A subset as indices: names or indices, or a mask of zeros and ones as long as the features (as_mask decides where both would do)."""
        p, values = len(self.features), list(subset)
        if any(isinstance(v, (list, tuple)) for v in values):
            raise ValueError("a subset has one dimension")
        if values and all(isinstance(v, str) for v in values):
            values = [self.features.index(v) for v in values]
        elif as_mask or as_mask is None and len(values) == p and all(v in (0, 1) for v in values):
            return [i for i, v in enumerate(values) if v]
        if len(set(values)) < len(values) or any(int(v) != v or not 0 <= v < p for v in values):
            raise ValueError("feature indices repeat or are out of range")
        return sorted(int(v) for v in values)

    def measures(self, chosen: Sequence[int]) -> dict:
        """All measures of a list of feature indices."""
        chosen = list(chosen)
        alpha = [1 / (1 + sum(self.redundancy[j][k] for k in chosen if k != j)) for j in chosen]
        if not chosen:
            d, s = (0.0 if self.y_length <= 0 else 1.0), 0.0
        else:
            d = math.prod(self.deficiency[j] ** a for j, a in zip(chosen, alpha))
            weight = sum(a * self.lengths[j] for j, a in zip(chosen, alpha))
            s = sum(
                a * self.lengths[j] * self.surplus[j] for j, a in zip(chosen, alpha)
            ) / weight if weight > 0 else 0.0
        total = sum(alpha)
        return {
            "deficiency": d,
            "surplus": s,
            "miscoding": max(d, s),
            "features_in_use": [int(i in chosen) for i in range(len(self.features))],
            "n_selected_features": len(chosen),
            "selected_feature_indices": chosen,
            "selected_feature_names": [self.features[j] for j in chosen],
            "redundancy_weights": alpha,
            "feature_weights": [a / total for a in alpha],
        }

    def subset_analysis(self, subset: Sequence, as_mask: bool | None = None) -> dict:
        return self.measures(self.indices(subset, as_mask))

    def miscoding_subset(self, subset: Sequence, mode: str = "miscoding", as_mask: bool | None = None) -> float:
        if mode not in ("deficiency", "surplus", "miscoding"):
            raise ValueError("a mode is deficiency, surplus or miscoding")
        return self.subset_analysis(subset, as_mask)[mode]

    def selection_path(self, max_features: int | None = None, min_improvement: float | None = None) -> list[dict]:
        """Greedy forward steps: least miscoding, then deficiency, surplus and index, while that improves by more than min_improvement."""
        if max_features is not None and max_features < 1:
            raise ValueError("max_features is at least one")
        least = self.min_improvement if min_improvement is None else min_improvement
        chosen: list[int] = []
        now, path = self.measures([])["miscoding"], []
        while len(chosen) < min(len(self.features), max_features or len(self.features)):
            options = [
                (m["miscoding"], m["deficiency"], m["surplus"], j)
                for j in range(len(self.features))
                if j not in chosen
                for m in [self.measures([*chosen, j])]
            ]
            m, d, s, j = min(options)
            if now - m <= least:
                break
            chosen.append(j)
            path.append(
                {
                    "step": len(chosen),
                    "feature_index": j,
                    "feature_name": self.features[j],
                    "deficiency": d,
                    "surplus": s,
                    "miscoding": m,
                    "improvement": now - m,
                    "selected_feature_indices": list(chosen),
                    "selected_feature_names": [self.features[i] for i in chosen],
                }
            )
            now = m
        return path

    def select_features(
        self, max_features: int | None = None, min_improvement: float | None = None, return_details: bool = False
    ):
        path = self.selection_path(max_features, min_improvement)
        chosen = path[-1]["selected_feature_indices"] if path else []
        return (
            chosen, self.spark.createDataFrame([tuple(r.values()) for r in path], PATH)
        ) if return_details else chosen

    def feature_order(self) -> list[int]:
        """Greedy selection, then what is left in the order of feature_analysis()."""
        chosen = self.select_features()
        rest = sorted(
            (i for i in range(len(self.features)) if i not in chosen),
            key=lambda i: (self.miscoding[i], self.deficiency[i], self.surplus[i]),
        )
        return [*chosen, *rest]


def feature_mask(indices: Sequence[int], n_features: int) -> list[int]:
    """Ones at the indices, zeros elsewhere."""
    if any(not 0 <= j < n_features for j in indices):
        raise ValueError("a feature index is out of range")
    chosen = set(indices)
    return [int(j in chosen) for j in range(n_features)]


def feature_analysis(df: DataFrame, features: Sequence[str], target: str, **options) -> DataFrame:
    return Miscoding(**options).fit(df, features, target).feature_analysis()


def feature_redundancy(df: DataFrame, features: Sequence[str], target: str, **options) -> DataFrame:
    return Miscoding(**options).fit(df, features, target).feature_redundancy()


def miscoding_subset(
    df: DataFrame, features: Sequence[str], target: str, subset: Sequence, mode: str = "miscoding", **options
) -> float:
    return Miscoding(**options).fit(df, features, target).miscoding_subset(subset, mode)


def select_features(df: DataFrame, features: Sequence[str], target: str, **options) -> list[int]:
    return Miscoding(**options).fit(df, features, target).select_features()
