"""Automated classifier and regressor: families of candidates, each family evaluated in one batch, best combined score wins."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property, reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brevispark.functions.binning import bin_of, rice_bins
from brevispark.functions.text import class_token, feature_token, sci_number
from brevispark.operators.adapters import fit_ml, from_ml
from brevispark.operators.combined import COMPONENTS, CombinedScore
from brevispark.operators.inaccuracy import inaccuracy_of_candidates
from brevispark.operators.models import (
    MLP,
    DecisionTree,
    GaussianNB,
    LinearClassifier,
    LinearRegressor,
    LinearSVC,
    LinearSVR,
    Model,
    TreeNode,
    artifacts,
    gram,
    linear_column,
    partial_sums,
    pruning_steps,
    solve_ols,
)
from brevispark.operators.order import prefix_sums

RESULTS = (
    "candidate string, family string, model_type string, hyperparameters map<string,string>, combined double, "
    "deficiency double, surplus double, inaccuracy double, surfeit double, native_estimator_score double, "
    "selected_features array<int>, n_selected_features int, description_length int"
)


@dataclass
class CandidateResult:
    candidate: str
    family: str
    model: Model
    hyperparameters: dict[str, str]
    components: dict[str, float] = field(default_factory=dict)
    combined: float = float("nan")
    native: float = float("nan")
    subset: list[int] = field(default_factory=list)
    tokens: list[int] = field(default_factory=list)
    length: int = 0

    @property
    def text(self) -> str:
        """The description; made when asked for, as those of all trees of a pruning path would fill the driver."""
        return self.model.text(self.tokens)


@dataclass
class SearchReport:
    family: str
    candidates: list[CandidateResult]
    diagnostics: list[dict] = field(default_factory=list)


@dataclass
class SearchContext:
    df: DataFrame
    features: list[str]
    target: str
    score: CombinedScore
    classes: list | None
    seed: int
    evaluate: object = None

    def order(self) -> list[str]:
        return [self.features[i] for i in self.score.metric.feature_order()]

    @cached_property
    def cells(self) -> "Cells":
        return Cells(self)

    def close(self) -> None:
        if "cells" in self.__dict__:
            self.cells.close()


class Cells:
    """All rows, counted: those of equal features and state of the target, and those a fit cannot tell apart.

    frame has a row for each of the former with their number (count), the target's mean and, in within, its sum of squares
    around that mean; points one for each distinct row of features (or features and class) with count and mean (or number
    of the class). What would not be a quarter of the rows (by a count of distinct hashes that only decides this) is not
    grouped: each row then stands for itself.
    """

    def __init__(self, ctx: SearchContext):
        def free(name: str) -> str:
            while name in ctx.features:
                name = f"_{name}"
            return name

        self.state, self.count, self.mean, self.within = map(free, ("state", "count", "mean", "within"))
        y, n, self.lo, self.spread, self.bins = F.col(ctx.target), ctx.score.metric.n_samples, 0.0, 0.0, 0
        if ctx.classes is None:
            y = y.cast("double")
            self.lo, hi, self.spread = ctx.df.agg(F.min(y), F.max(y), F.var_pop(y)).first()
            self.bins = rice_bins(ctx.score.n_bins, n)
            state = bin_of(y, self.lo, hi, self.bins)
        else:
            state = F.array_position(F.array(*map(F.lit, ctx.classes)), y) - 1
            y = state.cast("double")
        features = [F.col(f).cast("double").alias(f) for f in ctx.features]
        rows = ctx.df.select(*features, state.alias(self.state), y.alias(self.mean))
        different = lambda *c: F.approx_count_distinct(F.xxhash64(*map(F.col, c)))
        groups, own = rows.agg(different(*ctx.features, self.state), different(*ctx.features)).first()
        count, mean, self.kept = F.count(F.lit(1)), F.col(self.mean), []
        single = rows.withColumns({self.count: F.lit(1).cast("long"), self.within: F.lit(0.0)})
        self.frame, self.grouped = single, False
        if groups * 4 <= n:
            self.frame = self._keep(rows.groupBy(*ctx.features, self.state).agg(
                count.alias(self.count), F.avg(mean).alias(self.mean), (F.var_pop(mean) * count).alias(self.within)
            ))
            self.grouped = ctx.classes is not None
        self.points = self.frame if self.grouped else single
        if ctx.classes is None and own * 4 <= n:
            c = F.col(self.count)
            self.points = self._keep(self.frame.groupBy(*ctx.features).agg(
                F.sum(c).alias(self.count), (F.lit(self.lo) + F.sum(c * (mean - self.lo)) / F.sum(c)).alias(self.mean)
            ))
            self.grouped = True

    def _keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df.persist())
        return self.kept[-1]

    def close(self) -> None:
        for df in self.kept:
            df.unpersist()


def _finish(ctx: SearchContext, c: CandidateResult, inaccuracy: float, native: float) -> CandidateResult:
    a = artifacts(c.model, ctx.features)
    c.tokens = [ctx.features.index(f) for f in c.model.features]
    return _scored(
        ctx,
        c,
        a.subset,
        len(a.model_string.encode()),
        ctx.score.surfeit.surfeit_string(a.model_string),
        inaccuracy,
        native,
    )


def _scored(
    ctx: SearchContext,
    c: CandidateResult,
    subset: list[int],
    length: int,
    surfeit: float,
    inaccuracy: float,
    native: float,
) -> CandidateResult:
    c.subset, c.length, c.native = subset, length, native
    m = ctx.score.metric.measures(sorted(subset))
    c.components = dict(zip(COMPONENTS, (m["deficiency"], m["surplus"], inaccuracy, surfeit)))
    c.combined = ctx.score.total(c.components)
    return c


class NestedTexts:
    """The description of a full tree (that of DecisionTree.text), kept up to date line by line while nodes become leaves."""

    def __init__(self, model: DecisionTree):
        self.model, self.lines, self.used = model, [], {}
        self.first, self.last, self.stop, self.depth, self.split = [], [], [], [], []
        self._add(model.root, 1)

    def _leaf(self, n: TreeNode, depth: int) -> str:
        v = self.model._leaf(n)
        return f"{' ' * depth}return {class_token(v) if self.model.classes is not None else sci_number(v)}"

    def _add(self, n: TreeNode, depth: int) -> None:
        k = len(self.first)
        self.first.append(len(self.lines))
        self.depth.append(depth)
        self.last.append(0)
        self.stop.append(k)
        self.split.append(n.feature)
        if n.feature is None:
            self.lines.append(self._leaf(n, depth))
        else:
            self.used[n.feature] = self.used.get(n.feature, 0) + 1
            self.lines.append(f"{' ' * depth}if {feature_token(n.feature)}<={sci_number(n.threshold)}:")
            self._add(n.left, depth + 1)
            self.lines.append(f"{' ' * depth}else:")
            self._add(n.right, depth + 1)
        self.last[k], self.stop[k] = len(self.lines), len(self.first)

    def prune(self, k: int, leaf: TreeNode) -> None:
        """Makes the node of preorder number k a leaf."""
        for x in range(k, self.stop[k]):
            if self.split[x] is not None:
                self.used[self.split[x]] -= 1
                self.split[x] = None
        a, b = self.first[k], self.last[k]
        self.lines[a:b] = [self._leaf(leaf, self.depth[k]), *[None] * (b - a - 1)]

    def subset(self) -> list[int]:
        return sorted(f for f, n in self.used.items() if n)

    def text(self) -> str:
        return "\n".join(
            [f"def predict({', '.join(map(feature_token, self.subset()))}):", *filter(None, self.lines)]
        ) + "\n"


def grown_tree(
    ctx: SearchContext, model, steps: Mapping[str, Sequence[tuple[float, float]]] | None = None
) -> tuple[DecisionTree, "LeafCells"]:
    """The tree of a fitted pyspark.ml model, with statistics of all nodes from one grouping of the rows by leaf and state.

    The shape comes from the debug string, as a call for each node of a large tree would take longer than its fit. The model
    has seen the features in steps as numbers of parts; their thresholds are put between the values around a step.
    """
    lines = iter([x.strip() for x in model.toDebugString.splitlines()[1:] if x.strip()])

    def read() -> TreeNode:
        line = next(lines)
        if line.startswith("Predict"):
            return TreeNode(0.0, 0.0, 0.0)
        feature, threshold = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        feature, threshold = int(feature), float(threshold)
        pairs = (steps or {}).get(ctx.features[feature])
        if pairs:
            low, high = pairs[math.floor(threshold)]
            threshold = low + (high - low) / 2
            threshold = threshold if threshold < high else low
        out = TreeNode(0.0, 0.0, 0.0, feature, threshold, read())
        next(lines)
        out.right = read()
        return out

    tree = DecisionTree(ctx.features, read(), ctx.classes)
    cells = LeafCells(ctx, tree)
    total, leaves = float(cells.size.sum()), iter(range(len(cells.size)))

    def fill(n: TreeNode) -> np.ndarray:
        if n.feature is None:
            k = next(leaves)
            s = cells.of_class(k) if ctx.classes is not None else np.array([cells.size[k], cells.s[k], cells.q[k]])
        else:
            s = fill(n.left) + fill(n.right)
        if ctx.classes is not None:
            n.value, n.weight = s.tolist(), float(s.sum())
            n.risk = (n.weight - float((s * s).sum()) / n.weight) / total
        else:
            n.value, n.weight = float(cells.lo + s[1] / s[0]), float(s[0])
            n.risk = max(0.0, float(s[2] - s[1] * s[1] / s[0])) / total
        return s

    fill(tree.root)
    return tree, cells


class LeafCells:
    """Rows counted by leaf of a tree and state of the target: only cells with rows, in order of the leaves."""

    def __init__(self, ctx: SearchContext, tree: DecisionTree):
        t = ctx.cells
        self.lo, self.bins, c, v = t.lo, t.bins, F.col("c"), F.col("m") - F.lit(t.lo)
        sums = [F.sum(c * v).alias("s"), F.sum(F.col("q") + c * v * v).alias("q")] if ctx.classes is None else []
        rows = t.frame.select(
            tree.leaf_column().alias("leaf"),
            *[F.col(x).alias(a) for x, a in ((t.state, "state"), (t.count, "c"), (t.mean, "m"), (t.within, "q"))],
        ).groupBy("leaf", "state").agg(F.sum(c).alias("n"), *sums).toArrow()
        leaf, state, c = (rows[x].to_numpy() for x in ("leaf", "state", "n"))
        order = np.lexsort((state, leaf))
        leaves = len(tree.root.leaves())
        self.leaf, self.state, self.c = leaf[order].astype(int), state[order].astype(int), c[order].astype(float)
        self.first = np.searchsorted(self.leaf, np.arange(leaves + 1))
        self.states = int(self.state.max()) + 1 if ctx.classes is None else len(ctx.classes)
        total = lambda x: np.bincount(self.leaf, x, leaves)
        self.size = total(self.c)
        if sums:
            self.s, self.q = total(rows["s"].to_numpy()[order]), total(rows["q"].to_numpy()[order])

    def of_class(self, leaf: int) -> np.ndarray:
        a, b = self.first[leaf], self.first[leaf + 1]
        return np.bincount(self.state[a:b], self.c[a:b], self.states)

    def joint(self, p_state: np.ndarray, height: int, a: int = 0, b: int | None = None) -> np.ndarray:
        """Rows by predicted state (p_state has each leaf's) and state, over the leaves from a to b."""
        x = slice(self.first[a], self.first[len(self.size) if b is None else b])
        return np.bincount(
            p_state[self.leaf[x]] * self.states + self.state[x], self.c[x], height * self.states
        ).reshape(height, self.states)


def evaluate_nested(ctx: SearchContext, tree: DecisionTree, cells: LeafCells) -> list[CandidateResult]:
    """All trees on the pruning path of tree, evaluated: what evaluate() gives, without a scan for each.

    A step only changes the leaves below the nodes it prunes, so their cells move within the joint counts and their lines
    within the text. Cells are at most leaves times states, and at most the rows.
    """
    n, height = ctx.score.metric.n_samples, max(cells.bins, cells.states)
    texts, p = NestedTexts(tree), np.array([float(tree._leaf(x)) for x in tree.root.leaves()])
    spans, at = [], 0  # the leaves below each node, by preorder number

    def number(x: TreeNode) -> None:
        nonlocal at
        k, a = len(spans), at
        spans.append((a, a))
        if x.feature is None:
            at += 1
        else:
            number(x.left)
            number(x.right)
        spans[k] = (a, at)

    number(tree.root)

    def length(c: np.ndarray) -> float:
        c = c[c > 0]
        return float(-(c * np.log2(c / n)).sum())

    def states(p: np.ndarray) -> np.ndarray:
        if ctx.classes is not None:
            return p.astype(int)
        edges = p0 + np.arange(1, cells.bins) * ((p1 - p0) / cells.bins)
        return np.searchsorted(edges, p, side="right") if p1 > p0 else np.zeros(len(p), int)

    k_y = length(np.bincount(cells.state, cells.c))
    spread = cells.q.sum() / n - (cells.s.sum() / n) ** 2 if ctx.classes is None else 0.0
    p0, p1 = p.min(), p.max()
    p_state = states(p)
    joint = cells.joint(p_state, height)
    found: list[CandidateResult] = []
    waiting: list[tuple] = []

    def flush() -> None:
        texts = [w[2] for w in waiting]
        runs = pool.map(ctx.score.surfeit.surfeit_strings, [texts[k : k + 16] for k in range(0, len(texts), 16)])
        for (c, subset, text, bad, native), surfeit in zip(waiting, chain.from_iterable(runs)):
            c.tokens = list(range(len(ctx.features)))
            found.append(_scored(ctx, c, subset, len(text.encode()), surfeit, bad, native))
        waiting.clear()

    with ThreadPoolExecutor(4) as pool:
        for k, (root, pruned) in enumerate(chain([(tree.root, [])], pruning_steps(tree.root))):
            for number_, leaf in pruned:
                texts.prune(number_, leaf)
                a, b = spans[number_]
                joint -= cells.joint(p_state, height, a, b)
                p[a:b] = tree._leaf(leaf)
                p_state[a:b] = states(p[a : a + 1])[0]
                joint += cells.joint(p_state, height, a, b)
            if ctx.classes is None:
                if (p.min(), p.max()) != (p0, p1):
                    p0, p1 = p.min(), p.max()
                    p_state = states(p)
                    joint = cells.joint(p_state, height)
                v = p - cells.lo
                e = (cells.q - 2 * v * cells.s + cells.size * v * v).sum() / n
                native, equal = 1 - e / spread if spread else 0.0, abs(cells.lo - p0) <= 1e-8 + 1e-5 * abs(p0)
            else:
                native, equal = np.trace(joint) / n, True
            k_p, k_yp = length(joint.sum(1)), length(joint)
            top = max(k_y, k_p)
            bad = min(1.0, max(0.0, (k_yp - min(k_y, k_p)) / top)) if top > 0 else 0.0 if equal else 1.0
            leaves = str(sum(texts.used.values()) + 1)
            c = CandidateResult(
                f"decision_tree_{k}_leaves_{leaves}",
                "decision_tree",
                DecisionTree(ctx.features, root, ctx.classes),
                {"n_leaves": leaves},
            )
            waiting.append((c, texts.subset(), texts.text(), bad, float(native)))
            if len(waiting) == 64:
                flush()
        flush()
    return found


def evaluate(
    ctx: SearchContext, found: list[CandidateResult], notes: list[dict] | None = None
) -> list[CandidateResult]:
    """Candidates with components, combined and native scores; all share one scan for predictions and one for native scores.

    If that fails, each is evaluated by itself: those that cannot be are left out, with a note, and a native score that
    cannot be had is NaN.
    """
    if not found:
        return found
    try:
        return _evaluate_together(ctx, found)
    except Exception:  # one of them has, say, a prediction that is not finite
        done = []
        for c in found:
            try:
                done += _evaluate_together(ctx, [c])
            except Exception as e:
                (notes if notes is not None else []).append(failed(c.candidate, e))
        return done


def failed(candidate: str, error: Exception) -> dict:
    return {
        "reason": "fit_failed",
        "candidate": candidate,
        "error": str(error).splitlines()[0][:200] if str(error) else type(error).__name__,
    }


def _native_scores(ctx: SearchContext, wide: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """R squared or accuracy of each prediction column over counted rows; NaN where it cannot be computed."""
    y, c, n, spread = F.col("y"), F.col("c"), ctx.score.metric.n_samples, ctx.cells.spread
    if ctx.classes is None:
        aggs = [F.sum(F.col("q") + c * (y - F.col(p)) ** 2).alias(p) for p in names]
    else:
        aggs = [
            F.sum(F.when(y.cast("string") == F.col(p).cast("string"), c).otherwise(F.lit(0))).alias(p) for p in names
        ]
    try:
        r = wide.agg(*aggs).first()
    except Exception:
        return dict.fromkeys(names, float("nan"))
    if ctx.classes is None:
        return {p: 1 - r[p] / n / spread if spread else 0.0 for p in names}
    return {p: r[p] / n for p in names}


def _evaluate_together(ctx: SearchContext, found: list[CandidateResult]) -> list[CandidateResult]:
    names, t = [f"p{k}" for k in range(len(found))], ctx.cells
    y = F.col(t.mean) if ctx.classes is None else F.element_at(
        F.array(*map(F.lit, ctx.classes)), (F.col(t.state) + 1).cast("int")
    )
    wide = t.frame.select(
        y.alias("y"),
        *[F.col(x).alias(a) for x, a in ((t.state, "s"), (t.count, "c"), (t.within, "q"))],
        *[c.model.column().alias(n) for n, c in zip(names, found)],
    )
    numeric = {"y_type": "numeric", "state": "s", "low": t.lo}
    kind = numeric if ctx.classes is None else {"y_type": "categorical"}
    rows = inaccuracy_of_candidates(wide, "y", names, n_bins=ctx.score.n_bins, weight="c", **kind).collect()
    bad, native = {r["candidate"]: r["inaccuracy"] for r in rows}, _native_scores(ctx, wide, names)
    for n, c in zip(names, found):
        _finish(ctx, c, bad[n], native[n])
    return found


def _assembled(ctx: SearchContext, features: Sequence[str], points: DataFrame | None = None) -> DataFrame:
    """Vector, label and, of points, weight: of the rows, or of points that stand for them."""
    from pyspark.ml.feature import VectorAssembler

    if points is not None:
        label, more = F.col(ctx.cells.mean), [F.col(ctx.cells.count).cast("double").alias("weight")]
    else:
        label, more = F.col(ctx.target).cast("double") if ctx.classes is None else (
            F.array_position(F.array(*map(F.lit, ctx.classes)), F.col(ctx.target)) - 1
        ).cast("double"), []
    rows = (ctx.df if points is None else points).select(
        *[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)], label.alias("label"), *more
    )
    return VectorAssembler(
        inputCols=[f"f{k}" for k in range(len(features))], outputCol="features"
    ).transform(rows).drop(*[f"f{k}" for k in range(len(features))])


def quantile_steps(df: DataFrame, column: str, bins: int, weight: str | None = None) -> list[tuple[float, float]] | None:
    """The pairs of neighbouring values between which a column is cut at the exact quantiles k / bins (over all rows); None
    for a column of at most that many values, which needs no cuts.

    Values are counted, their counts summed over ranges; what comes to the driver are the pairs.
    """
    values = df.groupBy(F.col(column).cast("double").alias("x")).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("c")
    ).withColumn("g", F.lit(0))
    if values.limit(bins + 1).count() <= bins:
        return None
    n = values.agg(F.sum("c")).first()[0]
    up, c = F.col("up_c"), F.col("c")
    ends = prefix_sums(values, "g", "x", ["c"]).where(
        F.floor(up * bins / F.lit(float(n))) > F.floor((up - c) * bins / F.lit(float(n)))
    ).select("x").orderBy("x")
    cuts = np.array([r[0] for r in ends.collect()])
    part = F.pandas_udf(lambda x: pd.Series(np.searchsorted(cuts, x.to_numpy())), "int")
    starts = values.groupBy(part("x").alias("k")).agg(F.min("x").alias("x")).collect()
    after = {r["k"]: r["x"] for r in starts}
    return [(float(v), after[k + 1]) for k, v in enumerate(cuts) if k + 1 in after]


def fitted_tree(ctx: SearchContext, max_depth: int, max_bins: int):
    """A full tree of pyspark.ml, and the steps between the parts of those features that it has seen in parts.

    Spark takes the thresholds of features from a sample of max_bins ** 2 rows (10,000 at least) where there are more rows.
    So there features of more than max_bins values are cut at exact quantiles here, Spark gets the numbers of the parts, and
    so many bins that it reads all rows.
    """
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.regression import DecisionTreeRegressor

    kind = DecisionTreeRegressor if ctx.classes is None else DecisionTreeClassifier
    t = ctx.cells
    rows, steps = t.points, {}
    n = rows.count() if t.grouped else ctx.score.metric.n_samples
    if n > max(max_bins * max_bins, 10_000):
        found = {f: quantile_steps(rows, f, max_bins, t.count) for f in ctx.features}
        steps = {f: x for f, x in found.items() if x is not None}
        max_bins = math.isqrt(n) + 1
    for f, pairs in steps.items():
        lows = np.array([a for a, _ in pairs])
        part = F.pandas_udf(lambda x, lows=lows: pd.Series(np.searchsorted(lows, x.to_numpy()).astype(float)), "double")
        rows = rows.withColumn(f, part(f))
    options = {"weightCol": "weight"} if t.grouped else {}
    return kind(maxDepth=max_depth, maxBins=max_bins, seed=ctx.seed, **options).fit(
        _assembled(ctx, ctx.features, rows)
    ), steps


def search_tree(ctx: SearchContext, max_depth: int = 30, max_bins: int = 1024) -> SearchReport:
    """A full tree (to Spark's limit of depth) and its weakest-link pruning path; nested subtrees need no further fit."""
    found, notes, seen = [], [], set()
    for c in evaluate_nested(ctx, *grown_tree(ctx, *fitted_tree(ctx, max_depth, max_bins))):
        shape = tuple(c.subset), c.length, c.components["surfeit"], c.components["inaccuracy"], c.hyperparameters["n_leaves"]
        if shape in seen:
            notes.append({"reason": "duplicate_tree_structure", "candidate": c.candidate})
            continue
        seen.add(shape)
        found.append(c)
    return SearchReport("decision_tree", found, notes)


def search_ols(ctx: SearchContext, patience: int | None = None) -> SearchReport:
    """Every prefix of the feature order, solved from one Gram matrix."""
    order = ctx.order()
    if not order:
        return SearchReport("linear_regression", [], [{"reason": "empty_feature_order"}])
    g = gram(ctx.cells.points, order, ctx.cells.mean, ctx.cells.count)
    found = [
        CandidateResult(
            f"linear_regression_{p}",
            "linear_regression",
            LinearRegressor(order[:p], *solve_ols(g, p)),
            {"n_features": str(p)},
        )
        for p in range(1, len(order) + 1)
    ]
    notes: list[dict] = []
    found = evaluate(ctx, found, notes)
    if patience is None:
        return SearchReport("linear_regression", found, notes)
    best, kept = 0, []
    for k, c in enumerate(found):
        kept.append(c)
        best = k if c.combined < found[best].combined else best
        if k - best >= patience:
            return SearchReport(
                "linear_regression", kept, [*notes, {"reason": "early_stopping_patience", "n_features": k + 1}]
            )
    return SearchReport("linear_regression", kept, notes)


def search_logistic(ctx: SearchContext, max_iter: int = 1000) -> SearchReport:
    from pyspark.ml.classification import LogisticRegression

    order, found, notes, t = ctx.order(), [], [], ctx.cells
    options = {"weightCol": "weight"} if t.grouped else {}
    if not order:
        notes.append({"reason": "empty_feature_order"})
    for p in range(1, len(order) + 1):
        try:
            m = LogisticRegression(regParam=0.0, maxIter=max_iter, **options).fit(
                _assembled(ctx, order[:p], t.points)
            )
        except Exception as e:  # a family goes on without a prefix that does not fit
            notes.append({"reason": "logistic_fit_failed", "n_features": p, "error": str(e)[:200]})
            continue
        if m.summary.totalIterations >= max_iter:
            notes.append({"reason": "logistic_convergence_warning", "n_features": p})
        rows, b = m.coefficientMatrix.toArray().tolist(), m.interceptVector.toArray().tolist()
        found.append(
            CandidateResult(
                f"logistic_regression_{p}",
                "logistic_regression",
                LinearClassifier(order[:p], ctx.classes, rows, b),
                {"n_features": str(p), "iterations": str(m.summary.totalIterations)},
            )
        )
    return SearchReport("logistic_regression", evaluate(ctx, found, notes), notes)


def gaussian_moments(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """A row for each class: its count, means and population variances, in one pass."""
    return df.groupBy(F.col(target).alias("class")).agg(
        F.count(F.lit(1)).alias("n"),
        *[
            f(F.col(c).cast("double")).alias(f"{name}_{k}")
            for k, c in enumerate(features)
            for name, f in (("mean", F.avg), ("var", F.var_pop))
        ],
    ).orderBy("class")


def search_naive_bayes(ctx: SearchContext, var_smoothing: float = 1e-9) -> SearchReport:
    """Every prefix of the feature order, from one table of moments."""
    order, found, notes = ctx.order(), [], []
    if not order:
        return SearchReport("naive_bayes", [], [{"reason": "empty_feature_order"}])
    rows = gaussian_moments(ctx.df, order, ctx.target).collect()
    total = sum(r["n"] for r in rows)
    classes, priors = [r["class"] for r in rows], [r["n"] / total for r in rows]

    def spread(k: int) -> float:
        square = sum(r["n"] * (r[f"var_{k}"] + r[f"mean_{k}"] ** 2) for r in rows) / total
        return square - (sum(r["n"] * r[f"mean_{k}"] for r in rows) / total) ** 2

    for p in range(1, len(order) + 1):
        name = f"naive_bayes_{p}"
        try:
            eps = max(var_smoothing * max(map(spread, range(p))), 1e-300)
            means = [[r[f"mean_{k}"] for k in range(p)] for r in rows]
            m = GaussianNB(order[:p], classes, priors, means, [[r[f"var_{k}"] + eps for k in range(p)] for r in rows])
        except Exception as e:
            notes.append(failed(name, e))
            continue
        found.append(CandidateResult(name, "naive_bayes", m, {"n_features": str(p)}))
    return SearchReport("naive_bayes", evaluate(ctx, found, notes), notes)


def search_svc(ctx: SearchContext, C_values: Sequence[float] = (0.1, 1.0, 10.0), max_iter: int = 5000) -> SearchReport:
    """One machine a C (squared hinge loss, penalised intercept; one against the rest for three classes or more).

    Newton steps with halving; each pass over the data serves all (C, class) at once, on standardised features, with the
    penalty on the weights of the features as they are. A C that cannot be fitted is noted.
    """
    features, k = ctx.features, len(ctx.classes)
    grid, found, notes = [], [], []
    for C in dict.fromkeys(C_values):
        if C > 0 and C < float("inf"):
            grid += [(C, c) for c in (range(k) if k > 2 else [1])]
        else:
            notes.append(failed(f"linear_svc_C{C:g}", ValueError("C is positive and finite")))
    names, p = [f"f{i}" for i in range(len(features))], len(features) + 1
    t, data = ctx.cells, ctx.df.select(*[F.col(f).cast("double").alias(c) for f, c in zip(features, names)])
    r = data.agg(*[f(c).alias(f"{g}{c}") for c in names for g, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean, scale = (np.array([r[f"{g}{c}"] for c in names], float) for g in "ms")
    scale[scale == 0] = 1.0
    data = t.points.select(
        *[F.col(f).alias(c) for f, c in zip(features, names)], F.col(t.mean).alias("y"), F.col(t.count).alias("c")
    )
    to_raw = np.diag([*(1 / scale), 1.0])  # from weights of standardised features to those of the features as they are
    to_raw[-1, :-1] = -mean / scale
    penalty = to_raw.T @ to_raw
    size = p * p + p + 1

    def sums_at(points: Mapping[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Of the rows inside the margin at each point: X'X, X'y and the squared hinge loss."""

        def fold(x: np.ndarray) -> np.ndarray:
            a, c, out = np.column_stack([(x[:, :-2] - mean) / scale, np.ones(len(x))]), x[:, -1], []
            for g, u in points.items():
                y = np.where(x[:, -2] == grid[g][1], 1.0, -1.0)
                short = 1 - y * (a @ u)
                inside = short > 0
                b, w = a[inside], c[inside]
                out += [((b * w[:, None]).T @ b).ravel(), b.T @ (w * y[inside]), [w @ short[inside] ** 2]]
            return np.concatenate(out)

        flat = partial_sums(data, [*names, "y", "c"], fold, size * len(points))
        return dict(zip(points, flat.reshape(len(points), size)))

    # at: the weights, their loss and the next step with its slope; trial: the weights to be tried and the part of the step
    at: dict[int, tuple] = {}
    trial = {g: (np.zeros(p), 1.0) for g in range(len(grid))}
    for _ in range(max_iter):
        if not trial:
            break
        sums, tried, trial = sums_at({g: u for g, (u, _) in trial.items()}), trial, {}
        for g, (u, part) in tried.items():
            C, v = grid[g][0], sums[g]
            loss = 0.5 * u @ penalty @ u + C * v[-1]
            if g in at and not loss <= at[g][1] + 1e-4 * part * at[g][3]:
                if part > 1e-6:  # else the loss cannot be told from its rounding
                    trial[g] = at[g][0] + part / 2 * at[g][2], part / 2
                continue
            h = penalty + 2 * C * v[: p * p].reshape(p, p)
            slope = h @ u - 2 * C * v[p * p : -1]
            step = -np.linalg.lstsq(h, slope, rcond=None)[0]
            at[g] = u, loss, step, float(slope @ step)
            if -at[g][3] > 1e-12 * loss:
                trial[g] = u + step, 1.0
    for C in dict.fromkeys(C for C, _ in grid):
        name, own = f"linear_svc_C{C:g}", [g for g, (c, _) in enumerate(grid) if c == C]
        if any(g in trial for g in own):
            notes.append({"reason": "convergence_warning", "candidate": name, "max_iter": max_iter})
        raw = [to_raw @ at[g][0] for g in own]
        m = LinearSVC(features, ctx.classes, [w[:-1].tolist() for w in raw], [float(w[-1]) for w in raw])
        found.append(CandidateResult(name, "linear_svc", m, {"C": f"{C:g}"}))
    return SearchReport("linear_svc", evaluate(ctx, found, notes), notes)


def search_svr(
    ctx: SearchContext,
    C_values: Sequence[float] = (0.1, 1.0, 10.0),
    epsilons: Sequence[float] = (0.0, 0.1),
    max_iter: int = 50,
) -> SearchReport:
    """Squared epsilon-insensitive regression by Newton steps; each pass over the data serves all (C, epsilon) at once.

    A step needs sums over the rows outside the tube: those of all rows are had once, so a pass adds up the signs of the
    residuals and, where that is less, the rows inside the tube, else those outside. Without a tube all rows count.
    """
    p, grid = len(ctx.features) + 1, [(C, e) for C in dict.fromkeys(C_values) for e in dict.fromkeys(epsilons)]
    w, size, t, n = np.zeros((len(grid), p)), p * p + p, ctx.cells, ctx.score.metric.n_samples
    g, at = gram(t.points, ctx.features, t.mean, t.count), [*range(1, p), 0]
    xx, xy = g[np.ix_(at, at)], g[at, -1]
    x = [f"x{i}" for i in range(p)]
    rows = ctx.df.select(
        *[F.col(f).cast("double").alias(c) for f, c in zip(ctx.features, x)],
        F.lit(1.0).alias(x[-1]),
        F.col(ctx.target).cast("double").alias("y"),
    )

    def sums_at(points: Sequence[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Of the rows outside the tube around each point: X'X and X'(y - epsilon * sign)."""
        tubes = [k for k in points if grid[k][1]]
        out = {k: (xx, xy) for k in points}
        if not tubes:
            return out
        wide = rows.select("*", *[(F.col("y") - linear_column(x[:-1], w[k, :-1], w[k, -1])).alias(f"r{k}") for k in tubes])
        outside = {k: F.abs(f"r{k}") > grid[k][1] for k in tubes}
        r = wide.agg(
            *[F.count_if(outside[k]).alias(f"n{k}") for k in tubes],
            *[
                F.sum(F.when(outside[k], F.signum(f"r{k}") * F.col(c)).otherwise(0.0)).alias(f"{c}_{k}")
                for k in tubes
                for c in x
            ],
        ).first()
        few = [k for k in tubes if min(r[f"n{k}"], n - r[f"n{k}"])]
        taken = {k: r[f"n{k}"] * 2 < n for k in few}  # the rows outside are taken, or those inside
        parts = {}
        if few:
            any_ = reduce(lambda a, b: a | b, [outside[k] if taken[k] else ~outside[k] for k in few])
            columns = [*x, "y", *[f"r{k}" for k in few]]

            def fold(block: np.ndarray) -> np.ndarray:
                found = []
                for i, k in enumerate(few):
                    own = (np.abs(block[:, p + 1 + i]) > grid[k][1]) == taken[k]
                    a, y = block[own, :p], block[own, p]
                    found += [(a.T @ a).ravel(), a.T @ y]
                return np.concatenate(found)

            parts = dict(zip(few, partial_sums(wide.where(any_), columns, fold, size * len(few)).reshape(len(few), size)))
        for k in tubes:
            signs = np.array([r[f"{c}_{k}"] for c in x])
            if k in parts:
                a, b = parts[k][: p * p].reshape(p, p), parts[k][p * p :]
                a, b = (a, b) if taken[k] else (xx - a, xy - b)
            else:
                a, b = (xx, xy) if r[f"n{k}"] else (np.zeros_like(xx), np.zeros_like(xy))
            out[k] = a, b - grid[k][1] * signs
        return out

    ridge, done = np.diag([1.0] * (p - 1) + [1e-9]), np.zeros(len(grid), bool)
    names, notes, broken = [f"linear_svr_C{C:g}_e{e:g}" for C, e in grid], [], {}
    for _ in range(max_iter):
        for k, (a, b) in sums_at([k for k in range(len(grid)) if not done[k]]).items():
            C = grid[k][0]
            try:
                if C <= 0:
                    raise ValueError("C is positive")
                new = np.linalg.lstsq(2 * C * a + ridge, 2 * C * b, rcond=None)[0]
            except (ValueError, np.linalg.LinAlgError) as e:
                broken[k], done[k] = failed(names[k], e), True
                continue
            done[k] = np.abs(new - w[k]).max() <= 1e-6 * max(1.0, np.abs(new).max())
            w[k] = new
        if done.all():
            break
    found = []
    for k, (C, e) in enumerate(grid):
        if k in broken:
            notes.append(broken[k])
            continue
        if not done[k]:
            notes.append({"reason": "convergence_warning", "candidate": names[k], "max_iter": max_iter})
        own = {"C": f"{C:g}", "epsilon": f"{e:g}", "converged": str(bool(done[k])).lower()}
        found.append(
            CandidateResult(names[k], "linear_svr", LinearSVR(ctx.features, w[k, :-1].tolist(), float(w[k, -1])), own)
        )
    return SearchReport("linear_svr", evaluate(ctx, found, notes), notes)


def mlp_gradients(
    params: Sequence[np.ndarray], x: np.ndarray, y: np.ndarray, w: np.ndarray, kind: str
) -> list[np.ndarray]:
    """The sums over rows of weight w of the loss's gradients; params are the weights of all layers, then the biases."""
    acts, layers = [x], len(params) // 2
    for k in range(layers):
        z = acts[-1] @ params[k] + params[layers + k]
        acts.append(np.maximum(z, 0) if k < layers - 1 else z)
    if kind == "multiclass":
        e = np.exp(acts[-1] - acts[-1].max(1, keepdims=True))
        d = e / e.sum(1, keepdims=True) - y
    else:
        d = (1 / (1 + np.exp(-acts[-1])) if kind == "binary" else acts[-1]) - y
    d, grads = d * w[:, None], [np.empty(0)] * len(params)
    for k in reversed(range(layers)):
        grads[k], grads[layers + k] = acts[k].T @ d, d.sum(0)
        d = (d @ params[k].T) * (acts[k] > 0)
    return grads


def train_mlps(shapes: Sequence[Sequence[int]], gradients, seed: int, max_iter: int = 100) -> list[list[np.ndarray]]:
    """Full-batch Adam for several networks at once; gradients(all params) are the mean gradients of each."""
    nets = []
    for sizes in shapes:
        rng = np.random.default_rng(seed)
        nets.append(
            [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])] + [np.zeros(b) for b in sizes[1:]]
        )
    m, v = ([[np.zeros_like(q) for q in net] for net in nets] for _ in range(2))
    for t in range(1, max_iter + 1):
        for net, grads, a, b in zip(nets, gradients(nets), m, v):
            for q, g in enumerate(grads):
                a[q] += 0.1 * (g - a[q])
                b[q] += 0.001 * (g * g - b[q])
                net[q] = net[q] - 0.05 * (a[q] / (1 - 0.9**t)) / (np.sqrt(b[q] / (1 - 0.999**t)) + 1e-8)
    return nets


#: Distinct rows up to which a network's sums are taken on the driver, the numbers they may hold there, and rows of a block.
LOCAL_GROUPS, LOCAL_NUMBERS, BLOCK = 1 << 20, 1 << 23, 1 << 13


def _sorted(table, names: Sequence[str]) -> list[np.ndarray]:
    """The columns of an Arrow table as numbers, in an order that does not depend on the partitions."""
    cols = [table[c].to_numpy().astype(float) for c in names]
    at = np.lexsort(cols)
    return [c[at] for c in cols]


def search_mlp(
    ctx: SearchContext,
    max_candidates: int = 5,
    max_layers: int = 2,
    max_units: int = 6,
    min_gain: float = 1e-4,
    sample_rows: int | None = None,
) -> SearchReport:
    """Greedy growth from two features and three units: add a feature, a layer or a unit while the score improves.

    Networks are trained and evaluated on all rows: on counted distinct rows (of features, with means of the target, or of
    features and class), which give the same gradients, or with gradients summed by the tasks where there are more than
    LOCAL_GROUPS. `sample_rows` is accepted and has no effect.
    """
    order = ctx.order()
    names, k = [f"f{i}" for i in range(len(order))], len(ctx.classes or [])
    t, mid, spread = ctx.cells, 0.0, 1.0
    r = ctx.df.select(*[F.col(f).cast("double").alias(c) for f, c in zip(order, names)], (
        F.col(ctx.target).cast("double") if ctx.classes is None else F.lit(0.0)
    ).alias("y")).agg(
        F.avg("y").alias("y"),
        F.stddev_pop("y").alias("s"),
        *[f(c).alias(f"{g}{c}") for c in names for g, f in (("m", F.avg), ("s", F.stddev_pop))],
    ).first()
    data = t.points.select(
        *[F.col(f).alias(c) for f, c in zip(order, names)], F.col(t.mean).alias("y"), F.col(t.count).alias("c")
    )
    mean, scale = (np.array([r[f"{g}{c}"] for c in names], float) for g in "ms")
    scale[scale == 0] = 1.0
    if ctx.classes is None:
        kind, mid, spread = "regression", r["y"], r["s"] or 1.0
        groups = data.groupBy(*names).agg((F.sum(F.col("c") * F.col("y")) / F.sum("c")).alias("y"), F.sum("c").alias("c"))
    else:
        kind = "binary" if k == 2 else "multiclass"
        groups = data.groupBy(*names, "y").agg(F.sum("c").alias("c"))

    def wanted(y: np.ndarray) -> np.ndarray:
        """What the outputs are held against: the scaled target, the second class, or a column for each class."""
        return np.eye(k)[y.astype(int)] if kind == "multiclass" else ((y - mid) / spread)[:, None]

    most, x = min(LOCAL_GROUPS, LOCAL_NUMBERS // (len(names) + 2)), None
    found = groups.limit(most + 1).toArrow()
    if found.num_rows <= most:
        *x, y, w = _sorted(found, [*names, "y", "c"])
        x, y = (np.column_stack(x) - mean) / scale, wanted(y)
    outputs, n = k if k > 2 else 1, ctx.score.metric.n_samples

    def local(features: Sequence[int], pool: ThreadPoolExecutor):
        blocks = [slice(at, at + BLOCK) for at in range(0, len(x), BLOCK)]

        def gradients(nets: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
            def part(b: slice) -> list[list[np.ndarray]]:
                return [mlp_gradients(net, x[b, :p], y[b], w[b], kind) for p, net in zip(features, nets)]

            total = [[np.zeros_like(q) for q in net] for net in nets]
            for found in pool.map(part, blocks):
                for own, grads in zip(total, found):
                    for q, g in zip(own, grads):
                        q += g
            return [[q / n for q in own] for own in total]

        return gradients

    def summed(features: Sequence[int]):
        def gradients(nets: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
            def fold(block: np.ndarray) -> np.ndarray:
                z, y, c = (block[:, :-2] - mean) / scale, wanted(block[:, -2]), block[:, -1]
                return np.concatenate(
                    [g.ravel() for p, net in zip(features, nets) for g in mlp_gradients(net, z[:, :p], y, c, kind)]
                )

            flat = partial_sums(
                data, [*names, "y", "c"], fold, sum(q.size for net in nets for q in net)
            ) / n
            parts = iter(np.split(flat, np.cumsum([q.size for net in nets for q in net])[:-1]))
            return [[next(parts).reshape(q.shape) for q in net] for net in nets]

        return gradients

    tried: list[CandidateResult] = []
    notes: list[dict] = []

    def fit(states: Sequence[tuple[int, tuple[int, ...]]]) -> list[CandidateResult]:
        out, features = [], [p for p, _ in states]
        shapes = [(p, *hidden, outputs) for p, hidden in states]
        with ThreadPoolExecutor(8) as pool:
            nets = train_mlps(shapes, summed(features) if x is None else local(features, pool), ctx.seed)
        for (p, hidden), net in zip(states, nets):
            W, B = net[: len(hidden) + 1], net[len(hidden) + 1 :]
            W[-1], B[-1] = W[-1] * spread, B[-1] * spread + mid
            m = MLP(order[:p], ctx.classes, W, B, mean[:p].tolist(), scale[:p].tolist())
            out.append(
                CandidateResult(
                    f"mlp_{p}_{'x'.join(map(str, hidden))}",
                    "mlp",
                    m,
                    {"n_features": str(p), "hidden": ",".join(map(str, hidden))},
                )
            )
        return out

    state = (min(2, len(order)), (3,))
    seen = {state}
    first = evaluate(ctx, fit([state]), notes)
    if not first:
        return SearchReport("mlp", [], notes)
    best = first[0]
    tried.append(best)
    while len(tried) < max_candidates:
        p, hidden = state
        moves = ([(p + 1, hidden)] if p < len(order) else []) + (
            [(p, (*hidden, 3))] if len(hidden) < max_layers else []
        ) + (
            [(p, (*hidden[:-1], hidden[-1] + 1))] if hidden[-1] < max_units else []
        )
        moves = [m for m in moves if m not in seen][: max_candidates - len(tried)]
        if not moves:
            notes.append({"reason": "no_more_local_moves"})
            break
        seen |= set(moves)
        made = fit(moves)
        found = evaluate(ctx, made, notes)
        tried += found
        next_best = min(found, key=lambda c: c.combined, default=None)
        if next_best is None or best.combined - next_best.combined <= min_gain:
            notes.append({"reason": "no_score_improvement"})
            break
        best, state = next_best, moves[made.index(next_best)]
    return SearchReport("mlp", tried, notes)


SEARCHERS = {
    "decision_tree": search_tree,
    "logistic_regression": search_logistic,
    "linear_svc": search_svc,
    "naive_bayes": search_naive_bayes,
    "mlp": search_mlp,
    "linear_regression": search_ols,
    "linear_svr": search_svr,
}
CLASSIFIERS = ("decision_tree", "logistic_regression", "linear_svc", "naive_bayes", "mlp")
REGRESSORS = ("linear_regression", "decision_tree", "linear_svr", "mlp")


class _Auto:
    families: tuple[str, ...] = ()
    y_type = "auto"

    def __init__(
        self,
        models: Sequence[str] | str = "auto",
        *,
        X_type: str = "numeric",
        aggregation: str = "euclidean",
        weights=None,
        n_bins: int | str = "auto",
        random_state: int | None = None,
        options: Mapping[str, dict] | None = None,
    ):
        if isinstance(models, str) and models != "auto":
            raise ValueError("models is auto or a list of names")
        names = self.families if models == "auto" else tuple(dict.fromkeys(models))
        if not names or any(not isinstance(m, str) or m not in self.families for m in names):
            raise ValueError(f"models are of {', '.join(self.families)}")
        self.models, self.options, self.seed = names, dict(options or {}), random_state or 0
        self._score = (X_type, self.y_type, aggregation, weights, n_bins)

    def fit(
        self,
        df: DataFrame,
        features: Sequence[str],
        target: str,
        candidates: Mapping[str, Model] | Sequence | None = None,
    ) -> "_Auto":
        self.features, self.target = list(features), target
        self.score_ = CombinedScore(*self._score).fit(df, features, target)
        classes = [
            r[0] for r in df.select(target).distinct().orderBy(target).collect()
        ] if self.y_type == "categorical" else None
        if classes is not None and len(classes) < 2:
            raise ValueError("a classifier needs two classes or more")
        rows = df.select(
            *[F.col(f).cast("double").alias(f) if f != target else F.col(f) for f in self.features],
            *([] if target in features else [F.col(target)]),
        ).persist()
        self.classes_, ctx = classes, SearchContext(rows, self.features, target, self.score_, classes, self.seed)
        try:
            explicit = [] if candidates is None else self._explicit(ctx, candidates)
            self.reports = [SEARCHERS[m](ctx, **self.options.get(m, {})) for m in self.models]
            if explicit:
                notes: list[dict] = []
                self.reports.append(SearchReport("explicit", evaluate(ctx, explicit, notes), notes))
        finally:
            ctx.close()
            rows.unpersist()
        self.candidates = sorted((c for r in self.reports for c in r.candidates), key=lambda c: c.combined)
        if not self.candidates:
            raise ValueError("no candidate could be fitted")
        self.best_result, self.spark = self.candidates[0], df.sparkSession
        return self

    @staticmethod
    def _explicit(ctx: SearchContext, candidates) -> list[CandidateResult]:
        """Candidates are models of this library, fitted models of pyspark.ml over the features, or its unfitted estimators."""
        from pyspark.ml import Estimator

        if isinstance(candidates, str) or not len(candidates):
            raise ValueError("candidates are models, a mapping, or (name, model) pairs")
        pairs = candidates.items() if isinstance(candidates, Mapping) else [
            c if isinstance(c, tuple) else (f"{type(c).__name__}_{i}", c) for i, c in enumerate(candidates)
        ]
        own = [
            (
                name,
                fit_ml(m, _assembled(ctx, ctx.features), ctx.features, ctx.classes)
                if isinstance(m, Estimator)
                else from_ml(m, ctx.features, ctx.classes),
            )
            for name, m in pairs
        ]
        return [CandidateResult(name, "explicit", m, {}) for name, m in own]

    def get_model(self) -> Model:
        return self.best_result.model

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        return self.best_result.model.transform(df, prediction)

    predict = transform

    def score(self, df: DataFrame) -> float:
        """R squared or accuracy of the best model."""
        y, p = F.col(self.target), self.best_result.model.column()
        if self.classes_ is not None:
            return df.agg(F.avg((y.cast("string") == p.cast("string")).cast("double"))).first()[0]
        r = df.agg(F.var_pop(y.cast("double")).alias("v"), F.avg((y - p) ** 2).alias("e")).first()
        return 1 - r["e"] / r["v"] if r["v"] else 0.0

    def combined_score(self) -> float:
        return self.best_result.combined

    def components(self) -> dict[str, float]:
        return dict(self.best_result.components)

    def model_string(self) -> str:
        return self.best_result.text

    def explain(self) -> dict:
        b = self.best_result
        return self.score_.explain_components(b.components) | {
            "candidate_name": b.candidate,
            "model_type": type(b.model).__name__,
            "model_family": b.family,
            "hyperparameters": b.hyperparameters,
        }

    def results_dataframe(self) -> DataFrame:
        rows = [
            (
                c.candidate,
                c.family,
                type(c.model).__name__,
                c.hyperparameters,
                c.combined,
                *[c.components[k] for k in COMPONENTS],
                c.native,
                c.subset,
                len(c.subset),
                c.length,
            )
            for c in self.candidates
        ]
        return self.spark.createDataFrame(rows, RESULTS).orderBy("combined")

    def diagnostics_dataframe(self) -> DataFrame:
        rows = [
            (r.family, d["reason"], {k: str(v) for k, v in d.items() if k != "reason"})
            for r in self.reports
            for d in r.diagnostics
        ]
        return self.spark.createDataFrame(rows, "family string, reason string, details map<string,string>")

    def candidate_model_description(self, candidate: str | None = None) -> dict:
        found = self.best_result if candidate is None else next(
            (c for c in self.candidates if c.candidate == candidate), None
        )
        if found is None:
            raise KeyError(f"no candidate {candidate}; there are {', '.join(c.candidate for c in self.candidates[:8])}")
        length, compressed = self.score_.surfeit.description_lengths(found.text)
        return {
            "candidate": found.candidate,
            "family": found.family,
            "model_type": type(found.model).__name__,
            "model_string": found.text,
            "model_length": length,
            "model_compressed_length": compressed,
            "surfeit": found.components["surfeit"],
        }


class Classifier(_Auto):
    families, y_type = CLASSIFIERS, "categorical"

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """df with the map probability: class to probability, where the best model has them."""
        return df.withColumn(
            "probability",
            F.create_map(
                *[x for c, p in zip(self.classes_, self.best_result.model.probabilities()) for x in (F.lit(c), p)]
            ),
        )

    def decision_function(self, df: DataFrame) -> DataFrame:
        """df with the array decision: one margin for two classes, or a score for each class, where the best model has them."""
        return df.withColumn("decision", F.array(*self.best_result.model.scores()))


class Regressor(_Auto):
    families, y_type = REGRESSORS, "numeric"
