"""Models as small driver-side values: each has a subset, a description and a prediction as a Spark expression.

Predictions are Columns, so any number of candidates is evaluated in one scan and within generated code.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevispark.functions.text import class_token, feature_token, sci_number


def partial_sums(
    df: DataFrame, columns: Sequence[str], fold: Callable[[np.ndarray], np.ndarray], size: int
) -> np.ndarray:
    """The sum over all rows of fold(block of rows), a vector of `size`; each task sends one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += fold(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "v"])

    out = np.zeros(size)
    for r in df.select(
        *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)]
    ).mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def gram(df: DataFrame, features: Sequence[str], target: str, weight: str | None = None) -> np.ndarray:
    """X'X of the rows (1, features, target), in one pass; every OLS prefix is solved from it.

    A row can stand for weight rows with these features and this mean of the target; then the square of the target is less.
    """
    p = len(features) + 2

    def fold(x: np.ndarray) -> np.ndarray:
        a = np.column_stack([np.ones(len(x)), x[:, : p - 1]])
        return (a.T @ a if weight is None else (a * x[:, -1:]).T @ a).ravel()

    sums = partial_sums(df, [*features, target, *([] if weight is None else [weight])], fold, p * p)
    return sums.reshape(p, p)


def solve_ols(g: np.ndarray, p: int) -> tuple[list[float], float]:
    """Coefficients and intercept of the first p features; the smallest solution where they are dependent."""
    n = g[0, 0]
    mean = g[0] / n
    c = g / n - np.outer(mean, mean)
    a, b = c[1 : p + 1, 1 : p + 1], c[1 : p + 1, -1]
    scale = np.sqrt(np.maximum(np.diag(a), 0))
    scale[scale == 0] = 1.0
    w = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-10)[0] / scale
    return w.tolist(), float(mean[-1] - w @ mean[1 : p + 1])


def linear_column(features: Sequence[str], coefficients: Sequence[float], intercept: float) -> Column:
    out = F.lit(float(intercept))
    for f, w in zip(features, coefficients):
        if w:
            out = out + F.lit(float(w)) * F.col(f)
    return out


def linear_text(coefficients: Sequence[float], intercept: float, name: str = "x[{}]") -> str:
    """b+w*x[i]... with merged signs, without zero terms."""
    terms = [sci_number(intercept)] if intercept else []
    terms += [f"{sci_number(w)}*{name.format(i)}" for i, w in enumerate(coefficients) if w]
    return "".join(t if not k or t.startswith("-") else f"+{t}" for k, t in enumerate(terms)) or "0"


def argmax_lines(expressions: Sequence[str]) -> list[str]:
    lines = [f" s0={expressions[0]}", " best=0", " best_s=s0"]
    for k, e in enumerate(expressions[1:], 1):
        lines += [f" s{k}={e}", f" if s{k}>best_s:", f"  best={k}", f"  best_s=s{k}"]
    return [*lines, " return best"]


def argmax_column(scores: Sequence[Column], classes: Sequence) -> Column:
    best, out = scores[0], F.lit(classes[0])
    for s, c in zip(scores[1:], classes[1:]):
        out = F.when(s > best, F.lit(c)).otherwise(out)
        best = F.greatest(best, s)
    return out


def softmax_columns(scores: Sequence[Column]) -> list[Column]:
    top = F.greatest(*scores)
    e = [F.exp(s - top) for s in scores]
    total = e[0]
    for x in e[1:]:
        total = total + x
    return [x / total for x in e]


@dataclass
class ModelArtifacts:
    subset: list[int]
    predictions: str
    model_string: str
    model_type: str

    def to_score_kwargs(self) -> dict:
        return {"subset": self.subset, "prediction": self.predictions, "description": self.model_string}


@dataclass
class Model:
    features: list[str]

    def subset(self) -> list[int]:
        raise NotImplementedError

    def text(self, tokens: Sequence[int] | None = None) -> str:
        raise NotImplementedError

    def column(self) -> Column:
        raise NotImplementedError

    def probabilities(self) -> list[Column]:
        raise TypeError(f"{type(self).__name__} has no probabilities")

    def scores(self) -> list[Column]:
        """What is compared to decide: one margin for two classes, or a score for each class."""
        raise TypeError(f"{type(self).__name__} has no scores")

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        return df.withColumn(prediction, self.column())


@dataclass
class LinearRegressor(Model):
    coefficients: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def subset(self) -> list[int]:
        return [i for i, w in enumerate(self.coefficients) if w]

    def text(self, tokens: Sequence[int] | None = None) -> str:
        at = list(tokens or range(len(self.features)))
        lines = [f" y = {sci_number(self.intercept)}"]
        lines += [
            f" y {'+' if w > 0 else '-'}= {sci_number(abs(w))}*{feature_token(at[i])}"
            for i, w in enumerate(self.coefficients)
            if w
        ]
        return "\n".join(
            [f"def predict({', '.join(feature_token(at[i]) for i in self.subset())}):", *lines, " return y"]
        ) + "\n"

    def column(self) -> Column:
        return linear_column(self.features, self.coefficients, self.intercept)


@dataclass
class LinearSVR(LinearRegressor):
    def text(self, tokens: Sequence[int] | None = None) -> str:
        return f"def predict(x):\n y={linear_text(self.coefficients, self.intercept)}\n return y\n"


@dataclass
class LinearClassifier(Model):
    """Logistic regression: one row of coefficients for two classes, one for each class of more."""

    classes: list = field(default_factory=list)
    rows: list[list[float]] = field(default_factory=list)
    intercepts: list[float] = field(default_factory=list)

    def subset(self) -> list[int]:
        return [i for i in range(len(self.features)) if any(r[i] for r in self.rows)]

    def text(self, tokens: Sequence[int] | None = None) -> str:
        parts = [linear_text(r, b) for r, b in zip(self.rows, self.intercepts)]
        body = [f" z={parts[0]}", " if z>0:", "  return 1", " return 0"] if len(parts) == 1 else argmax_lines(parts)
        return "\n".join(["def predict(x):", *body]) + "\n"

    def scores(self) -> list[Column]:
        return [linear_column(self.features, r, b) for r, b in zip(self.rows, self.intercepts)]

    def column(self) -> Column:
        s = self.scores()
        return F.when(
            s[0] > 0, F.lit(self.classes[1])
        ).otherwise(F.lit(self.classes[0])) if len(s) == 1 else argmax_column(s, self.classes)

    def probabilities(self) -> list[Column]:
        s = self.scores()
        return softmax_columns([F.lit(0.0), s[0]] if len(s) == 1 else s)


@dataclass
class LinearSVC(LinearClassifier):
    def probabilities(self) -> list[Column]:
        return Model.probabilities(self)


@dataclass
class GaussianNB(Model):
    classes: list = field(default_factory=list)
    priors: list[float] = field(default_factory=list)
    means: list[list[float]] = field(default_factory=list)
    variances: list[list[float]] = field(default_factory=list)

    def subset(self) -> list[int]:
        return [
            i
            for i in range(len(self.features))
            if len({m[i] for m in self.means}) > 1 or len({v[i] for v in self.variances}) > 1
        ]

    def text(self, tokens: Sequence[int] | None = None) -> str:
        out = []
        for prior, m, v in zip(self.priors, self.means, self.variances):
            terms = [sci_number(math.log(prior))] if prior != 1 else []
            for i in self.subset():
                c = -0.5 * math.log(2 * math.pi * v[i])
                terms += ([sci_number(c)] if c else []) + [f"-((x[{i}]-{sci_number(m[i])})**2)/{sci_number(2 * v[i])}"]
            out.append("".join(t if not k or t.startswith("-") else f"+{t}" for k, t in enumerate(terms)) or "0")
        return "\n".join(["def predict(x):", *argmax_lines(out)]) + "\n"

    def scores(self) -> list[Column]:
        out = []
        for prior, m, v in zip(self.priors, self.means, self.variances):
            s = F.lit(math.log(prior))
            for f, mean, var in zip(self.features, m, v):
                s = s + F.lit(
                    -0.5 * math.log(2 * math.pi * var)
                ) - (F.col(f) - F.lit(mean)) * (F.col(f) - F.lit(mean)) / F.lit(2 * var)
            out.append(s)
        return out

    def column(self) -> Column:
        return argmax_column(self.scores(), self.classes)

    def probabilities(self) -> list[Column]:
        return softmax_columns(self.scores())


@dataclass
class TreeNode:
    value: float | list[float]
    weight: float
    risk: float
    feature: int | None = None
    threshold: float = 0.0
    left: "TreeNode | None" = None
    right: "TreeNode | None" = None

    def leaves(self) -> list["TreeNode"]:
        return [self] if self.feature is None else [*self.left.leaves(), *self.right.leaves()]

    def shape(self) -> tuple:
        return () if self.feature is None else (
            self.feature, round(self.threshold, 12), self.left.shape(), self.right.shape()
        )


#: Leaves of the largest tree that becomes one expression of generated code.
MAX_WALKED = 64


@dataclass
class DecisionTree(Model):
    root: TreeNode | None = None
    classes: list | None = None

    def subset(self) -> list[int]:
        used: set[int] = set()

        def walk(n: TreeNode) -> None:
            if n.feature is not None:
                used.add(n.feature)
                walk(n.left)
                walk(n.right)

        walk(self.root)
        return sorted(used)

    def _leaf(self, n: TreeNode) -> int | float:
        return int(np.argmax(n.value)) if self.classes is not None else n.value

    def text(self, tokens: Sequence[int] | None = None) -> str:
        at = list(tokens or range(len(self.features)))

        def lines(n: TreeNode, depth: int) -> list[str]:
            pad = " " * depth
            if n.feature is None:
                return [
                    f"{pad}return {class_token(self._leaf(n)) if self.classes is not None else sci_number(n.value)}"
                ]
            return [
                f"{pad}if {feature_token(at[n.feature])}<={sci_number(n.threshold)}:",
                *lines(n.left, depth + 1),
                f"{pad}else:",
                *lines(n.right, depth + 1),
            ]

        return "\n".join(
            [f"def predict({', '.join(feature_token(at[i]) for i in self.subset())}):", *lines(self.root, 1)]
        ) + "\n"

    def _walk(self, leaf: Callable[[TreeNode], Column]) -> Column:
        def go(n: TreeNode) -> Column:
            return leaf(n) if n.feature is None else F.when(
                F.col(self.features[n.feature]) <= F.lit(n.threshold), go(n.left)
            ).otherwise(go(n.right))

        return go(self.root)

    def leaf_column(self) -> Column:
        """The number of a row's leaf, from left to right, by arrays: a tree of any size is one expression."""
        feature, threshold, left, right, number = [], [], [], [], []

        def lay(n: TreeNode) -> int:
            k = len(feature)
            feature.append(0 if n.feature is None else n.feature)
            threshold.append(n.threshold)
            left.append(k)
            right.append(k)
            number.append(-1)
            if n.feature is None:
                number[k] = lay.leaves
                lay.leaves += 1
            else:
                left[k] = lay(n.left)
                right[k] = lay(n.right)
            return k

        lay.leaves = 0
        lay(self.root)
        f, t, a, b, leaf = np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(number)

        def run(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            rows, at = np.arange(len(x)), np.zeros(len(x), int)
            while (leaf[at] < 0).any():
                at = np.where(x[rows, f[at]] <= t[at], a[at], b[at])
            return pd.Series(leaf[at])

        return F.pandas_udf(run, "int")(*[F.col(c).cast("double") for c in self.features])

    def _of_leaf(self, leaf: Callable[[TreeNode], object]) -> Column:
        """leaf(n) of a row's leaf n: in generated code for small trees, else looked up by the leaf's number."""
        leaves = self.root.leaves()
        if len(leaves) <= MAX_WALKED:
            return self._walk(lambda n: F.lit(leaf(n)))
        values = list(dict.fromkeys(leaf(n) for n in leaves))
        if len(values) <= MAX_WALKED:
            at = {v: k for k, v in enumerate(values)}
            which, table = np.array([at[leaf(n)] for n in leaves]), F.array(*map(F.lit, values))
            return F.element_at(
                table, F.pandas_udf(lambda s: pd.Series(which[s.to_numpy()] + 1), "int")(self.leaf_column())
            )
        numbers = np.array([leaf(n) for n in leaves], float)
        return F.pandas_udf(lambda s: pd.Series(numbers[s.to_numpy()]), "double")(self.leaf_column())

    def column(self) -> Column:
        return self._of_leaf(lambda n: self.classes[self._leaf(n)] if self.classes is not None else float(n.value))

    def probabilities(self) -> list[Column]:
        if self.classes is None:
            return super().probabilities()
        return [self._of_leaf(lambda n, k=k: float(n.value[k] / sum(n.value))) for k in range(len(self.classes))]


def pruning_steps(root: TreeNode, tolerance: float = 1e-12) -> Iterator[tuple[TreeNode, list[tuple[int, TreeNode]]]]:
    """Each step of weakest-link pruning: the tree after it, and the nodes (preorder number, new leaf) it made leaves.

    Trees share what did not change; a step costs the paths from its nodes to the root.
    """
    now, parent, end = [], [], []

    def number(n: TreeNode, up: int) -> None:
        k = len(now)
        now.append(n)
        parent.append(up)
        end.append(k)
        if n.feature is not None:
            number(n.left, k)
            number(n.right, k)
        end[k] = len(now)

    number(root, -1)
    inner = [n.feature is not None for n in now]
    size, risk = [1] * len(now), [n.risk for n in now]
    right = [end[k + 1] if inner[k] else -1 for k in range(len(now))]
    for k in reversed(range(len(now))):
        if inner[k]:
            size[k], risk[k] = size[k + 1] + size[right[k]], risk[k + 1] + risk[right[k]]
    own = lambda k: (now[k].risk - risk[k]) / (size[k] - 1)
    value = {k: own(k) for k in range(len(now)) if inner[k]}
    heap = [(v, k) for k, v in value.items()]
    heapq.heapify(heap)
    while inner[0]:
        while value.get(heap[0][1]) != heap[0][0]:
            heapq.heappop(heap)
        limit, picked = max(0.0, heap[0][0]) * (1 + tolerance) + tolerance, set()
        while heap and heap[0][0] <= limit:
            v, k = heapq.heappop(heap)
            if value.get(k) == v:
                picked.add(k)
        done, dirty = [], set()
        for k in sorted(picked):
            if not inner[k]:  # below one of this step
                continue
            for x in range(k, end[k]):
                inner[x] = False
                value.pop(x, None)
            less, more, up = size[k] - 1, now[k].risk - risk[k], parent[k]
            now[k] = TreeNode(now[k].value, now[k].weight, now[k].risk)
            done.append((k, now[k]))
            while up >= 0:
                size[up], risk[up] = size[up] - less, risk[up] + more
                dirty.add(up)
                up = parent[up]
        for k in sorted(dirty, reverse=True):
            n = now[k]
            now[k] = TreeNode(n.value, n.weight, n.risk, n.feature, n.threshold, now[k + 1], now[right[k]])
            value[k] = own(k)
            heapq.heappush(heap, (value[k], k))
        yield now[0], done


def pruning_path(root: TreeNode, tolerance: float = 1e-12) -> list[TreeNode]:
    """The nested trees of weakest-link pruning, from the full tree to the root alone."""
    return [root, *(tree for tree, _ in pruning_steps(root, tolerance))]


ACTIVATIONS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "identity": ("v", lambda s: s),
    "relu": ("max(0,v)", lambda s: F.greatest(F.lit(0.0), s)),
    "logistic": ("1/(1+E**-v)", lambda s: F.lit(1.0) / (F.lit(1.0) + F.exp(-s))),
    "tanh": ("(E**v-E**-v)/(E**v+E**-v)", F.tanh),
}


@dataclass
class MLP(Model):
    """Dense layers with an activation between them, over standardised inputs (as they are without mean)."""

    classes: list | None = None
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    activation: str = "relu"

    def __post_init__(self):
        if self.activation not in ACTIVATIONS:
            raise ValueError(f"an activation is one of {', '.join(ACTIVATIONS)}")

    def subset(self) -> list[int]:
        return [i for i in range(len(self.features)) if (self.weights[0][i] != 0).any()]

    def text(self, tokens: Sequence[int] | None = None) -> str:
        at = list(tokens or range(len(self.features)))
        nest = lambda a: "[" + ",".join(nest(x) if getattr(x, "ndim", 0) else sci_number(x) for x in a) + "]"
        prefix = [
            "P StandardScaler",
            *[
                f" {feature_token(i)} = ({feature_token(i)}-{sci_number(m)})/{sci_number(s)}"
                for i, m, s in zip(at, self.mean, self.scale)
            ],
        ] if self.mean else []
        between = ACTIVATIONS[self.activation][0]
        body = [
            "def predict(x):",
            *([f" E={math.e}"] if "E" in between else []),
            " W=[" + ",".join(map(nest, self.weights)) + "]",
            " B=[" + ",".join(map(nest, self.biases)) + "]",
            " a=[" + ",".join(f"x[{i}]" for i in range(len(self.features))) + "]",
            " for l in range(len(W)):",
            "  z=[]",
            "  for j in range(len(B[l])):",
            "   s=B[l][j]",
            "   for i in range(len(a)):",
            "    s+=a[i]*W[l][i][j]",
            "   z.append(s)",
            *(
                ["  if l<len(W)-1:", f"   a=[{between} for v in z]", "  else:", "   a=z"]
                if self.activation != "identity"
                else ["  a=z"]
            ),
        ]
        if self.classes is None:
            body.append(" return a[0]")
        elif len(self.biases[-1]) == 1:
            body += [" if a[0]>0:", "  return 1", " return 0"]
        else:
            body += [" best=0", " for k in range(1,len(a)):", "  if a[k]>a[best]:", "   best=k", " return best"]
        return "\n".join([*prefix, *body]) + "\n"

    def outputs(self) -> list[Column]:
        a = [
            (F.col(f) - F.lit(m)) / F.lit(s) for f, m, s in zip(self.features, self.mean, self.scale)
        ] if self.mean else [F.col(f).cast("double") for f in self.features]
        for layer, (w, b) in enumerate(zip(self.weights, self.biases)):
            z = []
            for j in range(len(b)):
                s = F.lit(float(b[j]))
                for i, x in enumerate(a):
                    s = s + x * F.lit(float(w[i][j]))
                z.append(ACTIVATIONS[self.activation][1](s) if layer < len(self.weights) - 1 else s)
            a = z
        return a

    def scores(self) -> list[Column]:
        return self.outputs() if self.classes is not None else super().scores()

    def column(self) -> Column:
        a = self.outputs()
        if self.classes is None:
            return a[0]
        return F.when(
            a[0] > 0, F.lit(self.classes[1])
        ).otherwise(F.lit(self.classes[0])) if len(a) == 1 else argmax_column(a, self.classes)

    def probabilities(self) -> list[Column]:
        if self.classes is None:
            return super().probabilities()
        a = self.outputs()
        return softmax_columns([F.lit(0.0), a[0]] if len(a) == 1 else a)


def artifacts(model: Model, features: Sequence[str] | None = None, prediction: str = "prediction") -> ModelArtifacts:
    """Subset (as indices of features, if given), description and type of a model; other kinds of models are refused."""
    if not isinstance(model, Model):
        raise TypeError(f"no description for {type(model).__name__}")
    at = [list(features).index(f) for f in model.features] if features is not None else list(range(len(model.features)))
    return ModelArtifacts([at[i] for i in model.subset()], prediction, model.text(at), type(model).__name__)
