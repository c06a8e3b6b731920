"""Order statistics, prefix sums and two-means against NumPy, and that no task holds a whole column; searches that go on."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevispark.operators import automl, order
from brevispark.operators.anomalies import robust_scale, two_means_1d
from brevispark.operators.automl import Classifier, Regressor
from brevispark.operators.models import LinearRegressor
from brevispark.operators.surfeit import Surfeit


@pytest.mark.parametrize("few", [3, 50_000])
@pytest.mark.parametrize("kind", ["normal", "ties", "constant", "skewed", "third"])
def test_quantiles_are_exact(spark, monkeypatch, few, kind):
    monkeypatch.setattr(order, "FEW", few)
    rng = np.random.default_rng(4)
    x = {
        "normal": rng.normal(size=3001),
        "ties": rng.integers(0, 40, 2500).astype(float),
        "constant": np.full(500, 7.0),
        "skewed": np.exp(rng.normal(size=2000) * 4),
        "third": np.concatenate([np.full(1000, 0.5), rng.normal(size=2000)]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
    for q in (0.0, 0.5, 0.95, 1.0):
        assert order.quantile(df, "x", q) == pytest.approx(np.quantile(x, q), rel=1e-12, abs=1e-12)
    places = [0, 1, len(x) // 2, len(x) - 1]
    for p in places:
        assert order.order_statistics(df, "x", [p]) == [np.sort(x)[p]]
    mad = np.median(np.abs(x - np.median(x)))
    assert robust_scale(df, "x") == pytest.approx(1.4826 * mad or x.std() or 1.0)


def test_quantile_of_nothing(spark):
    none = spark.createDataFrame([], "x double")
    assert order.quantile(none, "x", 0.5) is None
    with pytest.raises(ValueError):
        order.order_statistics(none, "x", [0])


def test_prefix_sums_by_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(g, i, int(v)) for g, n in ((0, 3000), (1, 10), (2, 1)) for i, v in enumerate(rng.integers(0, 9, n))]
    df = spark.createDataFrame(rows, "g int, i int, v long").repartition(6)
    got = {(r["g"], r["i"]): r["up_v"] for r in order.prefix_sums(df, "g", "i", ["v"]).collect()}
    want, total = {}, {}
    for g, i, v in rows:
        total[g] = total.get(g, 0) + v
        want[g, i] = total[g]
    assert got == want


def test_no_task_holds_a_group(spark):
    """30,000 rows of one group: the ranges of its values are spread over the tasks."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(30_000).select(F.lit(0).alias("g"), F.col("id").cast("double").alias("v"), F.lit(1).alias("c"))
        out = order.prefix_sums(df, "g", "v", ["c"])
        seen = out.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in seen) < 10_000 and out.agg(F.max("up_c")).first()[0] == 30_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_two_means_by_brute_force(spark):
    rng = np.random.default_rng(7)
    values = {
        "a": np.concatenate([rng.normal(0, 1, 60), rng.normal(9, 2, 30)]),
        "b": rng.integers(0, 3, 50).astype(float),
        "c": np.full(8, 4.0),
    }
    df = spark.createDataFrame([(g, float(v)) for g, x in values.items() for v in x], "g string, v double")
    got = {r["g"]: r for r in two_means_1d(df, "g", "v").collect()}
    for g, x in values.items():
        z = np.sort((x - x.mean()) / (x.std() or 1.0))
        best = min(
            (((z[:k] - z[:k].mean()) ** 2).sum() + ((z[k:] - z[k:].mean()) ** 2).sum(), k)
            for k in range(1, len(z))
            if z[k] > z[k - 1]
        ) if z[0] < z[-1] else (0.0, len(z))
        assert got[g]["inertia"] == pytest.approx(best[0], abs=1e-9)
        assert (got[g]["cluster_0_size"], got[g]["cluster_1_size"]) == (best[1], len(z) - best[1])


def test_searches_go_on_without_what_fails(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), float(2 * a + b), "yes" if a > 0 else "no") for a, b in rng.normal(size=(200, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y double, k string")
    fit = Regressor(["linear_svr"], options={"linear_svr": {"C_values": (0.0, 1.0)}}).fit(df, ["a", "b"], "y")
    notes = fit.diagnostics_dataframe().collect()
    assert {r["reason"] for r in notes} == {"fit_failed"} and len(notes) == 2 and len(fit.candidates) == 2
    fit = Regressor(["linear_svr"], options={"linear_svr": {"max_iter": 1}}).fit(df, ["a", "b"], "y")
    assert {
        r["reason"] for r in fit.diagnostics_dataframe().collect()
    } == {"convergence_warning"} and len(fit.candidates) == 6
    broken = {"sound": LinearRegressor(["a"], [2.0], 0.0), "broken": LinearRegressor(["a"], [float("inf")], 0.0)}
    fit = Regressor(["linear_regression"]).fit(df, ["a", "b"], "y", candidates=broken)
    assert {
        c.candidate for c in fit.candidates
    } >= {"sound", "linear_regression_1"} and "broken" not in {c.candidate for c in fit.candidates}
    assert [r["details"]["candidate"] for r in fit.diagnostics_dataframe().collect()] == ["broken"]
    fit = Classifier(
        ["linear_svc"], options={"linear_svc": {"C_values": (-1.0, 1.0), "max_iter": 3}}
    ).fit(df, ["a", "b"], "k")
    assert {
        (r["reason"], r["details"]["candidate"]) for r in fit.diagnostics_dataframe().collect()
    } >= {("fit_failed", "linear_svc_C-1")}
    assert [c.candidate for c in fit.candidates] == ["linear_svc_C1"]
    with pytest.raises(ValueError):
        Classifier("linear_svc")


def test_linear_machines_reach_their_minimum_in_few_passes(spark, monkeypatch):
    rng, n = np.random.default_rng(5), 400
    x = np.column_stack([rng.uniform(1e3, 5e5, n), rng.integers(1, 13, n)])
    labels = np.array(["F", "O", "P"])[rng.integers(0, 3, n)]
    df = spark.createDataFrame([(*map(float, r), str(c)) for r, c in zip(x, labels)], "a double, b double, k string")
    passes, sums = [], automl.partial_sums
    monkeypatch.setattr(automl, "partial_sums", lambda *args: passes.append(args) or sums(*args))
    fit = Classifier(["linear_svc"]).fit(df, ["a", "b"], "k")
    assert len(fit.candidates) == 3 and not fit.diagnostics_dataframe().count() and 0 < len(passes) < 30
    ones = np.column_stack([x, np.ones(n)])
    size = np.abs(ones).sum(0)
    for c in fit.candidates:
        C = float(c.hyperparameters["C"])
        for name, w, b in zip("FOP", c.model.rows, c.model.intercepts):
            u, y = np.array([*w, b]), np.where(labels == name, 1.0, -1.0)
            slope = u - 2 * C * ones.T @ (y * np.maximum(0, 1 - y * (ones @ u)))  # of |u|^2 / 2 + C sum of squared hinges
            assert (np.abs(slope) < 1e-7 * C * size).all()


def test_texts_with_a_common_beginning_are_compressed_once(monkeypatch):
    rng = np.random.default_rng(6)
    lines = [f" return {v:.2e}\n" for v in rng.normal(size=20_000)]
    texts = []
    for k in rng.integers(0, 20_000, 40):  # each like the one before, with a line changed and others left out behind it
        lines = [*lines[: k % len(lines)], " return 0\n", *lines[k % len(lines) + 9 :]]
        texts.append("".join(lines))
    texts += [texts[0][:5], texts[0], texts[0], "x"]
    read, real = [0], zlib.compressobj

    class Counted:
        def __init__(self, c):
            self.c = c

        def compress(self, b):
            read[0] += len(b)
            return self.c.compress(b)

        def copy(self):
            return Counted(self.c.copy())

        def flush(self):
            return self.c.flush()

    s = Surfeit()
    s.y_length = 1e9
    want = [s.surfeit_string(t) for t in texts]
    monkeypatch.setattr("brevispark.operators.surfeit.zlib.compressobj", lambda level: Counted(real(level)))
    assert s.surfeit_strings(texts) == want
    assert read[0] < 0.75 * sum(map(len, texts))
    with pytest.raises(ValueError):
        s.surfeit_strings(["a", ""])
