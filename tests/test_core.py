"""Hand-computed identities, properties and errors of the core operators."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevispark.functions.binning import bin_of, rice_bins
from brevispark.functions.text import fixed_number, sci_number
from brevispark.operators import automl
from brevispark.operators import combined as cs
from brevispark.operators import timeseries as ts
from brevispark.operators.anomalies import AnomalyDetector, two_means_1d
from brevispark.operators.automl import Classifier, Regressor
from brevispark.operators.codelength import code_length_from_counts, empirical_distribution, entropy_from_counts
from brevispark.operators.inaccuracy import Inaccuracy, inaccuracy_of_candidates, inaccuracy_score
from brevispark.operators.miscoding import Miscoding
from brevispark.operators.models import MLP, GaussianNB, LinearClassifier, LinearRegressor, TreeNode, artifacts, gram, pruning_path, solve_ols
from brevispark.operators.models import DecisionTree as Tree
from brevispark.operators.surfeit import Surfeit
from brevispark.streaming.code_length import code_length, joint_counts


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_known_code_lengths(spark):
    s = empirical_distribution(frame(spark, "x string", [(c,) for c in "aabc"]), ["x"], [False])
    assert (s.n_states, s.entropy, s.code_length, s.n_samples) == (3, 1.5, 6.0, 4)
    pair = frame(spark, "x int, y int", [(0, 0), (0, 1), (1, 0), (1, 1)])
    assert empirical_distribution(pair, ["x", "y"], [False, False]).entropy == 2.0
    mixed = frame(spark, "n double, c string", [(0.0, "a"), (0.1, "a"), (0.9, "b"), (1.0, "b")])
    s = empirical_distribution(mixed, ["n", "c"], [True, False], 2)
    assert s.code_length == 4.0 and [r["count"] for r in s.states.collect()] == [2, 2]
    assert entropy_from_counts([2, 2]) == 1.0 and code_length_from_counts([2, 0, 2]) == 4.0
    for bad in ([], [-1, 2], [0, 0], [1, math.nan], [[1]]):
        with pytest.raises(ValueError):
            code_length_from_counts(bad)


def test_bins_equal_edges_counted_one_by_one(spark):
    rng = np.random.default_rng(0)
    for lo, hi, b in ((0.0, 1.0, 10), (-3.3, 7.7, 37), (1e-9, 3e9, 79), (5.0, 5.0, 4), (0.0, 1.0, 1)):
        edges = [lo + i * ((hi - lo) / b) for i in range(1, b)]
        x = [lo, hi, *edges, *np.nextafter(edges, -np.inf), *rng.uniform(lo, hi, 200)]
        got = [
            r[0]
            for r in frame(spark, "x double", [(float(v),) for v in x]).select(bin_of(F.col("x"), lo, hi, b)).collect()
        ]
        assert got == [0 if lo == hi else sum(e <= v for e in edges) for v in x]
    assert rice_bins("auto", 8) == 4 and rice_bins("auto", 60_000) == 79 and rice_bins(5, 3) == 5
    with pytest.raises(ValueError):
        rice_bins(0, 5)


def test_rejected_values(spark):
    for schema, rows, numeric in (
        ("x double", [(math.nan,)], True),
        ("x double", [(math.inf,)], True),
        ("x string", [(None,)], False),
        ("x double", [], True),
    ):
        with pytest.raises(ValueError):
            empirical_distribution(frame(spark, schema, rows), ["x"], [numeric])
    with pytest.raises(TypeError):
        empirical_distribution(frame(spark, "x array<int>", [([1],)]), ["x"], [False])
    with pytest.raises(ValueError):
        empirical_distribution(frame(spark, "x int", [(1,)]), ["x"], [])


TOY = [(0, 0, 5, 0), (0, 1, 5, 0), (1, 0, 7, 1), (1, 1, 7, 1), (0, 1, 5, 0), (1, 0, 7, 1), (0, 1, 5, 0), (1, 0, 7, 1)]


def test_miscoding(spark):
    m = Miscoding("categorical").fit(frame(spark, "x0 int, x1 int, x2 int, y int", TOY), ["x0", "x1", "x2"], "y")
    assert (m.deficiency[0], m.surplus[0], m.miscoding[0]) == (0, 0, 0) and m.redundancy[0][2] == 1.0
    assert m.subset_analysis([0, 2, 1])["redundancy_weights"][0] < 0.51 and m.measures([])["miscoding"] == 1.0
    assert m.select_features() == [0] and m.feature_order()[0] == 0 and sorted(m.feature_order()) == [0, 1, 2]
    assert m.miscoding_subset(
        [1, 0, 0]
    ) == m.miscoding_subset(["x0"]) == 0.0 and m.indices([0, 1, 0]) == [1] and m.indices(
        [0, 1], as_mask=False
    ) == [0, 1]
    table = m.feature_analysis().collect()
    assert [r["miscoding"] for r in table] == sorted(r["miscoding"] for r in table)
    assert m.redundancy_matrix().count() == 3 and m.feature_redundancy().count() == 9
    for bad in ([0, 0, 1, 1], [5], [[1]]):
        with pytest.raises(ValueError):
            m.indices(bad)
    both = Miscoding("categorical").fit(
        frame(spark, "a int, b int, y int", [(r[1], r[1], r[3]) for r in TOY]), ["a", "b"], "y"
    )
    assert both.measures([0, 1])[
        "redundancy_weights"
    ] == [0.5, 0.5] and both.measures([0, 1])["miscoding"] == pytest.approx(
        both.measures([0])["miscoding"]
    )
    constant = Miscoding("categorical").fit(frame(spark, "a int, y int", [(1, 3), (2, 3)]), ["a"], "y")
    assert constant.deficiency == [0.0] and constant.measures([])["deficiency"] == 0.0


def test_properties_do_not_depend_on_order_or_labels(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), int(b), int(b + a > 1)) for a, b in zip(rng.normal(size=200), rng.integers(0, 3, 200))]
    df = frame(spark, "a double, b int, y int", rows)
    one = Miscoding().fit(df, ["a", "b"], "y")
    two = Miscoding().fit(df.repartition(7).orderBy(F.rand(3)), ["a", "b"], "y")
    names = Miscoding(X_type="auto").fit(df.withColumn("y", F.concat(F.lit("c"), "y")), ["a", "b"], "y")
    assert two.deficiency == pytest.approx(
        one.deficiency
    ) and names.deficiency == pytest.approx(one.deficiency) and one.redundancy[0][1] == pytest.approx(
        two.redundancy[0][1]
    )


def test_inaccuracy(spark):
    df = frame(spark, "y int, p int, q int", [(k % 4, k % 4, 4 if k == 7 else k % 4) for k in range(100)])
    got = {r["candidate"]: r["inaccuracy"] for r in inaccuracy_of_candidates(df, "y", ["p", "q"]).collect()}
    assert got["p"] == 0 and 0 < got["q"] < 0.2
    for y, p, want in ((1, 1, 0.0), (1, 0, 1.0)):
        assert inaccuracy_score(frame(spark, "y int, p int", [(y, p)] * 5), "y", "p") == want
    num = frame(spark, "y double, p double", [(x * 1.5, 3 - x * 20.0) for x in range(30)])
    assert inaccuracy_score(
        num.withColumn("p", F.col("y") * 9 + 2), "y", "p", y_type="numeric"
    ) == pytest.approx(0.0, abs=1e-12)
    with pytest.raises(ValueError):
        inaccuracy_score(frame(spark, "y int, p int", [(1, None)]), "y", "p")
    m = LinearRegressor(["y"], [2.0], 1.0)
    assert Inaccuracy("numeric").fit(num, "y").score(m) == pytest.approx(1.0)


def test_surfeit(spark):
    s = Surfeit().fit(frame(spark, "y int", [(v,) for v in (0, 0, 1, 1, 0, 1)]), "y")
    text = "def predict(x):\n return x\n" * 20
    length, compressed = s.description_lengths(text)
    assert (length, compressed) == (
        len(text), len(zlib.compress(text.encode(), 9))
    ) and s.surfeit_string(text) == pytest.approx(
        1 - min(s.y_length, max(0, compressed - 6)) / length
    )
    assert [s.effective_length(*x) for x in ((100, 20), (100, 3), (100, 200))] == [14, 0, 100]
    assert Surfeit().fit(frame(spark, "y int", [(1,)] * 4), "y").surfeit_string("abc") == 1.0
    for bad in ("", None):
        with pytest.raises(ValueError):
            s.surfeit_string(bad)


def test_combined(spark):
    v = dict(zip(cs.COMPONENTS, (0.2, 0.3, 0.4, 0.5)))
    df = frame(spark, "a double, b double, c double, d double", [tuple(v.values())])
    for w in (None, [1, 0, 0, 0], {"surfeit": 2.0}):
        for mode in cs.MODES:
            got = df.select(cs.aggregate([F.col(c) for c in "abcd"], mode, w)).first()[0]
            assert got == pytest.approx(cs.aggregate_values(v, mode, w))
    assert cs.aggregate_values(
        v, "arithmetic"
    ) == pytest.approx(0.35) and cs.aggregate_values(v, "maximum") == 0.5 and cs.aggregate_values(
        v, "euclidean", [1, 0, 0, 0]
    ) == pytest.approx(0.2)
    for bad in ([1, 1, 1], [0, 0, 0, 0], [-1, 1, 1, 1], {"x": 1}):
        with pytest.raises(ValueError):
            cs.resolve_weights(bad)
    s = cs.CombinedScore("categorical").fit(
        frame(spark, "x0 int, x1 int, y int", [(r[0], r[1], r[3]) for r in TOY]), ["x0", "x1"], "y"
    )
    e = s.explain([1, 0], "y", "def predict(X0):\n return X0\n", s.df)
    assert e["components"]["deficiency"] == e["components"]["surplus"] == e["components"]["inaccuracy"] == 0 and e[
        "dominant_component"
    ] in cs.COMPONENTS and e["combined"] == pytest.approx(
        e["components"]["surfeit"] / 2
    )


def test_numbers():
    assert [sci_number(x) for x in (0.0, 1234.5, math.nan, -math.inf)] == ["0", "1.23e+03", "nan", "-inf"]
    assert [fixed_number(x) for x in (1.0, 0.25, 1 / 3, -0.5)] == ["1.0", "0.25", "0.333333", "-0.5"]
    with pytest.raises(ValueError):
        fixed_number(math.inf)


def test_model_texts_and_columns(spark):
    m = LinearRegressor(["a", "b", "c"], [1.5, 0.0, -2.0], 0.5)
    assert " y = 5.00e-01\n y += 1.50e+00*X0\n y -= 2.00e+00*X2\n return y\n" in m.text() and artifacts(
        m, ["z", "a", "b", "c"]
    ).subset == [1, 3]
    two = LinearClassifier(["a"], ["n", "p"], [[2.0]], [-1.0])
    assert two.text() == "def predict(x):\n z=-1.00e+00+2.00e+00*x[0]\n if z>0:\n  return 1\n return 0\n"
    df = frame(spark, "a double, b double, c double", [(0.0, 1.0, 1.0), (1.0, 1.0, 0.0)])
    assert [
        r[0] for r in df.select(two.column()).collect()
    ] == ["n", "p"] and [r[0] for r in df.select(m.column()).collect()] == [-1.5, 2.0]
    nb = GaussianNB(["a"], [0, 1], [0.5, 0.5], [[0.0], [1.0]], [[1.0], [1.0]])
    assert [r["prediction"] for r in nb.transform(df).collect()] == [0, 1] and "s1=" in nb.text() and nb.subset() == [0]
    assert sum(df.select(*nb.probabilities()).first()) == pytest.approx(1.0)
    t = Tree(
        ["a"],
        TreeNode([1.0, 3.0], 4, 0.5, 0, 0.5, TreeNode([1.0, 0.0], 1, 0.0), TreeNode([0.0, 3.0], 3, 0.0)),
        ["u", "v"],
    )
    assert t.text() == "def predict(X0):\n if X0<=5.00e-01:\n  return C0\n else:\n  return C1\n" and [
        r[0] for r in df.select(t.column()).collect()
    ] == ["u", "v"]
    assert [len(x.leaves()) for x in pruning_path(t.root)] == [2, 1]
    net = MLP(
        ["a"], None, [np.array([[1.0, -1.0]]), np.array([[2.0], [3.0]])], [np.zeros(2), np.array([0.5])], [0.0], [1.0]
    )
    assert [r[0] for r in df.select(net.column()).collect()] == [0.5, 2.5] and "P StandardScaler" in net.text()
    with pytest.raises(TypeError):
        artifacts(object())


def test_ols_prefixes(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [1, 1e4, 1e-3] + [0, 1e6, 5]
    y = x @ [2, 3e-4, 100] + 7
    df = frame(spark, "a double, b double, c double, y double", np.column_stack([x, y]).tolist())
    g = gram(df, ["a", "b", "c"], "y")
    for p in (1, 2, 3):
        w, b = solve_ols(g, p)
        want = np.linalg.lstsq(np.column_stack([np.ones(300), x[:, :p]]), y, rcond=None)[0]
        assert np.abs(np.array(w) @ x[:, :p].T + b - np.column_stack([np.ones(300), x[:, :p]]) @ want).max() < 1e-4


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(160, 3))
    rows = [
        (*map(float, r), "p" if r[0] + r[1] > 0 else "n", float(3 * r[0] - 2 * r[1] + 0.1 * e))
        for r, e in zip(x, rng.normal(size=160))
    ]
    return frame(spark, "a double, b double, c double, k string, y double", rows).repartition(4).persist()


def test_classifier(labelled):
    auto = Classifier(options={"linear_svc": {"C_values": (1.0,)}}).fit(labelled, ["a", "b", "c"], "k")
    table = auto.results_dataframe().collect()
    assert {r["family"] for r in table} == {
        "decision_tree", "logistic_regression", "linear_svc", "naive_bayes", "mlp"
    } and len(table[0]) == 13
    assert [
        r["combined"] for r in table
    ] == sorted(r["combined"] for r in table) and auto.best_result.combined == table[0]["combined"]
    assert max(r["native_estimator_score"] for r in table) > 0.95 and 0.5 <= auto.score(labelled) <= 1
    assert auto.candidate_model_description()["model_string"] == auto.model_string() and set(auto.explain()) >= {
        "profile", "candidate_name"
    }
    with pytest.raises(KeyError):
        auto.candidate_model_description("none")
    with pytest.raises(ValueError):
        Classifier(["random_forest"])
    nb = Classifier(["naive_bayes"]).fit(labelled, ["a", "b"], "k")
    assert nb.predict_proba(labelled).first()[
        "probability"
    ].keys() == {"n", "p"} and nb.diagnostics_dataframe().count() == 0


@pytest.mark.parametrize("target,kind", [("k", "categorical"), ("y", "numeric")])
def test_pruned_trees_at_once_equal_each_by_itself(labelled, target, kind):
    score = cs.CombinedScore("numeric", kind).fit(labelled, ["a", "b", "c"], target)
    ctx = automl.SearchContext(labelled, ["a", "b", "c"], target, score, ["n", "p"] if target == "k" else None, 0)
    found = automl.search_tree(ctx).candidates
    got = [(c.components, c.native) for c in found]
    for (components, native), c in zip(got, automl.evaluate(ctx, found)):
        assert components == pytest.approx(c.components) and native == pytest.approx(c.native, abs=1e-9)
    assert len(found) > 2


@pytest.mark.parametrize("by_class", [True, False])
def test_trees_grow_past_five_levels_and_many_bins(spark, by_class):
    labels = np.random.default_rng(3).integers(0, 2, 300)
    df = frame(
        spark,
        "a double, b double, k string, y double",
        [(float(i), float(i % 3), "np"[k], float(i * i)) for i, k in enumerate(labels)],
    )
    target, classes = ("k", ["n", "p"]) if by_class else ("y", None)
    score = cs.CombinedScore("numeric", "categorical" if by_class else "numeric").fit(df, ["a", "b"], target)
    ctx = automl.SearchContext(df, ["a", "b"], target, score, classes, 0)
    found = automl.search_tree(ctx).candidates
    full = found[0]
    assert full.native == pytest.approx(1.0) and len(full.model.root.leaves()) > 64  # five levels have 32 leaves
    assert len(found[-1].model.root.leaves()) == 1 and all(
        int(c.hyperparameters["n_leaves"]) == len(c.model.root.leaves()) for c in found
    )
    for c in found:
        assert c.length == len(
            c.text.encode()
        ) and c.components["surfeit"] == score.surfeit.surfeit_string(c.text) and c.subset == c.model.subset()
    got = [(dict(c.components), c.native) for c in (full, found[len(found) // 2])]
    for (components, native), c in zip(got, automl.evaluate(ctx, [full, found[len(found) // 2]])):
        assert components == pytest.approx(c.components) and native == pytest.approx(c.native, abs=1e-9)


def test_surfeit_of_empty_missing_and_long_texts(spark, tmp_path):
    from brevispark.operators.surfeit import zlib_length
    from brevispark.plans.queries import surfeit_documents

    long = "".join(map(chr, np.random.default_rng(2).integers(97, 123, 300_000)))
    frame(spark, "doc_id int, text string", [(1, ""), (2, None), (3, "é" * 40), (4, long)]).write.parquet(
        str(tmp_path / "documents.parquet")
    )
    frame(spark, "quality int", [(0,), (1,)] * 50).write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r for r in surfeit_documents(spark, str(tmp_path)).collect()}
    assert len(got) == 4 and got[1]["surfeit"] is None and got[2]["surfeit"] is None and got[1]["compressed"] == 8
    assert got[4]["compressed"] == len(zlib.compress(long.encode(), 9)) and got[4]["surfeit"] == 1 - 100 / 300_000
    part = min(100, max(0, got[3]["compressed"] - 6))
    assert got[3]["length"] == 80 and got[3]["surfeit"] == 1 - part / 80
    plan = spark.range(1).select(zlib_length(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan  # 100 texts at once, not as many as an Arrow batch has


def _networks(df, features, target, classes, **options):
    score = cs.CombinedScore("numeric", "numeric" if classes is None else "categorical").fit(df, features, target)
    return automl.search_mlp(automl.SearchContext(df, features, target, score, classes, 0), **options).candidates


def test_copies_do_not_fill_the_sample_of_a_network(spark):
    rows = [(float(i % 2), float(i % 2), "np"[i % 2], 5.0 * (i % 2)) for i in range(400)]
    df = frame(spark, "a double, b double, k string, y double", rows)
    assert max(c.native for c in _networks(df, ["a", "b"], "k", ["n", "p"], sample_rows=100)) == 1.0
    assert max(c.native for c in _networks(df, ["a", "b"], "y", None, sample_rows=100)) > 0.95
    one = frame(
        spark,
        "a double, b double, k string",
        [(0.0, 0.0, "n")] * 200 + [(i / 100, 1.0, "np"[i > 100]) for i in range(1, 201)],
    )
    assert max(c.native for c in _networks(one, ["a", "b"], "k", ["n", "p"], sample_rows=60)) > 0.9


def test_regression_networks_use_all_rows_by_either_way(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    df = frame(
        spark, "a double, b double, y double", np.column_stack([x, x @ [3, -2]]).tolist()
    ).repartition(3).persist()
    here = _networks(df, ["a", "b"], "y", None, max_candidates=2)
    monkeypatch.setattr(automl, "LOCAL_GROUPS", 10)
    there = _networks(df, ["a", "b"], "y", None, max_candidates=2)
    assert [c.candidate for c in here] == [c.candidate for c in there]
    for p, q in zip(here, there):
        for a, b in zip([*p.model.weights, *p.model.biases], [*q.model.weights, *q.model.biases]):
            assert a == pytest.approx(b, abs=1e-6)


def test_classification_networks_use_all_rows_by_either_way(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(300, 2))
    rows = [(float(a), float(b), "npq"[int(a > 0) + int(a > b)]) for a, b in x]
    df = frame(spark, "a double, b double, k string", rows).repartition(3).persist()
    for classes in (["n", "p"], ["n", "p", "q"]):
        own = df.where(df.k.isin(classes))
        here = _networks(own, ["a", "b"], "k", classes, max_candidates=2)
        capped = _networks(own, ["a", "b"], "k", classes, max_candidates=2, sample_rows=20)
        with monkeypatch.context() as m:
            m.setattr(automl, "LOCAL_GROUPS", 10)
            there = _networks(own, ["a", "b"], "k", classes, max_candidates=1)
        for p, q in [*zip(here, capped), *zip(here, there)]:
            assert p.candidate == q.candidate
            for a, b in zip([*p.model.weights, *p.model.biases], [*q.model.weights, *q.model.biases]):
                assert a == pytest.approx(b, abs=1e-6)


def test_thresholds_of_trees_come_from_all_rows(spark):
    n = 12_000
    rare = [float(i * 500) for i in range(20)]  # Spark's own sample of 10,000 rows misses some of them
    rows = [(float(i), float(i in rare), "np"[i in rare]) for i in range(n)]
    df = frame(spark, "a double, b double, k string", rows).repartition(4)
    assert automl.quantile_steps(df, "b", 16) is None
    steps = automl.quantile_steps(df, "a", 16)
    assert steps == [(n / 16 * k - 1, n / 16 * k) for k in range(1, 16)]
    df = df.selectExpr("a", *[f"cast(a = {x} as double) r{k}" for k, x in enumerate(rare)], "k").persist()
    features = df.columns[:-1]
    score = cs.CombinedScore("numeric", "categorical").fit(df, features[:2], "k")
    ctx = automl.SearchContext(df, features, "k", score, ["n", "p"], 0)
    tree, _ = automl.grown_tree(ctx, *automl.fitted_tree(ctx, 30, 16))
    assert df.where(tree.column() != F.col("k")).count() == 0
    by_a = frame(spark, "a double, k string", [(float(i), "np"[i >= 6750]) for i in range(n)])
    ctx = automl.SearchContext(by_a, ["a"], "k", score, ["n", "p"], 0)
    tree, _ = automl.grown_tree(ctx, *automl.fitted_tree(ctx, 30, 16))
    assert tree.root.threshold == 6749.5 and len(tree.root.leaves()) == 2


@pytest.mark.parametrize("target,classes", [("y", None), ("k", ["n", "p", "q"])])
def test_searches_over_counted_rows_equal_those_over_all_rows(spark, target, classes):
    from brevispark.operators.inaccuracy import inaccuracy_of_candidates

    rng = np.random.default_rng(9)
    rows = [
        (float(a), float(b), "npq"[(a + b) % 3], float(a - 2 * b + e))
        for a, b, e in zip(rng.integers(0, 6, 200), rng.integers(0, 4, 200), rng.integers(-2, 3, 200) / 8)
    ]
    df = frame(spark, "a double, b double, k string, y double", rows * 12).repartition(3).persist()
    score = cs.CombinedScore("numeric", "categorical" if classes else "numeric").fit(df, ["a", "b"], target)
    ctx = automl.SearchContext(df, ["a", "b"], target, score, classes, 0)
    t = ctx.cells
    assert t.grouped and t.points.count() <= 24 * (3 if classes else 1) and t.frame.count() < 2400 / 4
    assert t.frame.agg(F.sum(t.count)).first()[0] == t.points.agg(F.sum(t.count)).first()[0] == 2400
    found = (
        automl.search_naive_bayes(ctx) if classes else automl.search_ols(ctx)
    ).candidates + automl.search_tree(ctx).candidates[:3]
    for c in found:
        wide = df.select(F.col(target).alias("y"), c.model.column().alias("p"))
        kind = "categorical" if classes else "numeric"
        bad = inaccuracy_of_candidates(wide, "y", ["p"], y_type=kind).first()["inaccuracy"]
        if classes:
            native = wide.agg(F.avg((F.col("y") == F.col("p")).cast("int"))).first()[0]
        else:
            e, v = wide.agg(F.avg((F.col("y") - F.col("p")) ** 2), F.var_pop("y")).first()
            native = 1 - e / v
        assert c.components["inaccuracy"] == pytest.approx(bad) and c.native == pytest.approx(native)
    if classes:
        return
    x, y = np.array([(a, b, 1.0) for a, b, *_ in rows] * 12), np.array([r[3] for r in rows] * 12)
    for c in automl.search_svr(ctx, epsilons=(0.0, 0.1, 0.2, 5.0)).candidates:  # tubes that hold no, few, most and all rows
        C, eps = float(c.hyperparameters["C"]), float(c.hyperparameters["epsilon"])
        u = np.array([*c.model.coefficients, c.model.intercept])
        r = y - x @ u
        slope = np.array([*u[:2], 0.0]) - 2 * C * x.T @ (np.sign(r) * np.maximum(0, np.abs(r) - eps))
        assert c.hyperparameters["converged"] == "false" or (np.abs(slope) < 1e-5 * C * np.abs(x).sum(0)).all()
        assert eps or c.hyperparameters["converged"] == "true"
    ctx.close()


def test_regressor(labelled):
    auto = Regressor().fit(
        labelled, ["a", "b", "c"], "y", candidates={"mine": LinearRegressor(["a", "b"], [3.0, -2.0], 0.0)}
    )
    table = {r["candidate"]: r for r in auto.results_dataframe().collect()}
    assert table["mine"]["native_estimator_score"] > 0.99 and {r["family"] for r in table.values()} == {
        "linear_regression", "decision_tree", "linear_svr", "mlp", "explicit"
    }
    assert max(
        r["native_estimator_score"] for r in table.values() if r["family"] == "linear_svr"
    ) > 0.99 and max(r["native_estimator_score"] for r in table.values() if r["family"] == "mlp") > 0.5
    for bad in ("x", [], [object()]):
        with pytest.raises((TypeError, ValueError)):
            Regressor(["linear_regression"]).fit(labelled, ["a"], "y", candidates=bad)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(2)
    y = [0.0, 0.1]
    for e in rng.normal(size=118) * 0.2:
        y.append(0.65 * y[-1] - 0.2 * y[-2] + float(e))
    return frame(spark, "t int, y double, z double", [(i, v, float(np.sin(i))) for i, v in enumerate(y)]), y


@pytest.mark.parametrize("chunk", [1 << 16, 16])
def test_lag_matrix(spark, series, monkeypatch, chunk):
    monkeypatch.setattr(ts, "CHUNK", chunk)
    df, y = series
    rows = ts.lag_matrix(df.repartition(5), "y", 3, ["t"], exogenous=["z"]).orderBy("t").collect()
    assert [(r["t"], r["y_lag_1"], r["y_lag_3"]) for r in rows] == [(t, y[t - 1], y[t - 3]) for t in range(3, len(y))]
    keyed = df.withColumn("key", F.col("t") % 2)
    assert ts.lag_matrix(keyed, "y", 2, ["t"], key="key").where("t = 5").first()["y_lag_2"] == y[1]


def test_time_series(series):
    df, y = series
    s = ts.TimeSeries(window_size=4, smoothing_alphas=(0.3,)).fit(df, "y", ["t"], ["z"])
    table = s.results_dataframe().collect()
    assert len(table) == 9 and [
        r["combined"] for r in table
    ] == sorted(r["combined"] for r in table) and len(s.forecast(3, [[0.0]] * 3)) == 3
    assert s.lag_analysis(2).count() == 4 and s.auto_lag_analysis(2, 3).count() == 2 and set(s.explain()) >= {
        "profile", "selected_lags"
    }
    ma = ts.TimeSeries(window_size=2, models=["moving_average"], moving_average_windows=[2]).fit(df, "y", ["t"])
    a = (y[-1] + y[-2]) / 2
    assert ma.forecast(2) == pytest.approx(
        [a, (a + y[-1]) / 2]
    ) and "NAME moving_average_w2" in ma.model_string() and math.isfinite(ma.score(df))
    assert sum(ts.exponential_smoothing_weights(5, 0.3)) == pytest.approx(1) and ts.window_size(80) == 8
    for bad in (
        lambda: ts.TimeSeries(models=["x"]),
        lambda: ts.exponential_smoothing_weights(3, 1.0),
        lambda: ts.window_size(3, 3),
        lambda: s.cross_lag_analysis("q"),
    ):
        with pytest.raises(ValueError):
            bad()
    assert ts.rolling_segments(df, ["t"], 80, 10).groupBy("segment").count().where("count = 80").count() == 5


def test_anomalies(spark):
    rows = [
        (i, float(i), float(i * 7 % 11), float(i), float(i) + (100 if i == 14 else -100 if i == 3 else 0.01 * (i % 3)))
        for i in range(40)
    ]
    df = frame(spark, "id int, x double, w double, y double, p double", rows)
    d = AnomalyDetector("regression", y_type="numeric").fit(df, ["x", "w"], "y", "id", prediction="p")
    assert {
        r[0] for r in d.anomalies("under_predicted").collect()
    } == {3} and {r[0] for r in d.anomalies("over_predicted").collect()} == {14}
    assert d.summary()["n_samples"] == 40 and d.group_anomalies(
        filter_redundant=False
    ).columns[0] == "attribute_1" and d.group_points("x").count() == 2 and "explanation" in d.explain()
    assert {r[0] for r in AnomalyDetector("regression", anomaly_rule="standardized_residual", z_score_threshold=50.0).fit(df, ["x"], "y", "id", prediction="p").anomalies().collect()} == {3, 14}
    same = AnomalyDetector("regression", y_type="numeric").fit(df, ["x"], "y", "id", prediction="y")
    assert same.anomalies().count() == 40  # every residual reaches a threshold of 0
    c = AnomalyDetector().fit(
        frame(spark, "id int, x int, y string, p string", [(1, 1, "a", "a"), (2, 2, "a", "b"), (3, 1, "b", "b")]),
        ["x"],
        "y",
        "id",
        prediction="p",
    )
    assert [
        r["sample_index"] for r in c.anomaly_table().collect()
    ] == [2] and c.summary()["n_misclassified"] == 1 and c.group_anomalies().count() == 0
    for bad in (
        lambda: AnomalyDetector("x"),
        lambda: AnomalyDetector("regression", anomaly_rule="misclassification"),
        lambda: AnomalyDetector(anomaly_quantile=1.5),
        lambda: c.anomalies("under_predicted"),
    ):
        with pytest.raises(ValueError):
            bad()
    assert d.group_anomalies(dimensions=2, filter_redundant=False, filter_balanced=False).count() == 1
    auto = AnomalyDetector(
        "regression", y_type="numeric", auto_model_kwargs={"models": ["linear_regression"]}
    ).fit(df, ["x", "w"], "y", "id")
    assert auto.summary()["model_combined"] >= 0


def test_two_means_is_optimal(spark):
    rng = np.random.default_rng(9)
    x = [*rng.normal(0, 1, 15).tolist(), *rng.normal(5, 1, 9).tolist(), 2.0, 2.0]
    got = two_means_1d(frame(spark, "g int, v double", [(1, v) for v in x]), "g", "v").first()
    z = np.sort((np.array(x) - np.mean(x)) / np.std(x))
    best = min(sum(((p - p.mean()) ** 2).sum() for p in (z[:k], z[k:])) for k in range(1, len(z)))
    assert got["inertia"] == pytest.approx(best) and got["cluster_0_size"] + got["cluster_1_size"] == len(x)


def test_stream_counts_equal_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    bounds = {"value": (0.0, 50.0, 4)}
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = joint_counts(
        stream, ["event_type", "value"], bounds
    ).writeStream.format("memory").queryName("counts").outputMode("complete").option(
        "checkpointLocation", str(tmp_path / "ck")
    ).start()
    q.processAllAvailable()
    q.stop()
    batch = joint_counts(src, ["event_type", "value"], bounds)
    assert code_length(spark.table("counts")).first()["code_length"] == pytest.approx(
        code_length(batch).first()["code_length"]
    )


def test_pareto_in_blocks_agrees_with_brute_force(spark):
    rows = [(i, *(float((i * k * k + k) % 7) for k in (3, 5, 11, 13))) for i in range(120)]
    df = frame(spark, "id int, " + ", ".join(f"{c} double" for c in cs.COMPONENTS), rows)
    beats = lambda a, b: all(x <= y for x, y in zip(a[1:], b[1:])) and a[1:] != b[1:]
    want = sorted(r[0] for r in rows if not any(beats(o, r) for o in rows))
    assert [sorted(r["id"] for r in cs.pareto(df, "id", small=n).collect()) for n in (20_000, 9)] == [want, want]


def test_functional_forms_agree_with_objects(spark):
    rows = frame(spark, "x0 int, x1 int, y int, p int", [(r[0], r[1], r[3], r[3]) for r in TOY])
    args = (rows, ["x0", "x1"], "y", [0], "p", "return 1")
    fitted = cs.CombinedScore("categorical").fit(*args[:3])
    assert cs.components(*args, X_type="categorical") == fitted.components(*args[3:])
    assert cs.combined_score(*args, X_type="categorical") == fitted.combined(*args[3:])
