"""DuckDB equivalents of the queries in more.py."""

from __future__ import annotations

from brevispark.plans.oracle import (
    EVENTS,
    LINE,
    LINE_CAT,
    LINE_NUM,
    LINE_Y,
    PREDICTED,
    _dominant,
    _profile,
    _redundancy,
    _two_means,
    analysis,
    encoded,
    inaccuracy_expr,
    length,
)

#: A fixed text whose compressed form is longer than the code of any target it is used with.
DESCRIPTION = " Quick zephyrs blow, vexing daft Jim; 7 jumbled boxes (4, 19 and 836) pack my wizard's quartz: 0.27 x 51 = 13.77! Why do sphinxes judge 92 black vows? Yes."

REFUSED = (
    *(
        "infinite_feature",
        "letters_as_numbers",
        "nested_feature",
        "unknown_feature",
        "no_feature_column",
        "flags_of_other_length",
        "empty_table",
        "repeated_feature",
        "unknown_type",
    ),
    *(
        "subset_index_out_of_range",
        "subset_index_repeats",
        "negative_min_improvement",
        "max_features_of_zero",
        "unknown_mode",
        "mask_out_of_range",
        "negative_counts",
        "counts_of_zero",
    ),
    *(
        "bins_of_zero",
        "predictions_with_gaps",
        "weights_of_zero",
        "weights_of_unknown_component",
        "unknown_aggregation",
        "negative_threshold_fraction",
        "negative_surplus_penalty",
    ),
    *(
        "zlib_level_of_ten",
        "empty_description",
        "family_as_string",
        "unknown_family",
        "one_class",
        "series_with_infinity",
        "series_of_two_rows",
        "window_as_long_as_the_series",
        "alpha_of_one",
    ),
    *(
        "unknown_anomaly_rule",
        "rule_of_other_task",
        "quantile_of_one",
        "kind_of_other_task",
        "unknown_attribute",
        "attribute_out_of_range",
    ),
)
TAKEN = ("plain_table", "subset_of_names", "subset_as_mask", "counts", "weights_of_one_component", "series")


def refusals() -> str:
    fixed = ", ".join([f"('{x}', true)" for x in REFUSED] + [f"('{x}', false)" for x in TAKEN])
    own = " UNION ALL ".join(
        f"SELECT 'documents_{c}_as_feature', count({c}) < count(*) FROM documents" for c in ("lang", "n_chars")
    )
    return f"SELECT input, refused FROM (SELECT * FROM (VALUES {fixed}) v(input, refused) UNION ALL {own})"


def sci(x: str) -> str:
    return f"CASE WHEN ({x}) = 0 THEN '0' ELSE printf('%.2e', ({x})::DOUBLE) END"


def fixed(x: str, digits: int = 6) -> str:
    text = f"rtrim(rtrim(printf('%.{digits}f', ({x})::DOUBLE), '0'), '.')"
    return f"CASE WHEN contains({text}, '.') THEN {text} ELSE {text} || '.0' END"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def signed(x: str) -> str:
    """A term behind others, with its sign."""
    return f"CASE WHEN ({x}) < 0 THEN '' ELSE '+' END || {sci(x)}"


def texts() -> str:
    """Texts of given parameters are written out; those of learned ones are put together from aggregates."""
    best = [" best=0", " best_s=s0"]
    net = [
        "P StandardScaler",
        " X0 = (X0-1.00e+00)/4.00e+00",
        " X1 = (X1-2.00e+00)/1.00e+00",
        "def predict(x):",
        " W=[[[1.00e+00,2.00e+00],[5.00e-01,0]],[[1.00e+00],[-1.00e+00]]]",
        " B=[[0,1.00e+00],[2.00e+00]]",
        " a=[x[0],x[1]]",
        " for l in range(len(W)):",
        "  z=[]",
        "  for j in range(len(B[l])):",
        "   s=B[l][j]",
        "   for i in range(len(a)):",
        "    s+=a[i]*W[l][i][j]",
        "   z.append(s)",
        "  if l<len(W)-1:",
        "   a=[max(0,v) for v in z]",
        "  else:",
        "   a=z",
        " return a[0]",
    ]
    tree = [
        "def predict(X0, X1):",
        " if X0<=2.55e+01:",
        "  return 1.00e+00",
        " else:",
        "  if X1<=4.00e-02:",
        "   return 2.50e+00",
        "  else:",
        "   return -3.00e+01",
    ]
    three = [
        "def predict(x):",
        " s0=1.00e+00*x[0]",
        *best,
        " s1=1.00e+00+2.00e+00*x[1]",
        " if s1>best_s:",
        "  best=1",
        "  best_s=s1",
        " s2=-1.00e+00",
        " if s2>best_s:",
        "  best=2",
        "  best_s=s2",
        " return best",
    ]
    two = lambda z: ["def predict(x):", f" z={z}", " if z>0:", "  return 1", " return 0"]
    given = {
        "linear": (["def predict(X0):", " y = 1.20e+01", " y -= 5.00e-01*X0", " return y"], "0", "LinearRegressor"),
        "svr": (["def predict(x):", " y=2.50e-01+1.50e+00*x[0]-2.00e+00*x[1]", " return y"], "0,1", "LinearSVR"),
        "logistic_two": (two("3.00e+00+1.00e+00*x[0]-1.25e-01*x[1]"), "0,1", "LinearClassifier"),
        "logistic_three": (three, "0,1", "LinearClassifier"),
        "svc": (two("4.00e+00*x[1]"), "1", "LinearSVC"),
        "tree": (tree, "0,1", "DecisionTree"),
        "mlp": (net, "0,1", "MLP"),
    }
    rows = [
        f"SELECT '{name}' AS model, {quoted(chr(10).join(lines) + chr(10))} AS text, '{subset}' AS subset, '{kind}' AS model_type"
        for name, (lines, subset, kind) in given.items()
    ]
    n = "chr(10)"
    ols = f"'def predict(X0):' || {n} || ' y = ' || {sci('b')} || {n} || ' y ' || CASE WHEN w > 0 THEN '+' ELSE '-' END || '= ' || {sci('abs(w)')} || '*X0' || {n} || ' return y' || {n}"
    rows.append(
        f"SELECT 'ols', {ols}, '0', 'LinearRegressor' FROM (SELECT regr_slope(l_extendedprice, l_quantity) AS w, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)"
    )
    term = f"{sci('lp')} || {signed('c')} || '-((x[0]-' || {sci('m')} || ')**2)/' || {sci('2 * v')}"
    line = f"CASE WHEN k = 0 THEN ' s0=' || e || {n} || ' best=0' || {n} || ' best_s=s0' ELSE ' s' || k || '=' || e || {n} || ' if s' || k || '>best_s:' || {n} || '  best=' || k || {n} || '  best_s=s' || k END"
    stats = f"SELECT row_number() OVER (ORDER BY {LINE_Y}) - 1 AS k, ln(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE) AS lp, avg(l_quantity) AS m, var_pop(l_quantity) AS v, -0.5 * ln(2 * pi() * var_pop(l_quantity)) AS c FROM lineitem GROUP BY {LINE_Y}"
    rows.append(
        f"SELECT 'naive_bayes', 'def predict(x):' || {n} || string_agg({line}, {n} ORDER BY k) || {n} || ' return best' || {n}, '0', 'GaussianNB' FROM (SELECT k, {term} AS e FROM ({stats}))"
    )
    return "\n UNION ALL ".join(rows)


def greedy(tail: str) -> str:
    """CTEs c0, c1, ... of greedy selection over all features, then tail. c<t> holds the features chosen in t steps."""
    inner = analysis(
        "lineitem", LINE_NUM, LINE_CAT, LINE, LINE_Y, False
    ).removeprefix("WITH ").rsplit("SELECT feature_index::INTEGER", 1)[0]
    out = [
        inner,
        _redundancy(),
        "c0 AS (SELECT 0 AS step, []::INTEGER[] AS chosen, 1.0::DOUBLE AS now, -1 AS j, 0.0::DOUBLE AS d, 0.0::DOUBLE AS s, 0.0::DOUBLE AS gain)",
    ]
    for t in range(1, len(LINE) + 1):
        out.append(
            f"q{t} AS (SELECT m.feature_index::INTEGER AS j, unnest(list_append(chosen, m.feature_index::INTEGER)) AS i FROM c{t - 1}, m WHERE NOT list_contains(chosen, m.feature_index::INTEGER))"
        )
        out.append(f"""a{t} AS (SELECT x.j, x.i, 1 / (1 + coalesce(sum(rr.v), 0)) AS alpha FROM q{t} x LEFT JOIN q{t} z ON x.j = z.j AND x.i <> z.i
  LEFT JOIN m mi ON mi.feature_index = x.i LEFT JOIN m mk ON mk.feature_index = z.i LEFT JOIN rr ON rr.fi = mi.feature_name AND rr.fj = mk.feature_name GROUP BY x.j, x.i)""")
        out.append(
            f"g{t} AS (SELECT a.j, product(pow(m.d, alpha)) AS d, sum(alpha * m.k * m.s) / sum(alpha * m.k) AS s FROM a{t} a JOIN m ON m.feature_index = a.i GROUP BY a.j)"
        )
        out.append(
            f"c{t} AS (SELECT {t} AS step, list_append(p.chosen, g.j) AS chosen, greatest(g.d, g.s) AS now, g.j, g.d, g.s, p.now - greatest(g.d, g.s) AS gain FROM g{t} g, c{t - 1} p ORDER BY greatest(g.d, g.s), g.d, g.s, g.j LIMIT 1)"
        )
    out.append("path AS (" + " UNION ALL ".join(f"SELECT * FROM c{t}" for t in range(1, len(LINE) + 1)) + ")")
    names = "[" + ", ".join(f"'{f}'" for f in LINE) + "]"
    return f"WITH {', '.join(out)} " + tail.replace("NAMES", names)


_path = greedy("""SELECT step::INTEGER AS step, j::INTEGER AS feature_index, NAMES[j + 1] AS feature_name, round(d, 6) AS deficiency, round(s, 6) AS surplus, round(now, 6) AS miscoding,
 round(gain, 6) AS improvement, array_to_string(chosen, ',') AS selected_feature_indices, array_to_string(list_transform(chosen, lambda i: NAMES[i + 1]), ',') AS selected_feature_names FROM path""")
_order = greedy("""SELECT (row_number() OVER (ORDER BY step, greatest(d, s), d, s, j) - 1)::INTEGER AS place, j::INTEGER AS feature_index, NAMES[j + 1] AS feature_name, (step < 99)::INTEGER AS selected
FROM (SELECT m.feature_index AS j, m.d, m.s, CASE WHEN step < (SELECT coalesce(min(step) FILTER (gain <= 0), 99) FROM path) THEN step ELSE 99 END AS step
      FROM m JOIN path ON path.j = m.feature_index)""")


def components() -> str:
    source = "(SELECT n_nationkey, length(n_name) AS length, n_regionkey AS y, n_nationkey % 5 AS p FROM nation)"
    one = []
    for k, f in enumerate(("n_nationkey", "length")):
        one.append(f"""SELECT {k} AS feature, {f'greatest(0.0, least(1.0, (kfy - kf) / ky))'} AS deficiency, greatest(0.0, least(1.0, (kfy - ky) / kf)) AS surplus, {inaccuracy_expr()} AS inaccuracy,
 1 - ky / {len(DESCRIPTION.encode())} AS surfeit FROM (SELECT {length([f])} AS kf, {length(['y'])} AS ky, {length(['p'])} AS kp, {length(['y', 'p'])} AS kyp, {length([f, 'y'])} AS kfy, true AS eq)""")
    score = "sqrt((deficiency ** 2 + surplus ** 2 + inaccuracy ** 2 + surfeit ** 2) / 4)"
    cols = ", ".join(f"round({c}, 6) AS {c}" for c in ("deficiency", "surplus", "inaccuracy", "surfeit"))
    return f"""WITH {encoded(source, ['n_nationkey', 'length'], ['y', 'p'])}, c AS ({' UNION ALL '.join(one)})
SELECT feature, {cols}, round({score}, 6) AS combined, round(1 - {score}, 6) AS score, {_dominant} AS dominant, {_profile} AS profile FROM c"""


def searched(candidate: str, family: str, kind: str, source: str, native: str, numeric: bool, selected: int = 1) -> str:
    """A result row: source has y and p; the measures are those of l_quantity, or of no feature."""
    cols = (["y", "p"], []) if numeric else ([], ["y", "p"])
    y = "l_extendedprice" if numeric else LINE_Y
    measures = analysis(
        "lineitem", ["l_quantity"], [], ["l_quantity"], y, numeric
    ) if selected else "SELECT 1.0::DOUBLE AS deficiency, 0.0::DOUBLE AS surplus"
    return f"""SELECT '{candidate}' AS candidate, '{family}' AS family, '{kind}' AS model_type, native AS native_estimator_score, inaccuracy, deficiency, surplus, {selected} AS n_selected_features
FROM (WITH {encoded(source, *cols)}, l AS (SELECT {length(['y'])} AS ky, {length(['p'])} AS kp, {length(['y', 'p'])} AS kyp, (SELECT min(y) = min(p) FROM t) AS eq)
      SELECT round({inaccuracy_expr()}, 6) AS inaccuracy, (SELECT round({native}, 6) FROM t) AS native FROM l), ({measures})"""


_r2 = "1 - avg((y - p) * (y - p)) / var_pop(y)"
_stats = f"SELECT {LINE_Y} AS c, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) + 1e-9 * (SELECT var_pop(l_quantity) FROM lineitem) AS v FROM lineitem GROUP BY 1"
_bayes = f"""(SELECT any_value(y) AS y, arg_max(c, sc) AS p FROM (SELECT rid, y, c, ln(n / (SELECT count(*) FROM lineitem)::DOUBLE) - 0.5 * ln(2 * pi() * v) - (q - m) ** 2 / (2 * v) AS sc
  FROM (SELECT row_number() OVER () AS rid, l_quantity AS q, {LINE_Y} AS y FROM lineitem), ({_stats})) GROUP BY rid)"""
_line_fit = "(SELECT l_extendedprice AS y, b + w * l_quantity AS p FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS w, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem))"
_stump = """(WITH g AS (SELECT l_quantity AS x, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1),
 u AS (SELECT x, sum(n) OVER w AS n0, sum(s) OVER w AS s0, sum(n) OVER () AS n, sum(s) OVER () AS s FROM g WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
 k AS (SELECT x, s0 / n0 AS low, (s - s0) / (n - n0) AS high FROM u WHERE n > n0 ORDER BY s0 * s0 / n0 + (s - s0) * (s - s0) / (n - n0) DESC LIMIT 1)
 SELECT l_extendedprice AS y, CASE WHEN l_quantity <= x THEN low ELSE high END AS p FROM lineitem, k)"""
_mean = "(SELECT l_extendedprice AS y, (SELECT avg(l_extendedprice) FROM lineitem) AS p FROM lineitem)"

_lags = f"(SELECT x, y FROM (SELECT lag(y) OVER (ORDER BY t) AS x, y FROM {EVENTS}) WHERE x IS NOT NULL)"
_ar_text = "'SCHEMA canonical_weighting_time_series_model_v1' || chr(10) || 'MODEL autoregressive_linear' || chr(10) || 'TASK forecasting' || chr(10) || 'NAME autoregressive' || chr(10) || 'INPUTS y_lag_1' || chr(10) || 'PARAMETERS' || chr(10) || '    n_features = 1' || chr(10) || '    learned_coefficients = true' || chr(10) || 'RULE' || chr(10)"
_ar = f"""WITH f AS (SELECT regr_slope(y, x) AS w, regr_intercept(y, x) AS b FROM {_lags}),
{encoded(f'(SELECT x, y, w * x + b AS p FROM {_lags}, f)', ['x', 'y', 'p'], [])},
l AS (SELECT {length(['x'])} AS kx, {length(['y'])} AS ky, {length(['p'])} AS kp, {length(['x', 'y'])} AS kxy, {length(['y', 'p'])} AS kyp, false AS eq)
SELECT 'autoregressive' AS model, round(w, 6) AS weight, round(b, 6) AS intercept, (SELECT round({_r2}, 6) FROM t) AS estimator_score, (SELECT round({_r2}, 6) FROM t) AS score,
 round(greatest(0.0, least(1.0, (kxy - kx) / ky)), 6) AS deficiency, round(greatest(0.0, least(1.0, (kxy - ky) / kx)), 6) AS surplus, round({inaccuracy_expr()}, 6) AS inaccuracy,
 {_ar_text} || '    y_hat = ' || {fixed('b')} || chr(10) || '    y_hat += ' || {fixed('w')} || ' * y_lag_1' || chr(10) || '    return y_hat' || chr(10) AS text, 'y_lag_1' AS lag_name, 1::INTEGER AS lag
FROM f, l"""
_refits = f"""WITH v AS (SELECT * FROM {EVENTS}), s AS (SELECT i AS segment FROM range(100) r(i) WHERE i * 500 + 1000 <= (SELECT count(*) FROM v)),
p AS (SELECT segment, y, lag(y) OVER (PARTITION BY segment ORDER BY t) AS x FROM v, s WHERE t >= segment * 500 AND t < segment * 500 + 1000)
SELECT segment::BIGINT AS segment, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 5) AS intercept, round(regr_r2(y, x), 5) AS r2, count(*)::BIGINT AS n FROM p WHERE x IS NOT NULL GROUP BY segment"""
_anomalies = f"(SELECT *, abs(y - p) AS s FROM {PREDICTED} WHERE abs(y - p) >= (SELECT quantile_cont(abs(y - p), 0.95) FROM {PREDICTED}))"
_schema = {
    "attribute_1": "INTEGER",
    "attribute_1_name": "VARCHAR",
    "dimensions": "INTEGER",
    "inertia": "DOUBLE",
    "cluster_0_size": "BIGINT",
    "cluster_1_size": "BIGINT",
    "balance": "DOUBLE",
    "n_anomalies": "BIGINT",
}


def groups() -> str:
    """Views in order of inertia that are balanced and not redundant with a view kept before them."""
    names = ["l_quantity", "l_discount", "l_tax"]
    red = " UNION ALL ".join(
        f"SELECT {i} AS a, {j} AS b, greatest(0.0, least(1.0, 1 - (kab - least(ka, kb)) / greatest(ka, kb))) AS v FROM (SELECT {length([names[i]])} AS ka, {length([names[j]])} AS kb, {length([names[i], names[j]])} AS kab)"
        for i in range(3) for j in range(3) if i != j
    )
    views = _two_means.replace("round(inertia, 4) AS inertia", "inertia")
    near = lambda x, y: f"(SELECT v >= 0.85 FROM red WHERE a = {x} AND b = {y})"
    return f"""WITH x AS (SELECT *, cluster_0_size + cluster_1_size AS n FROM ({views})),
w AS (SELECT *, row_number() OVER (ORDER BY inertia, abs(cluster_0_size - cluster_1_size), attribute) AS r FROM x WHERE least(cluster_0_size, cluster_1_size) / n >= 0.1),
red AS (WITH {encoded('lineitem', names, [])} {red}),
k1 AS (SELECT attribute FROM w WHERE r = 1), k2 AS (SELECT attribute FROM w WHERE r = 2 AND NOT {near('attribute', '(SELECT attribute FROM k1)')}),
k3 AS (SELECT attribute FROM w WHERE r = 3 AND NOT {near('attribute', '(SELECT attribute FROM k1)')} AND NOT coalesce({near('attribute', '(SELECT attribute FROM k2)')}, false))
SELECT attribute AS attribute_1, ['l_quantity', 'l_discount', 'l_tax'][attribute + 1] AS attribute_1_name, 1::INTEGER AS dimensions, round(inertia, 4) AS inertia, cluster_0_size, cluster_1_size,
 round(abs(cluster_0_size - cluster_1_size) / n, 4) AS balance, n::BIGINT AS n_anomalies FROM w JOIN (FROM k1 UNION ALL FROM k2 UNION ALL FROM k3) USING (attribute)"""


_edges = "list_transform(range(1, 8), lambda i: lo + i * ((hi - lo) / 8))"

SQL: dict[str, str] = {
    "greedy_selection_path": _path,
    "anomaly_groups": groups(),
    "refused_inputs": refusals(),
    "feature_analysis_numeric_text": analysis(f"(SELECT l_extendedprice / -1000.0::DOUBLE AS t_price, l_discount * 0.0001::DOUBLE AS t_part, {LINE_Y} FROM lineitem)", ["t_price", "t_part"], [], ["t_price", "t_part"], LINE_Y, False),
    "number_formats": f"""SELECT {LINE_Y}, l_linestatus, {sci('a')} AS sci_price, {sci('-b')} AS sci_discount, {fixed('b', 4)} AS fixed_discount, {fixed('n')} AS fixed_n, '0' AS sci_zero, 'X' || n || ' C0' AS tokens
FROM (SELECT {LINE_Y}, l_linestatus, avg(l_extendedprice) AS a, avg(l_discount) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2)""",
    "model_texts": texts(),
    "components_nation": components(),
    "description_lengths_nation": f"SELECT n_name, (octet_length(encode(n_name)) + {len(DESCRIPTION.encode())})::BIGINT AS length, round(1 - k / (octet_length(encode(n_name)) + {len(DESCRIPTION.encode())}), 6) AS surfeit FROM nation, (SELECT sum(-c * log2(c / n::DOUBLE)) AS k FROM (SELECT count(*) AS c, sum(count(*)) OVER () AS n FROM region GROUP BY r_regionkey))",
    "inaccuracy_of_model": f"WITH {encoded(f'(SELECT y, 50.0 + 1000.0 * l_quantity AS p FROM {PREDICTED})', ['y', 'p'], [])}, l AS (SELECT {length(['y'])} AS ky, {length(['p'])} AS kp, {length(['y', 'p'])} AS kyp, false AS eq) SELECT round({inaccuracy_expr()}, 6) AS inaccuracy, round(1 - ({inaccuracy_expr()}), 6) AS score, round(ky, 6) AS y_length FROM l",
    "feature_order_lineitem": _order,
    "series_windows_and_lags": "SELECT floor(sqrt((SELECT count(*) FROM events)))::INTEGER AS auto_window, 3::INTEGER AS window, source, attribute, lag::INTEGER AS lag FROM (VALUES ('target', 'y'), ('exogenous', 'k')) v(source, attribute), range(1, 4) r(lag)",
    "naive_bayes_search": searched("naive_bayes_1", "naive_bayes", "GaussianNB", _bayes, "avg((y = p)::INTEGER)", False),
    "linear_regression_search": searched("linear_regression_1", "linear_regression", "LinearRegressor", _line_fit, _r2, True),
    "decision_stump_search": searched("decision_tree_0_leaves_2", "decision_tree", "DecisionTree", _stump, _r2, True) + "\n UNION ALL " + searched("decision_tree_1_leaves_1", "decision_tree", "DecisionTree", _mean, "max(0.0::DOUBLE)", True, 0),
    "search_diagnostics": "SELECT * FROM (VALUES ('linear_svr', 'fit_failed', 'linear_svr_C0_e0.1'), ('linear_svr', 'evaluated', 'linear_svr_C1_e0.1'), ('linear_regression', 'evaluated', 'linear_regression_1')) v(family, reason, candidate)",
    "anomaly_by_model": "SELECT l_orderkey * 10 + l_linenumber AS sample_index, l_linestatus AS y_true, CASE WHEN l_quantity > 25 THEN 'O' ELSE 'F' END AS y_pred, 1.0::DOUBLE AS anomaly_score, 'misclassified' AS anomaly_kind FROM lineitem WHERE l_linestatus <> CASE WHEN l_quantity > 25 THEN 'O' ELSE 'F' END",
    "anomaly_group_points": f"SELECT row_id AS sample_index, (l_quantity > (SELECT cut FROM ({_two_means}) WHERE attribute = 0))::INTEGER AS cluster, round(s, 6) AS anomaly_score, l_quantity FROM {_anomalies}",
    "anomaly_no_groups": f"SELECT {', '.join(f'NULL::{t} AS {c}' for c, t in _schema.items())} WHERE false",
    "ts_autoregressive_lag_1": _ar,
    "rolling_autoregression": _refits,
    "empirical_states_orders": f"SELECT len(list_filter({_edges}, lambda e: e <= o_totalprice))::INTEGER AS o_totalprice, o_orderstatus, count(*)::BIGINT AS count, round(count(*) / any_value(n)::DOUBLE, 6) AS probability FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders) GROUP BY 1, 2",
}
