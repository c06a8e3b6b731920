"""DuckDB equivalents of the queries in queries.py, composed from a few templates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

EVENTS = "(SELECT ts, event_id, value AS y, CAST(regexp_extract(props, '\"k\": *(-?[0-9.]+)', 1) AS DOUBLE) AS k, row_number() OVER (ORDER BY ts, event_id) - 1 AS t FROM events)"
PREDICTED = "(SELECT l_orderkey * 10 + l_linenumber AS row_id, l_quantity, l_discount, l_tax, l_extendedprice AS y, 1000.0 * l_quantity + 50.0 * l_discount AS p FROM lineitem)"
COMPONENTS = "(SELECT i AS id, (i % 5) / 4.0 AS deficiency, (i // 5 % 5) / 4.0 AS surplus, (i // 25 % 5) / 4.0 AS inaccuracy, (i // 125) / 4.0 AS surfeit FROM range(625) r(i))"


def encoded(source: str, numeric: Sequence[str], categorical: Sequence[str], keep: Sequence[str] = ()) -> str:
    """CTEs b (row count n, bins, edges) and e (states)."""
    edges = ", ".join(f"min({c})::DOUBLE AS lo_{c}, max({c})::DOUBLE AS hi_{c}" for c in numeric)
    inner = ", ".join(
        f"list_transform(range(1, nb), lambda i: lo_{c} + i * ((hi_{c} - lo_{c}) / nb)) AS ed_{c}" for c in numeric
    )
    states = [
        f"CASE WHEN lo_{c} = hi_{c} THEN 0 ELSE len(list_filter(ed_{c}, lambda v: v <= t.{c})) END AS {c}"
        for c in numeric
    ] + [f"t.{c} AS {c}" for c in categorical] + [f"t.{c} AS raw_{c}" for c in keep]
    return f"""t AS (SELECT * FROM {source}),
b0 AS (SELECT count(*) AS n, CAST(least(ceil(2 * pow(count(*), 1.0 / 3)), count(*)) AS INTEGER) AS nb{', ' + edges if numeric else ''} FROM t),
b AS (SELECT *{', ' + inner if numeric else ''} FROM b0),
e AS (SELECT {', '.join(states)} FROM t, b)"""


def length(cols: Sequence[str], where: str = "") -> str:
    return f"(SELECT sum(-c * log2(c / b.n::DOUBLE)) FROM (SELECT count(*) AS c FROM e {where} GROUP BY {', '.join(cols)}), b)"


def clip(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def analysis(
    source: str, numeric: Sequence[str], categorical: Sequence[str], features: Sequence[str], y: str, y_numeric: bool
) -> str:
    num = [*numeric, *([y] if y_numeric else [])]
    cat = [*categorical, *([] if y_numeric else [y])]
    rows = "\n UNION ALL ".join(
        f"SELECT {i} AS feature_index, '{f}' AS feature_name, {str(f in numeric).lower()} AS is_numeric, {length([f])} AS k, {length([f, y])} AS ky"
        for i, f in enumerate(features)
    )
    return f"""WITH {encoded(source, num, cat)}, y AS (SELECT {length([y])} AS y), f AS ({rows}),
m AS (SELECT feature_index, feature_name, is_numeric, k, {clip('(ky - k) / y.y')} AS d, CASE WHEN k > 0 THEN {clip('(ky - y.y) / k')} ELSE 0.0 END AS s FROM f, y)
SELECT feature_index::INTEGER AS feature_index, feature_name, is_numeric, round(k, 6) AS code_length, round(d, 6) AS deficiency, round(s, 6) AS surplus, round(greatest(d, s), 6) AS miscoding FROM m"""


LINE_NUM, LINE_CAT, LINE_Y = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_linestatus"], "l_returnflag"
LINE = [*LINE_NUM, *LINE_CAT]
_line = encoded("lineitem", LINE_NUM, [*LINE_CAT, LINE_Y])


def _redundancy() -> str:
    pairs = "\n UNION ALL ".join(
        f"SELECT '{a}' AS fi, '{b}' AS fj, {length([a])} AS ka, {length([b])} AS kb, {length([a, b])} AS kab"
        for a, b in combinations(LINE, 2)
    )
    both = f"p AS ({pairs}), r AS (SELECT fi, fj, CASE WHEN greatest(ka, kb) > 0 THEN {clip('1 - (kab - least(ka, kb)) / greatest(ka, kb)')} ELSE 1.0 END AS v FROM p)"
    diagonal = " UNION ALL ".join(f"SELECT '{f}' AS fi, '{f}' AS fj, 1.0::DOUBLE AS v" for f in LINE)
    return f"{both}, rr AS (SELECT fi, fj, v FROM r UNION ALL SELECT fj, fi, v FROM r UNION ALL {diagonal})"


def _subsets(subsets: Sequence[Sequence[int]]) -> str:
    values = ", ".join(f"('{','.join(map(str, s))}', {j}, '{LINE[j]}')" for s in subsets for j in s)
    inner = analysis(
        "lineitem", LINE_NUM, LINE_CAT, LINE, LINE_Y, False
    ).removeprefix("WITH ").rsplit("SELECT feature_index::INTEGER", 1)[0]
    return f"""WITH {inner}, {_redundancy()}, s(subset, j, f) AS (VALUES {values}),
a AS (SELECT x.subset, x.j, x.f, 1 / (1 + coalesce(sum(rr.v), 0)) AS alpha FROM s x LEFT JOIN s z ON x.subset = z.subset AND x.j <> z.j LEFT JOIN rr ON rr.fi = x.f AND rr.fj = z.f GROUP BY ALL),
g AS (SELECT a.subset, product(pow(m.d, alpha)) AS d, sum(alpha * m.k * m.s) / sum(alpha * m.k) AS o FROM a JOIN m ON m.feature_name = a.f GROUP BY a.subset)
SELECT subset, round(d, 6) AS deficiency, round(o, 6) AS surplus, round(greatest(d, o), 6) AS miscoding FROM g"""


def inaccuracy_expr(y: str = "y", p: str = "p") -> str:
    return f"CASE WHEN greatest(ky, kp) > 0 THEN {clip('(kyp - least(ky, kp)) / greatest(ky, kp)')} ELSE CASE WHEN eq THEN 0.0 ELSE 1.0 END END"


def inaccuracy(source: str, name: str) -> str:
    return f"""WITH {encoded(source, ['y', 'p'], [])}, l AS (SELECT {length(['y'])} AS ky, {length(['p'])} AS kp, {length(['y', 'p'])} AS kyp, (SELECT min(y) = min(p) FROM t) AS eq)
SELECT '{name}' AS candidate, round({inaccuracy_expr()}, 6) AS inaccuracy FROM l"""


CANDIDATES = {
    "quantity": "l_quantity",
    "linear": "1000.0 * l_quantity",
    "square": "l_quantity * l_quantity",
    "discounted": "l_quantity * (1.0 - l_discount)",
    "constant": "CAST(1.0 AS DOUBLE)",
}


def lag_rows(window: int, exog: bool = False) -> str:
    names = [("y", "y"), *([("k", "k")] if exog else [])]
    cols = ", ".join(f"lag({c}, {i}) OVER (ORDER BY t) AS {n}_lag_{i}" for n, c in names for i in range(1, window + 1))
    return f"(SELECT t, event_id, y, {cols} FROM {EVENTS})"


def lag_analysis(columns: Sequence[str], top: int, attribute: bool) -> str:
    one = []
    for c in columns:
        for k in range(1, top + 1):
            src = f"(SELECT lag({c}, {k}) OVER (ORDER BY t) AS x, y, t FROM {EVENTS} QUALIFY t >= {k})"
            one.append(
                f"(WITH {encoded(src, ['x', 'y'], [])}, l AS (SELECT {length(['x'])} AS kx, {length(['y'])} AS ky, {length(['x', 'y'])} AS kxy), m AS (SELECT {clip('(kxy - kx) / ky')} AS d, {clip('(kxy - ky) / kx')} AS s FROM l) SELECT {k} AS lag, '{c}_lag_{k}' AS feature_name, round(d, 6) AS deficiency, round(s, 6) AS surplus, round(greatest(d, s), 6) AS miscoding{f", '{c}' AS attribute" if attribute else ''} FROM m)"
            )
    return "\n UNION ALL ".join(one)


def scored(mask: str, score: str, extra: str = "", source: str = PREDICTED) -> str:
    return f"""WITH t AS (SELECT *, y - p AS residual FROM {source}), {extra} a AS (SELECT *, {score} AS s FROM t)
SELECT row_id AS sample_index, round(s, 6) AS anomaly_score, CASE WHEN residual > 0 THEN 'under_predicted' WHEN residual < 0 THEN 'over_predicted' ELSE 'exact' END AS direction FROM a WHERE {mask}"""


_quantile = scored("s >= (SELECT quantile_cont(abs(y - p), 0.95) FROM t)", "abs(residual)")
_scale = "sc AS (SELECT 1.4826 * median(abs(residual - (SELECT median(residual) FROM t))) AS sc FROM t),"


def modes() -> str:
    v = ("deficiency", "surplus", "inaccuracy", "surfeit")
    w = dict(zip(v, (1.0, 2.0, 1.0, 0.5)))
    total = sum(w.values())
    zero = " OR ".join(f"{c} <= 0" for c in v)
    forms = {
        "euclidean": f"sqrt(({' + '.join(f'{c} * {c} * {x}' for c, x in w.items())}) / {total})",
        "arithmetic": f"({' + '.join(f'{c} * {x}' for c, x in w.items())}) / {total}",
        "geometric": f"CASE WHEN {zero} THEN 0.0 ELSE exp(({' + '.join(f'ln({c}) * {x}' for c, x in w.items())}) / {total}) END",
        "harmonic": f"CASE WHEN {zero} THEN 0.0 ELSE {total} / ({' + '.join(f'{x} / {c}' for c, x in w.items())}) END",
        "maximum": f"greatest({', '.join(v)})",
        "addition": " + ".join(f"{c} * {x}" for c, x in w.items()),
        "product": f"CASE WHEN {zero} THEN 0.0 ELSE exp({' + '.join(f'ln({c}) * {x}' for c, x in w.items())}) END",
    }
    return f"SELECT id, {', '.join(f'round(CASE WHEN true THEN {e} END, 6) AS {m}' for m, e in forms.items()).replace('CASE WHEN true THEN CASE', 'CASE WHEN true THEN CASE')} FROM (SELECT id, {', '.join(f'{c}::DOUBLE AS {c}' for c in v)} FROM {COMPONENTS})"


_profile = """CASE WHEN deficiency <= 0.25 AND surplus <= 0.25 AND inaccuracy <= 0.25 AND surfeit <= 0.25 THEN 'low_combined_model' WHEN deficiency >= 0.5 AND surplus < 0.5 THEN 'under_informed_model' WHEN surplus >= 0.5 AND deficiency < 0.5 THEN 'over_fed_model'
 WHEN deficiency <= 0.25 AND surplus <= 0.25 AND inaccuracy >= 0.5 THEN 'bad_learner' WHEN deficiency <= 0.25 AND surplus <= 0.25 AND inaccuracy <= 0.25 AND surfeit >= 0.5 THEN 'over_complex_model' WHEN deficiency >= 0.5 AND surplus >= 0.5 THEN 'poor_input_representation'
 WHEN inaccuracy >= 0.5 AND surfeit >= 0.5 THEN 'complex_but_inaccurate_model' ELSE 'mixed_profile' END"""
_dominant = "CASE greatest(deficiency, surplus, inaccuracy, surfeit) WHEN deficiency THEN 'deficiency' WHEN surplus THEN 'surplus' WHEN inaccuracy THEN 'inaccuracy' ELSE 'surfeit' END"
_pareto = f"WITH c AS (SELECT * FROM {COMPONENTS} WHERE deficiency + surplus + inaccuracy + surfeit >= 1.5) SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.deficiency <= c.deficiency AND o.surplus <= c.surplus AND o.inaccuracy <= c.inaccuracy AND o.surfeit <= c.surfeit AND (o.deficiency < c.deficiency OR o.surplus < c.surplus OR o.inaccuracy < c.inaccuracy OR o.surfeit < c.surfeit))"
_es = [0.3 * 0.7**k for k in range(4)]
_es = [x / sum(_es) for x in _es]
_class = "(SELECT o_orderkey AS row_id, o_orderstatus AS y, CASE WHEN o_totalprice > 250000 THEN 'O' ELSE 'F' END AS p, o_totalprice FROM orders)"
_proba = "(SELECT o.row_id, o.y, c.n / s.n::DOUBLE AS q FROM (SELECT o_orderkey AS row_id, o_orderstatus AS y, o_orderpriority AS g FROM orders) o JOIN (SELECT o_orderstatus AS y, o_orderpriority AS g, count(*) AS n FROM orders GROUP BY ALL) c USING (y, g) JOIN (SELECT o_orderpriority AS g, count(*) AS n FROM orders GROUP BY ALL) s USING (g))"
_two_means = f"""WITH t AS (SELECT *, y - p AS residual FROM {PREDICTED}), a AS (SELECT * FROM t WHERE abs(residual) >= (SELECT quantile_cont(abs(residual), 0.95) FROM t)),
v AS (SELECT 0 AS attribute, l_quantity AS x FROM a UNION ALL SELECT 1, l_discount FROM a UNION ALL SELECT 2, l_tax FROM a),
z AS (SELECT attribute, x, (x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w > 0 THEN stddev_pop(x) OVER w ELSE 1.0 END AS z FROM v WINDOW w AS (PARTITION BY attribute)),
g AS (SELECT attribute, x, any_value(z) AS z, count(*) AS c FROM z GROUP BY attribute, x),
s AS (SELECT attribute, x, sum(c) OVER u AS n0, sum(c * z) OVER u AS s0, sum(c) OVER w AS n, sum(c * z) OVER w AS s, sum(c * z * z) OVER w AS q FROM g WINDOW u AS (PARTITION BY attribute ORDER BY x ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY attribute)),
i AS (SELECT *, q - s0 * s0 / n0 - (s - s0) * (s - s0) / (n - n0) AS inertia FROM s WHERE n > n0),
k AS (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY inertia) AS r FROM i)
SELECT attribute::INTEGER AS attribute, round(x, 6) AS cut, round(inertia, 4) AS inertia, n0::BIGINT AS cluster_0_size, (n - n0)::BIGINT AS cluster_1_size FROM k WHERE r = 1"""
_views = f"""WITH v AS ({_two_means.replace('round(inertia, 4) AS inertia', 'inertia')}), w AS (SELECT *, cluster_0_size + cluster_1_size AS n FROM v)
SELECT attribute AS attribute_1, ['l_quantity', 'l_discount', 'l_tax'][attribute + 1] AS attribute_1_name, 1::INTEGER AS dimensions, round(inertia, 4) AS inertia, cluster_0_size, cluster_1_size, round(abs(cluster_0_size - cluster_1_size) / n, 4) AS balance, n::BIGINT AS n_anomalies
FROM w WHERE least(cluster_0_size, cluster_1_size) / n >= 0.1"""


def _smoothing(window: int, alpha: float) -> list[float]:
    raw = [alpha * (1 - alpha) ** k for k in range(window)]
    return [x / sum(raw) for x in raw]


_fixed = {f"moving_average_w{w}": [1.0 / w] * w for w in (1, 2, 3)} | {
    f"exponential_smoothing_w{w}_a{a:g}": _smoothing(w, a) for w in (1, 2, 3) for a in (0.1, 0.2, 0.3, 0.5, 0.8)
}


def _fixed_scores() -> str:
    one = []
    for name, weights in _fixed.items():
        p = " + ".join(["0e0", *[f"{w:.17e} * y_lag_{k}" for k, w in enumerate(weights, 1)]])
        source = f"(SELECT y, {p} AS p FROM {lag_rows(3)} WHERE t >= 3)"
        one.append(
            f"(SELECT i.candidate, i.inaccuracy, f.estimator_score FROM ({inaccuracy(source, name)}) i, (SELECT round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS estimator_score FROM {source}) f)"
        )
    return "\n UNION ALL ".join(one)


_gram_names = ["one", "l_quantity", "l_discount", "l_tax", "l_extendedprice"]
_gram = "SELECT " + " UNION ALL SELECT ".join(
    f"{i} AS i, {j} AS j, round(sum({a} * {b}) / count(*), 2) AS v FROM (SELECT 1.0::DOUBLE AS one, * FROM lineitem)"
    for i, a in enumerate(_gram_names)
    for j, b in enumerate(_gram_names)
)
_nb_stats = "SELECT l_returnflag AS c, count(*) AS n, " + ", ".join(
    f"avg({x}) AS m{k}, var_pop({x}) AS v{k}" for k, x in enumerate(("l_quantity", "l_extendedprice"))
) + " FROM lineitem GROUP BY 1"
_rolling = f"""WITH RECURSIVE x AS (SELECT list(y ORDER BY t)[-4:] AS h FROM {EVENTS}), r(step, h, v) AS (SELECT 0, h, NULL::DOUBLE FROM x UNION ALL SELECT step + 1, list_append(h[2:], list_avg(h)), list_avg(h) FROM r WHERE step < 5)
SELECT step::INTEGER AS step, round(v, 6) AS forecast FROM r WHERE step > 0"""
_segments = f"""WITH v AS (SELECT * FROM {EVENTS}), b AS (SELECT min(y) AS lo, max(y) AS hi, count(*) AS n FROM v), s AS (SELECT i AS segment, (SELECT n FROM b) AS n FROM range(100) r(i)),
q AS (SELECT segment, least(7, greatest(0, len(list_filter(list_transform(range(1, 8), lambda i: lo + i * ((hi - lo) / 8)), lambda e: e <= y)))) AS st, count(*) AS c FROM v, b, s WHERE t >= segment * 500 AND t < segment * 500 + 1000 AND segment * 500 + 1000 <= b.n GROUP BY ALL)
SELECT segment::BIGINT AS segment, round(sum(-c * log2(c / 1000.0::DOUBLE)), 6) AS code_length FROM q GROUP BY segment"""
_tables = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

SQL: dict[str, str] = {
    "feature_analysis_lineitem": analysis("lineitem", LINE_NUM, LINE_CAT, LINE, LINE_Y, False),
    "rice_bins": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS n, CAST(least(ceil(2 * pow(count(*), 1.0 / 3)), count(*)) AS INTEGER) AS bins FROM {t}" for t in _tables),
    "discretize_extendedprice": f"WITH {encoded('lineitem', ['l_extendedprice'], [])} SELECT l_extendedprice::INTEGER AS bin, count(*)::BIGINT AS n FROM e GROUP BY 1",
    "empirical_states_flag_status": "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS count, round(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS probability FROM lineitem GROUP BY 1, 2",
    "entropy_code_length_by_column": f"WITH {_line} " + " UNION ALL ".join(f"SELECT '{c}' AS feature_name, round({length([c])} / b.n, 6) AS entropy, round({length([c])}, 6) AS code_length, (SELECT count(DISTINCT {c}) FROM e)::BIGINT AS n_states FROM b" for c in [*LINE, LINE_Y]),
    "joint_code_length_price_flag": f"WITH {_line} SELECT round({length(['l_extendedprice', LINE_Y])}, 6) AS code_length, round({length(['l_extendedprice', LINE_Y])} / b.n, 6) AS entropy, b.n::BIGINT AS n_samples, (SELECT count(*) FROM (SELECT DISTINCT l_extendedprice, {LINE_Y} FROM e))::BIGINT AS n_states FROM b",
    "conditional_code_lengths": f"WITH {_line} " + " UNION ALL ".join(f"SELECT '{f}' AS feature_name, round(greatest(0, {length([f, LINE_Y])} - {length([f])}), 6) AS target_given_feature, round(greatest(0, {length([f, LINE_Y])} - {length([LINE_Y])}), 6) AS feature_given_target" for f in LINE),
    "feature_analysis_numeric_target": analysis("lineitem", ["l_quantity", "l_discount", "l_tax"], ["l_linestatus"], ["l_quantity", "l_discount", "l_tax", "l_linestatus"], "l_extendedprice", True),
    "feature_redundancy_lineitem": f"WITH {_line}, {_redundancy()} SELECT fi AS feature_i, fj AS feature_j, round(v, 6) AS redundancy FROM rr",
    "subset_measures_lineitem": _subsets([[0], [0, 1], [0, 1, 2, 3], [1, 4]]),
    "greedy_first_step": f"SELECT feature_index, feature_name, deficiency, surplus, miscoding FROM ({analysis('lineitem', LINE_NUM, LINE_CAT, LINE, LINE_Y, False)}) ORDER BY miscoding, deficiency, surplus, feature_index LIMIT 1",
    "feature_analysis_documents": analysis("(SELECT n_chars, lang, source, quality FROM documents JOIN labels USING (doc_id))", ["n_chars"], ["lang", "source"], ["n_chars", "lang", "source"], "quality", False),
    "feature_analysis_orders": analysis("orders", ["o_totalprice"], ["o_orderpriority"], ["o_totalprice", "o_orderpriority"], "o_orderstatus", False),
    "inaccuracy_rule": inaccuracy(PREDICTED, "p"),
    "inaccuracy_constant_prediction": inaccuracy("(SELECT l_extendedprice AS y, 1.0::DOUBLE AS p FROM lineitem)", "p"),
    "inaccuracy_batch_candidates": " UNION ALL ".join(f"({inaccuracy(f'(SELECT l_extendedprice AS y, {x} AS p FROM lineitem)', c)})" for c, x in CANDIDATES.items()),
    "surfeit_from_lengths": f"WITH {_line}, y AS (SELECT {length([LINE_Y])} AS ky), v AS (SELECT i AS length, i // 2 + 20 AS compressed FROM range(10, 400000, 9973) r(i)) SELECT length::BIGINT AS length, compressed::BIGINT AS compressed, round({clip('1 - least(ky, greatest(0, least(length, compressed - 6))) / length')}, 6) AS surfeit FROM v, y",
    "aggregate_components_all_modes": modes(),
    "profiles_and_dominant": f"SELECT id, {_profile} AS profile, {_dominant} AS dominant FROM {COMPONENTS}",
    "pareto_candidates": _pareto,
    "lag_matrix_events": f"SELECT event_id, round(y, 6) AS y, {', '.join(f'round({c}_lag_{k}, 6) AS {c}_lag_{k}' for c in ('y', 'k') for k in range(1, 5))} FROM {lag_rows(4, True)} WHERE t >= 4",
    "moving_average_forecast": f"SELECT event_id, round(p, 6) AS prediction FROM (SELECT event_id, t, avg(y) OVER (ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS p FROM {EVENTS}) WHERE t >= 4",
    "exp_smoothing_forecast": f"SELECT event_id, round({' + '.join(f'{w!r} * y_lag_{k + 1}' for k, w in enumerate(_es))}, 6) AS prediction FROM {lag_rows(4)} WHERE t >= 4",
    "auto_lag_analysis_events": lag_analysis(["y"], 3, False),
    "cross_lag_analysis_events": lag_analysis(["k"], 3, True),
    "lag_analysis_union": lag_analysis(["y", "k"], 2, True),
    "ts_fixed_candidate_scores": _fixed_scores(),
    "recursive_forecast_ma": _rolling,
    "rolling_segments_code_length": _segments,
    "anomaly_residual_quantile": _quantile,
    "anomaly_standardized_residual": scored("s >= 2.0", "abs(residual / (SELECT sc FROM sc))", _scale),
    "anomaly_bin_mismatch": f"WITH {encoded(PREDICTED, ['y', 'p'], [], ['row_id'])} SELECT raw_row_id AS sample_index, abs(y - p)::DOUBLE AS anomaly_score FROM e WHERE y <> p",
    "anomaly_misclassification": f"SELECT row_id AS sample_index, y AS y_true, p AS y_pred FROM {_class} WHERE y <> p",
    "anomaly_probability_quantile": f"WITH t AS (SELECT * FROM {_proba}) SELECT row_id AS sample_index, round(1 - q, 6) AS anomaly_score FROM t WHERE 1 - q >= (SELECT quantile_cont(1 - q, 0.9) FROM t)",
    "anomaly_summary": f"WITH t AS (SELECT y - p AS r FROM {PREDICTED}), th AS (SELECT quantile_cont(abs(r), 0.95) AS th FROM t) SELECT count(*)::BIGINT AS n_samples, count(*) FILTER (abs(r) >= th)::BIGINT AS n_anomalies, round(avg(abs(r)), 4) AS mean_absolute_residual, round(median(abs(r)), 4) AS median_absolute_residual, count(*) FILTER (abs(r) >= th AND r > 0)::BIGINT AS n_under_predicted, count(*) FILTER (abs(r) >= th AND r < 0)::BIGINT AS n_over_predicted, round(any_value(th), 4) AS threshold FROM t, th",
    "anomaly_by_kind": f"SELECT sample_index FROM ({_quantile}) WHERE direction = 'under_predicted'",
    "anomaly_two_means_1d": _two_means,
    "anomaly_group_views": _views,
    "ols_single_feature": "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem",
    "ols_gram_matrix": _gram,
    "gnb_moments": f"SELECT c AS class, n::BIGINT AS n, round(m0, 4) AS mean_0, round(v0, 4) AS var_0, round(m1, 4) AS mean_1, round(v1, 1) AS var_1 FROM ({_nb_stats})",
    "gnb_scores_accuracy": f"WITH s AS ({_nb_stats}), n AS (SELECT sum(n) AS total FROM s), x AS (SELECT l_returnflag AS y, c, ln(n / total::DOUBLE) - 0.5 * ln(2 * pi() * v0) - (l_quantity - m0) ** 2 / (2 * v0) - 0.5 * ln(2 * pi() * v1) - (l_extendedprice - m1) ** 2 / (2 * v1) AS sc, rid AS id FROM (SELECT *, row_number() OVER () AS rid FROM lineitem), s, n), p AS (SELECT id, any_value(y) AS y, arg_max(c, sc) AS p FROM x GROUP BY id) SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p",
    "windowed_code_length": "WITH c AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS c FROM events GROUP BY 1, 2), n AS (SELECT day, sum(c) AS n FROM c GROUP BY 1) SELECT strftime(day, '%Y-%m-%d') AS day, round(sum(-c.c * log2(c.c / n.n::DOUBLE)), 6) AS code_length, any_value(n.n)::BIGINT AS n FROM c JOIN n USING (day) GROUP BY day",
}
