"""DuckDB SQL for whole factor models of three nodes: projectors of all three factors, in closed form.

What depends on a factor's sign or on an eigenvector alone is said in projectors: a squared cosine is the trace of a product,
a score's share of a vector is the projector times it. So matching, templates and factor forecasts have SQL of their own.
"""

from __future__ import annotations

from ..operators.factors import SHAPES, shape_templates
from .oracles import C3, COVARIANCES, EIG, N3, PAIRS, ROLLING, each, r
from .queries import HISTORY, THREE, TRAIN

CELLS = [(i, j) for i in range(3) for j in range(3)]
BOUND, LEAST_SIMILARITY, LEAST_MARGIN = 0.995, 0.70, 0.10


def _cell(i: int, j: int) -> str:
    return f"c{min(i, j)}{max(i, j)}"


def projector(k: int, i: int, j: int) -> str:
    """Cell of the projector on factor ``k`` of a row with c00 .. c22 and l1, l2, l3."""
    a, b = (m for m in (1, 2, 3) if m != k)
    inner = " + ".join(f"({_cell(i, m)}{f' - l{a}' if i == m else ''}) * ({_cell(m, j)}{f' - l{b}' if m == j else ''})" for m in range(3))
    return f"(({inner}) / ((l{k} - l{a}) * (l{k} - l{b})))"


def all_factors(source: str, keys: str, name: str) -> str:
    """CTEs that end in ``name``: keys, l1 >= l2 >= l3 and the projectors f1_00 .. f3_22 of the covariances in ``source``."""
    steps = f"{name}a AS (SELECT *, (c00 + c11 + c22) / 3 AS q FROM {source}), {name}b AS (SELECT *, sqrt(((c00 - q)^2 + (c11 - q)^2 + (c22 - q)^2 + 2 * (c01^2 + c02^2 + c12^2)) / 6) AS s FROM {name}a)"
    minor = "((c00 - q) * ((c11 - q) * (c22 - q) - c12 * c12) - c01 * (c01 * (c22 - q) - c12 * c02) + c02 * (c01 * c12 - (c11 - q) * c02))"
    steps += f", {name}c AS (SELECT *, acos(greatest(-1, least(1, {minor} / (2 * s^3)))) / 3 AS phi FROM {name}b)"
    steps += f", {name}d AS (SELECT *, q + 2 * s * cos(phi) AS l1, q + 2 * s * cos(phi + 2 * pi() / 3) AS l3 FROM {name}c), {name}e AS (SELECT *, 3 * q - l1 - l3 AS l2 FROM {name}d)"
    cells = ", ".join(f"{projector(k, i, j)} AS f{k}_{i}{j}" for k in (1, 2, 3) for i, j in CELLS)
    return steps + f", {name} AS (SELECT {keys}, l1, l2, l3, {cells} FROM {name}e)"


def cosine(a: int, b: int) -> str:
    """Cosine between factor ``a`` of row a and factor ``b`` of row b."""
    return "sqrt(greatest(0, least(1, " + " + ".join(f"a.f{a}_{i}{j} * b.f{b}_{i}{j}" for i, j in CELLS) + ")))"


def two_factor_rolling() -> str:
    whole = all_factors(f"(SELECT panel, {COVARIANCES} FROM ch GROUP BY panel)", "panel", "two_whole")
    rolled = all_factors("wc", "panel, window_end", "two_rolled")
    sims = ", ".join(f"{cosine(a, b)} AS s{a}{b}" for a in (1, 2) for b in (1, 2))
    joined = f"tw AS (SELECT b.panel, window_end, (b.l1 + b.l2) / (b.l1 + b.l2 + b.l3) AS share, {sims}, degrees(acos({cosine(3, 3)})) AS angle FROM two_whole a JOIN two_rolled b USING (panel))"
    straight = "s11 + s22 >= s12 + s21"
    picked = f"CASE WHEN {straight} THEN s11 ELSE s12 END AS cosine_1, CASE WHEN {straight} THEN s22 ELSE s21 END AS cosine_2, CASE WHEN {straight} THEN 1 ELSE 2 END AS matched_1, CASE WHEN {straight} THEN 2 ELSE 1 END AS matched_2"
    shown = ", ".join(f"{r(c, 3)} AS {c}" for c in ("share", "cosine_1", "cosine_2", "angle"))
    return f"{ROLLING}, {whole}, {rolled}, {joined} SELECT panel, window_end, {shown}, matched_1, matched_2 FROM (SELECT *, {picked} FROM tw)"


def template_match() -> str:
    """Which shape each factor is matched with, of the six ways to match three."""
    from itertools import permutations

    t = shape_templates(THREE.maturities)
    whole = all_factors(f"(SELECT panel, {COVARIANCES} FROM ch GROUP BY panel)", "panel", "two_whole")
    close = ", ".join(f"sqrt(greatest(0, {' + '.join(f'f{k}_{i}{j} * {float(t[m, i] * t[m, j])!r}' for i, j in CELLS)})) AS s{k}{m}" for k in (1, 2, 3) for m in range(3))
    ways = list(permutations(range(3)))
    sums = ", ".join("s1{} + s2{} + s3{}".format(*w) for w in ways)
    chosen = "list_position([{0}], list_max([{0}]))".format(sums)
    rows = []
    for k in (1, 2, 3):
        at = "[" + ", ".join(str(w[k - 1]) for w in ways) + "][w]"
        matched = f"[s{k}0, s{k}1, s{k}2][{at} + 1]"
        others = f"list_max(list_filter([{{'m': 0, 's': s{k}0}}, {{'m': 1, 's': s{k}1}}, {{'m': 2, 's': s{k}2}}], lambda x: x.m <> {at}).apply(lambda x: x.s))"
        rows.append(f"SELECT panel, {k} AS component, {at} AS shape, {matched} AS similarity, {matched} - {others} AS margin FROM ch3")
    names = "[" + ", ".join(f"'{s}'" for s in SHAPES) + "]"
    known = f"similarity >= {LEAST_SIMILARITY} AND margin >= {LEAST_MARGIN}"
    return (
        f"{C3}, {whole}, cl3 AS (SELECT panel, {close} FROM two_whole), ch3 AS (SELECT *, {chosen} AS w FROM cl3), al3 AS ({' UNION ALL '.join(rows)})"
        f" SELECT panel, component, {names}[shape + 1] AS suggested_shape, {known} AS identified, 'PC' || component || ' ' || CASE WHEN {known} THEN {names}[shape + 1] ELSE 'Unidentified' END AS label,"
        f" {r('similarity', 3)} AS similarity, {r('margin', 3)} AS margin FROM al3"
    )


def factor_ar1() -> str:
    """Errors of the factor AR(1) walk with all three factors: now + sum over k of slope_k P_k (last - past)."""
    lags = ", ".join(f'lag("{n}") OVER (PARTITION BY panel ORDER BY pos) AS y{i}' for i, n in enumerate(N3))
    over = "OVER (PARTITION BY panel ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    cov = ", ".join(f"covar_samp(x{i}, x{j}) {over} AS c{i}{j}" for i, j in PAIRS)
    pairs = "FILTER (WHERE y0 IS NOT NULL)"
    means = ", ".join(f"avg(x{i}) {pairs} {over} AS now{i}, avg(y{i}) {over} AS past{i}" for i in range(3))
    cross = ", ".join(f"covar_pop(x{i}, y{j}) {over} AS k{i}{j}" for i, j in CELLS)
    own = ", ".join(f"covar_pop(y{i}, y{j}) {over} AS m{i}{j}" for i, j in CELLS)
    rows = f"lx AS (SELECT panel, pos, {', '.join(f'{chr(34)}{n}{chr(34)} AS x{i}' for i, n in enumerate(N3))}, {lags} FROM ch), or3 AS (SELECT panel, pos, x0, x1, x2, y0, y1, y2, {cov}, {means}, {cross}, {own} FROM lx), og3 AS (SELECT * FROM or3 WHERE pos >= {TRAIN})"
    keep = "panel, pos, x0, x1, x2, y0, y1, y2, " + ", ".join(f"now{i}, past{i}" for i in range(3)) + ", " + ", ".join(f"k{i}{j}, m{i}{j}" for i, j in CELLS)
    model = all_factors("og3", keep, "ar3")
    trace = lambda k, c: " + ".join(f"f{k}_{i}{j} * {c}{i}{j}" for i, j in CELLS)
    slopes = ", ".join(f"greatest(-{BOUND}, least({BOUND}, ({trace(k, 'k')}) / ({trace(k, 'm')}))) AS b{k}" for k in (1, 2, 3))
    fitted = ", ".join(f"now{i} + " + " + ".join(f"b{k} * (" + " + ".join(f"f{k}_{i}{j} * (y{j} - past{j})" for j in range(3)) + ")" for k in (1, 2, 3)) for i in range(3))
    nodes = each("'{n}'")
    long = f"fa3 AS (SELECT panel, pos, UNNEST([{nodes}]) AS node, UNNEST([x0, x1, x2]) AS actual, UNNEST([{fitted}]) AS fitted FROM (SELECT *, {slopes} FROM ar3))"
    figures = f"{r('sqrt(avg((fitted - actual)^2))', 4)} AS rmse, {r('avg(fitted - actual)', 4)} AS bias, {r('avg(fitted)', 4)} AS mean_forecast"
    return f"{C3}, {rows}, {model}, {long} SELECT panel, node, count(*) AS n, {figures} FROM fa3 GROUP BY panel, node"


def latest_mean_bands() -> str:
    """Bands of the next level around the historical mean, from the last HISTORY one-step errors."""
    long = f"lg AS (SELECT panel, date, pos, node, value FROM ch UNPIVOT (value FOR node IN ({each(chr(34) + '{n}' + chr(34))})))"
    errors = f"er AS (SELECT panel, node, pos, value - avg(value) OVER (PARTITION BY panel, node ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM lg), ev AS (SELECT *, row_number() OVER (PARTITION BY panel, node ORDER BY pos DESC) AS back FROM er WHERE pos >= {TRAIN})"
    points = {"l80": (1 - 0.80) / 2, "u80": 1 - (1 - 0.80) / 2, "l95": (1 - 0.95) / 2, "u95": 1 - (1 - 0.95) / 2}
    ends = ", ".join(f"quantile_cont(e, {q}) AS {n}" for n, q in points.items())
    levels = f"lv AS (SELECT panel, node, arg_max(value, date) AS level, arg_max(period_end, date) AS e FROM weekly UNPIVOT (value FOR node IN ({each(chr(34) + '{n}' + chr(34))})) GROUP BY panel, node)"
    joined = f"bn AS (SELECT panel, node, {ends} FROM ev WHERE back <= {HISTORY} GROUP BY panel, node), mn AS (SELECT panel, node, avg(value) AS change FROM lg GROUP BY panel, node)"
    out = ", ".join(f"{{'coverage': {c}::DOUBLE, 'lower': level + (change + l{n}) / 100, 'upper': level + (change + u{n}) / 100}}" for c, n in ((0.8, 80), (0.95, 95)))
    return (
        f"{C3}, {long}, {errors}, {levels}, {joined} SELECT panel, node, target_period_end, forecast_level, x.coverage AS coverage, {r('x.lower', 5)} AS lower, {r('x.upper', 5)} AS upper FROM"
        f" (SELECT panel, node, (e + 7)::VARCHAR AS target_period_end, {r('level + change / 100', 5)} AS forecast_level, UNNEST([{out}]) AS x FROM lv JOIN bn USING (panel, node) JOIN mn USING (panel, node))"
    )


def factor_sql() -> dict[str, str]:
    """SQL by query name."""
    spectrum = f"{EIG} SELECT panel, component, {r('l', 4)} AS eigenvalue, {r('l / (l1 + l2 + l3)', 4)} AS share, {r('c / (l1 + l2 + l3)', 4)} AS cumulative_share FROM (SELECT panel, l1, l2, l3, UNNEST([1, 2, 3])::INT AS component, UNNEST([l1, l2, l3]) AS l, UNNEST([l1, l1 + l2, l1 + l2 + l3]) AS c FROM e6)"
    return {"spectrum_by_qr": spectrum, "two_factor_rolling": two_factor_rolling(), "template_match": template_match(), "factor_ar1": factor_ar1(), "latest_mean_bands": latest_mean_bands()}
