"""DuckDB SQL for the registered queries, each from the raw tables by a route of its own."""

from __future__ import annotations

from ..config import DataConfig
from .queries import CONFIRMATION, DV01_THREE, EVALUATION, HALFLIFE, HISTORY, LEAST, SEVEN, THREE, TRAIN, UNIT, VAR_WINDOW

N3 = THREE.names


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def each(template: str, names=N3, sep: str = ", ") -> str:
    return sep.join(template.format(n=n, i=i) for i, n in enumerate(names))


def curve(node: str, panel: str, names, where: str = "") -> str:
    q = each('avg(l_extendedprice / ' + str(UNIT) + ") FILTER (WHERE {c} = '{n}') AS \"{n}\"".replace("{c}", node), names)
    full = each('"{n}" IS NOT NULL', names, " AND ")
    moved = each('("{n}" - lag("{n}") OVER p) * 100 AS "{n}"', names)
    return f"""daily AS (SELECT {panel} AS panel, l_shipdate::DATE AS date, {q} FROM lineitem {where} GROUP BY 1, 2),
whole AS (SELECT *, date + ((5 - isodow(date) + 7) % 7)::INT AS period_end FROM daily WHERE {full}),
weekly AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY panel, period_end ORDER BY date DESC) AS k FROM whole) WHERE k = 1),
ch AS (SELECT * FROM (SELECT panel, date, period_end, {moved}, (date - lag(date) OVER p)::INT AS gap_days, row_number() OVER p - 2 AS pos, count(*) OVER (PARTITION BY panel) - 1 AS n_rows FROM weekly WINDOW p AS (PARTITION BY panel ORDER BY date)) WHERE pos >= 0)"""


C3 = "WITH " + curve("l_returnflag", "l_linestatus", N3)
C7 = "WITH " + curve("l_linenumber::VARCHAR", "'price'", SEVEN.names)
LONG = C3 + ", lg AS (SELECT panel, date, pos, n_rows, node, value FROM ch UNPIVOT (value FOR node IN (" + each('"{n}"') + ")))"
DOT = " + ".join(f'"{n}" * {v}' for n, v in zip(N3, DV01_THREE, strict=True))
PNL = C3 + f", pn AS (SELECT panel, date, pos, n_rows, gap_days, -({DOT}) AS pnl FROM ch)"
# the largest eigenvalue of a symmetric 3 x 3 matrix by the trigonometric formula, and its projector
PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
EIG = (
    C3
    + ", cv AS (SELECT panel, " + each('avg("{n}") AS m{i}') + ", "
    + ", ".join(f'covar_samp("{N3[i]}", "{N3[j]}") AS c{i}{j}' for i, j in PAIRS)
    + " FROM ch GROUP BY panel), e1 AS (SELECT *, (c00 + c11 + c22) / 3 AS q FROM cv), e2 AS (SELECT *, sqrt(((c00 - q)^2 + (c11 - q)^2 + (c22 - q)^2 + 2 * (c01^2 + c02^2 + c12^2)) / 6) AS s FROM e1),"
    " e3 AS (SELECT *, ((c00 - q) * ((c11 - q) * (c22 - q) - c12 * c12) - c01 * (c01 * (c22 - q) - c12 * c02) + c02 * (c01 * c12 - (c11 - q) * c02)) / (2 * s^3) AS d FROM e2),"
    " e4 AS (SELECT *, acos(greatest(-1, least(1, d))) / 3 AS phi FROM e3), e5 AS (SELECT *, q + 2 * s * cos(phi) AS l1, q + 2 * s * cos(phi + 2 * pi() / 3) AS l3 FROM e4), e6 AS (SELECT *, 3 * q - l1 - l3 AS l2 FROM e5)"
)


def _c(i, j):
    return f"c{min(i, j)}{max(i, j)}"


def _proj(i, j):
    inner = " + ".join(f"({_c(i, k)}{' - l2' if i == k else ''}) * ({_c(k, j)}{' - l3' if k == j else ''})" for k in range(3))
    return f"(({inner}) / ((l1 - l2) * (l1 - l3)))"


PROJ = EIG + ", pr AS (SELECT panel, l1, l2, l3, m0, m1, m2, " + ", ".join(f"{_c(i, j)}" for i, j in PAIRS) + ", " + ", ".join(f"{_proj(i, j)} AS p{i}{j}" for i in range(3) for j in range(3)) + " FROM e6)"
D = DV01_THREE
FORECAST = LONG + f""", fm AS (SELECT panel, date, pos, node, value AS actual, avg(value) OVER (PARTITION BY panel, node ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean FROM lg),
fc AS (SELECT panel, date, pos, 'No change' AS model, node, actual, 0.0::DOUBLE AS fitted FROM fm WHERE pos >= {TRAIN} UNION ALL SELECT panel, date, pos, 'Historical mean', node, actual, mean FROM fm WHERE pos >= {TRAIN})"""
HITS = FORECAST + f""", rs AS (SELECT panel, date, pos, node, actual - fitted AS e, row_number() OVER (PARTITION BY panel, node ORDER BY pos) - 1 AS row FROM fc WHERE model = 'Historical mean'),
bd AS (SELECT *, """ + ", ".join(f"quantile_cont(e, {q}) OVER w AS {name}" for name, q in (("l80", (1 - 0.80) / 2), ("u80", 1 - (1 - 0.80) / 2), ("l95", (1 - 0.95) / 2), ("u95", 1 - (1 - 0.95) / 2))) + f""" FROM rs WINDOW w AS (PARTITION BY panel, node ORDER BY pos ROWS BETWEEN {HISTORY} PRECEDING AND 1 PRECEDING)),
ht AS (SELECT panel, date, pos, node, 0.8::DOUBLE AS coverage, l80 AS lower, u80 AS upper, e BETWEEN l80 AND u80 AS hit FROM bd WHERE row >= {LEAST} UNION ALL SELECT panel, date, pos, node, 0.95::DOUBLE, l95, u95, e BETWEEN l95 AND u95 FROM bd WHERE row >= {LEAST})"""
WIDE3 = each(r('"{n}"') + ' AS "{n}"')


def _tail(scope: str, where: str) -> str:
    return f"""SELECT panel, '{scope}' AS scope, n, window_start, window_end, measure, confidence, loss, tail_mass, rank, exception_bound, attainable, CASE WHEN tail_mass >= 20 THEN 'REVIEW LEVEL MET' ELSE 'BELOW REVIEW LEVEL' END AS status FROM (
WITH o AS (SELECT panel, date, -pnl AS loss, row_number() OVER (PARTITION BY panel ORDER BY pnl, date) AS k, count(*) OVER (PARTITION BY panel) AS n FROM pn {where}),
g AS (SELECT panel, n, min(date) AS window_start, max(date) AS window_end, max(loss) FILTER (WHERE k = n - least(n, ceil((n + 1) * 0.99::DOUBLE)) + 1) AS v, sum(loss * greatest(0, least(1, n * (1 - 0.975::DOUBLE) - (k - 1)))) / max(n * (1 - 0.975::DOUBLE)) AS es FROM o GROUP BY panel, n)
SELECT *, 'VaR' AS measure, 0.99::DOUBLE AS confidence, v AS loss, n * (1 - 0.99::DOUBLE) AS tail_mass, least(n, ceil((n + 1) * 0.99::DOUBLE))::BIGINT AS rank, (n + 1 - least(n, ceil((n + 1) * 0.99::DOUBLE))) / (n + 1) AS exception_bound, (n + 1 - least(n, ceil((n + 1) * 0.99::DOUBLE))) / (n + 1) <= 1 - 0.99::DOUBLE + 2.220446049250313e-16 AS attainable FROM g WHERE n >= 52
UNION ALL SELECT *, 'ES', 0.975::DOUBLE, es, n * (1 - 0.975::DOUBLE), NULL, NULL, NULL FROM g WHERE n >= 52)"""


RANK = min(VAR_WINDOW, -(-(VAR_WINDOW + 1) * 99 // 100))
BOUND = f"({VAR_WINDOW + 1 - RANK}::DOUBLE / {VAR_WINDOW + 1})"
BACK = PNL + f", bt AS (SELECT panel, date, pos, min(date) OVER w AS estimation_start, max(date) OVER w AS estimation_end, list_sort(list(-pnl) OVER w)[{RANK}] AS var, -pnl AS loss FROM pn WINDOW w AS (PARTITION BY panel ORDER BY pos ROWS BETWEEN {VAR_WINDOW} PRECEDING AND 1 PRECEDING)), bx AS (SELECT *, loss > var AS exception FROM bt WHERE pos >= {VAR_WINDOW})"


def _xlogy(x: str, y: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 0 ELSE {x} * ln({y}) END)"


LAGS = 10


def _ljung_box(c: str) -> str:
    rho = " + ".join(f"((sum((x.{c} - m.m{c}) * (x.{c}{k} - m.m{c})) FILTER (WHERE x.{c}{k} IS NOT NULL) / sum((x.{c} - m.m{c})^2))^2 / (count(*) - {k}))" for k in range(1, LAGS + 1))
    return f"(count(*) * (count(*) + 2.0) * ({rho}))"


def _chi2_even(q: str, df: int) -> str:
    terms, factorial = ["1.0"], 1
    for k in range(1, df // 2):
        factorial *= k
        terms.append(f"power({q} / 2, {k}) / {factorial}")
    return f"(exp(-{q} / 2) * ({' + '.join(terms)}))"


HAC = FORECAST + """, la AS (SELECT f.panel, f.model, f.pos, avg((f.actual - b.fitted)^2 - (f.actual - f.fitted)^2 + (b.fitted - f.fitted)^2) AS a FROM fc f JOIN fc b ON b.model = 'No change' AND f.panel = b.panel AND f.pos = b.pos AND f.node = b.node WHERE f.model = 'Historical mean' GROUP BY 1, 2, 3),
lm AS (SELECT panel, model, pos, a - avg(a) OVER (PARTITION BY panel, model) AS c, avg(a) OVER (PARTITION BY panel, model) AS m FROM la),
ll AS (SELECT *, """ + ", ".join(f"lag(c, {k}) OVER (PARTITION BY panel, model ORDER BY pos) AS c{k}" for k in range(1, 5)) + """ FROM lm),
lr AS (SELECT panel, model, count(*) AS n, max(m) AS m, sum(c * c) / count(*)""" + "".join(f" + 2 * (1 - {k} / 5.0) * coalesce(sum(c * c{k}), 0) / count(*)" for k in range(1, 5)) + " AS v FROM ll GROUP BY 1, 2)"


def eigen_steps(source: str, keys: str, name: str = "eg") -> str:
    """CTEs that end in ``name``: keys, c00 .. c22, l1 >= l2 >= l3 and the first projector p00 .. p22 of covariances in ``source``.

    Eigenvalues by the trigonometric formula, the projector from (C - l2)(C - l3).
    """
    steps = f"{name}1 AS (SELECT *, (c00 + c11 + c22) / 3 AS q FROM {source})"
    steps += f", {name}2 AS (SELECT *, sqrt(((c00 - q)^2 + (c11 - q)^2 + (c22 - q)^2 + 2 * (c01^2 + c02^2 + c12^2)) / 6) AS s FROM {name}1)"
    steps += f", {name}3 AS (SELECT *, ((c00 - q) * ((c11 - q) * (c22 - q) - c12 * c12) - c01 * (c01 * (c22 - q) - c12 * c02) + c02 * (c01 * c12 - (c11 - q) * c02)) / (2 * s^3) AS d FROM {name}2)"
    steps += f", {name}4 AS (SELECT *, acos(greatest(-1, least(1, d))) / 3 AS phi FROM {name}3)"
    steps += f", {name}5 AS (SELECT *, q + 2 * s * cos(phi) AS l1, q + 2 * s * cos(phi + 2 * pi() / 3) AS l3 FROM {name}4)"
    steps += f", {name}6 AS (SELECT *, 3 * q - l1 - l3 AS l2 FROM {name}5)"
    cells = ", ".join(f"{_proj(i, j)} AS p{i}{j}" for i in range(3) for j in range(3))
    return steps + f", {name} AS (SELECT {keys}, l1, l2, l3, {cells} FROM {name}6)"


COVARIANCES = ", ".join(f'covar_samp("{N3[i]}", "{N3[j]}") AS c{i}{j}' for i, j in PAIRS)
MEANS = ", ".join(f'avg("{n}") AS m{i}' for i, n in enumerate(N3))
# squared cosine of two first factors: the trace of the product of their projectors
COS2 = "greatest(0, least(1, " + " + ".join(f"a.p{i}{j} * b.p{i}{j}" for i in range(3) for j in range(3)) + "))"
COSINE, ANGLE = f"sqrt({COS2})", f"degrees(acos(sqrt({COS2})))"


def _windows(width: int, step: int = 13) -> str:
    """Ends of windows: width, width + step, ... and the last row of each panel."""
    return f"we AS (SELECT DISTINCT panel, window_end FROM (SELECT panel, UNNEST(list_distinct(list_append(range({width}, n_rows + 1, {step}), n_rows))) AS window_end FROM (SELECT DISTINCT panel, n_rows FROM ch WHERE n_rows >= {width})))"


WHOLE = eigen_steps(f"(SELECT panel, {COVARIANCES} FROM ch GROUP BY panel)", "panel", "ref")
WEIGHT = f"power(0.5, (n_rows - 1 - pos) / {HALFLIFE}::DOUBLE)"
# recency-weighted covariances of each panel: centred by the weighted mean, divided by 1 - sum of squared weights
RECENT_COV = (
    f"wr AS (SELECT *, {WEIGHT} / sum({WEIGHT}) OVER (PARTITION BY panel) AS w FROM ch), wm AS (SELECT panel, sum(w * w) AS w2, " + ", ".join(f'sum(w * "{n}") AS m{i}' for i, n in enumerate(N3)) + " FROM wr GROUP BY panel), "
    "rc AS (SELECT wr.panel, 1 / max(w2) AS n_eff, " + ", ".join(f'sum(w * ("{N3[i]}" - m{i}) * ("{N3[j]}" - m{j})) / (1 - max(w2)) AS c{i}{j}' for i, j in PAIRS) + " FROM wr JOIN wm USING (panel) GROUP BY wr.panel)"
)
ROLLING = f"{C3}, {WHOLE}, {_windows(104)}, wc AS (SELECT we.panel, window_end, min(date) AS first_date, max(date) AS last_date, count(*) AS n_obs, {COVARIANCES} FROM we JOIN ch ON ch.panel = we.panel AND pos >= window_end - 104 AND pos < window_end GROUP BY we.panel, window_end), {eigen_steps('wc', 'panel, window_end, first_date, last_date, n_obs', 'roll')}"
HALVES = ", ".join(
    f"{eigen_steps(f'(SELECT we.panel, window_end, {COVARIANCES} FROM we2 we JOIN ch ON ch.panel = we.panel AND pos >= window_end - {lo} AND pos < window_end - {hi} GROUP BY we.panel, window_end)', 'panel, window_end', name)}"
    for name, lo, hi in (("early", 208, 104), ("late", 104, 0))
)
SEQUENTIAL = f"{_windows(208).replace('we AS', 'we2 AS')}, {HALVES}"
VINTAGE = 13
OOS = (
    f"vn AS (SELECT panel, v, {MEANS}, {COVARIANCES} FROM (SELECT DISTINCT panel, ((pos - {TRAIN}) // {VINTAGE})::BIGINT AS v FROM ch WHERE pos >= {TRAIN}) x JOIN ch USING (panel) WHERE ch.pos < {TRAIN} + v * {VINTAGE} GROUP BY panel, v), "
    + eigen_steps("vn", "panel, v, m0, m1, m2", "vint")
    + ", ov AS (SELECT ch.panel, pos, UNNEST(["
    + each("'{n}'")
    + "]) AS node, UNNEST(["
    + ", ".join(f'"{n}" - (m{i} + ' + " + ".join(f'p{i}{j} * ("{N3[j]}" - m{j})' for j in range(3)) + ")" for i, n in enumerate(N3))
    + f"]) AS e FROM ch JOIN vint ON vint.panel = ch.panel AND v = (pos - {TRAIN}) // {VINTAGE} WHERE pos >= {TRAIN})"
)
FIRST_HEALTH = f"""{ROLLING}, {SEQUENTIAL}, {OOS}, rl AS (SELECT a.panel, {COSINE} AS c, {ANGLE} AS g FROM roll a JOIN ref b USING (panel)),
sq AS (SELECT a.panel, a.window_end, {COSINE} AS c, {ANGLE} AS g FROM late a JOIN early b USING (panel, window_end)), rm AS (SELECT panel, node, sqrt(avg(e * e)) AS rmse FROM ov GROUP BY panel, node),
hh AS (SELECT panel, 'Rolling subspace angle' AS monitor, max(g) AS result, 30::DOUBLE AS threshold, max(g) <= 30 AS ok FROM rl GROUP BY panel UNION ALL SELECT panel, 'Rolling loading cosine', min(c), 0.8, min(c) >= 0.8 FROM rl GROUP BY panel
UNION ALL SELECT panel, 'Out-of-sample RMSE', max(rmse), 5, max(rmse) <= 5 FROM rm GROUP BY panel UNION ALL SELECT panel, 'Sequential subspace angle', max(g), 30, max(g) <= 30 FROM sq GROUP BY panel UNION ALL SELECT panel, 'Sequential loading cosine', min(c), 0.8, min(c) >= 0.8 FROM sq GROUP BY panel
UNION ALL SELECT panel, 'Latest sequential angle', arg_max(g, window_end), 30, arg_max(g, window_end) <= 30 FROM sq GROUP BY panel UNION ALL SELECT panel, 'Latest sequential cosine', arg_max(c, window_end), 0.8, arg_max(c, window_end) >= 0.8 FROM sq GROUP BY panel),
health AS (SELECT panel, monitor, result, threshold, CASE WHEN ok THEN 'PASS' ELSE 'WARN' END AS status FROM hh)"""
FORECAST7 = f"""{C7}, lg AS (SELECT panel, date, pos, n_rows, node, value FROM ch UNPIVOT (value FOR node IN ({each('"{n}"', SEVEN.names)}))), fm AS (SELECT panel, pos, node, value AS actual, avg(value) OVER (PARTITION BY panel, node ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean FROM lg),
fc AS (SELECT panel, pos, 'No change' AS model, node, actual, 0.0::DOUBLE AS fitted FROM fm WHERE pos >= {TRAIN} UNION ALL SELECT panel, pos, 'Historical mean', node, actual, mean FROM fm WHERE pos >= {TRAIN})"""
METRICS = "count(*) AS n, {} FROM fc GROUP BY GROUPING SETS ((panel, model, node), (panel, model))"


def _gate_side(x: str) -> str:
    """HAC statistic of a loss advantage within its panel and partition: lags of up to four rows, Bartlett weights."""
    lags = ", ".join(f"lag(c, {k}) OVER (PARTITION BY panel, part ORDER BY pos) AS c{k}" for k in range(1, 5))
    v = f"sum(c * c) / count(*)" + "".join(f" + 2 * (1 - {k} / 5.0) * coalesce(sum(c * c{k}), 0) / count(*)" for k in range(1, 5))  # noqa: F541
    return f"(SELECT panel, part, max(m) AS mean, max(m) / sqrt(({v}) / count(*)) AS statistic FROM (SELECT *, {lags} FROM (SELECT panel, part, pos, {x} - avg({x}) OVER (PARTITION BY panel, part) AS c, avg({x}) OVER (PARTITION BY panel, part) AS m FROM gp)) GROUP BY panel, part)"


GATE = f"""{FORECAST}, gn AS (SELECT *, max(pos) OVER (PARTITION BY panel) + 1 AS n FROM fc), gs AS (SELECT *, CASE WHEN pos >= n - {EVALUATION} THEN NULL WHEN pos >= n - {EVALUATION} - {CONFIRMATION} THEN 'Confirmation' ELSE 'Selection' END AS part FROM gn),
gp AS (SELECT f.panel, f.part, f.pos, f.date, avg((f.actual - b.fitted)^2 - (f.actual - f.fitted)^2) AS raw, avg((f.actual - b.fitted)^2 - (f.actual - f.fitted)^2 + (b.fitted - f.fitted)^2) AS adj, avg((f.actual - f.fitted)^2) AS loss, avg((f.actual - b.fitted)^2) AS base FROM gs f JOIN gs b ON b.model = 'No change' AND f.panel = b.panel AND f.pos = b.pos AND f.node = b.node WHERE f.model = 'Historical mean' AND f.part IS NOT NULL GROUP BY ALL),
gm AS (SELECT panel, part, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, sqrt(avg(loss)) AS rmse, 1 - sqrt(avg(loss)) / sqrt(avg(base)) AS improvement FROM gp GROUP BY panel, part)"""
SETTINGS = DataConfig(start_date="1995-01-01", end_date="2001-11-30", boundary_week_policy="include_and_flag", minimum_complete_weeks=52)
AS_OF, REGIME = "2001-12-01", "1998-06-01"


def _checks() -> str:
    """Controls of three_daily under SETTINGS, each as a figure and a test of it."""
    s = SETTINGS
    end = "{0} + ((5 - isodow({0}) + 7) % 7)::INT"
    inside = lambda hi: "x BETWEEN 0 AND " + str(hi)
    rows = [
        ("daily", "Day held twice", "duplicate_days", "0 to 0", "x = 0", "FAIL"), ("daily", "Smallest value", "min_value", "above -5", "x > -5", "FAIL"), ("daily", "Largest value", "max_value", "0.25 to below 25", "x >= 0.25 AND x < 25", "FAIL"),
        ("daily", "Values of zero", "n_zeros", "0 to 0", "x = 0", "WARN"), ("daily", "Days before the first whole one", f"fc - DATE '{s.start_date}'", f"0 to {s.maximum_start_coverage_gap_days}", inside(s.maximum_start_coverage_gap_days), "FAIL"),
        ("weekly", "Empty cells in weeks", "0", "0 to 0", "x = 0", "FAIL"), ("weekly", "Days after the last week", f"DATE '{s.end_date}' - lw", f"0 to {s.maximum_end_coverage_gap_days}", inside(s.maximum_end_coverage_gap_days), "FAIL"),
        ("weekly", "Days from the last curve to its week's end", f"least(DATE '{s.end_date}', {end.format('lw')}) - lw", f"0 to {s.maximum_within_week_observation_lag_days}", inside(s.maximum_within_week_observation_lag_days), "FAIL"),
        ("weekly", "First and last week are those expected", f"({end.format('fw')} = {end.format('fc')} AND {end.format('lw')} = {end.format('lc')})::INT", "at least 1", "x >= 1", "FAIL"),
        ("weekly", "Weeks cut by the request", f"(DATE '{s.start_date}' > {end.format('fw')} - 6 OR DATE '{s.end_date}' < {end.format('lw')})::INT", "0 to 0", "x = 0", "WARN"),
        ("changes", "Changes", "n_changes", f"at least {s.minimum_complete_weeks}", f"x >= {s.minimum_complete_weeks}", "FAIL"), ("changes", "Empty cells in changes", "0", "0 to 0", "x = 0", "FAIL"), ("changes", "Nodes that never move", "still", "0 to 0", "x = 0", "FAIL"),
        ("changes", "Longest gap in days", "max_gap", f"at most {s.maximum_calendar_gap_days}", f"x <= {s.maximum_calendar_gap_days}", "FAIL"), ("changes", "Changes over other than seven days", "not_seven", "0 to 0", "x = 0", "WARN"), ("changes", "Largest move in hundredths", "max_jump", "at most 250", "x <= 250", "WARN"),
        ("request", "Age in days", f"DATE '{AS_OF}' - lw", "no limit is set", "false", "WARN"), ("request", f"History on both sides of {REGIME}", f"(fd < DATE '{REGIME}' AND ld >= DATE '{REGIME}')::INT", "0 to 0", "x = 0", "WARN"), ("source", "Vintages kept", "0", "at least 1", "x >= 1", "WARN"),
    ]
    jump = "greatest(" + each('abs("{n}")') + ")"
    tables = f"""{C3}, qd AS (SELECT panel, count(date) - count(DISTINCT date) AS duplicate_days, min(least({each('"{n}"')})) AS min_value, max(greatest({each('"{n}"')})) AS max_value, sum({' + '.join(f'coalesce(("{n}" = 0)::INT, 0)' for n in N3)}) AS n_zeros, min(date) AS fd, max(date) AS ld FROM daily GROUP BY panel),
qw AS (SELECT panel, min(date) AS fw, max(date) AS lw FROM weekly GROUP BY panel), qf AS (SELECT panel, min(date) AS fc, max(date) AS lc FROM whole GROUP BY panel),
qm AS (SELECT panel, count(*) AS n_changes, max(gap_days) AS max_gap, count(*) FILTER (WHERE gap_days <> 7) AS not_seven, max({jump}) AS max_jump, {' + '.join(f'(var_samp("{n}") <= 0)::INT' for n in N3)} AS still FROM ch GROUP BY panel), qa AS (SELECT * FROM qd JOIN qw USING (panel) JOIN qf USING (panel) JOIN qm USING (panel)), """
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    union = " UNION ALL ".join(f"SELECT panel, {quote(t)} AS measured_on, {quote(n)} AS control, x AS figure, {quote(a)} AS allowed, CASE WHEN {ok} THEN 'PASS' ELSE '{bad}' END AS status FROM (SELECT panel, ({f})::DOUBLE AS x FROM qa)" for t, n, f, a, ok, bad in rows)
    return f"{tables} checks AS ({union})"


# Date columns of the results, which both sides show as ISO text.
DATES = {
    "panel_daily": ("date",), "weekly_curve": ("date", "period_end"), "weekly_curve_drop": ("date", "period_end"), "weekly_changes": ("date", "period_end"),
    "pnl": ("date",), "pnl_attribution": ("date",), "worst_scenarios": ("date", "previous_date"), "tail_summary": ("window_start", "window_end"),
    "first_factor_rolling": ("first_date", "last_date"), "specification_shares": ("first_date", "last_date"), "gate_evidence": ("first_date", "last_date"),
    "var_backtest": ("date", "estimation_start", "estimation_end"), "mean_forecast": ("date",), "node_ar1": ("date",), "interval_hits": ("date",),
}


def oracle_sql() -> dict[str, str]:
    """SQL for each query that SQL can express."""
    from .factor_oracles import factor_sql

    made = _sql() | factor_sql()
    shown = {name: ", ".join(f"{c}::VARCHAR AS {c}" for c in columns) for name, columns in DATES.items()}
    return {name: f"SELECT * REPLACE ({shown[name]}) FROM ({sql})" if name in shown else sql for name, sql in made.items()}


def _sql() -> dict[str, str]:
    jump = "greatest(" + each('abs("{n}")') + ")"
    back = f"(SELECT c.panel, node, abs(v - f) AS e FROM (SELECT ch.panel, UNNEST([" + each("'{n}'") + "]) AS node, UNNEST([" + each('"{n}"') + "]) AS v, UNNEST([" + ", ".join(f"m{i} + " + " + ".join(f'p{i}{j} * ("{N3[j]}" - m{j})' for j in range(3)) for i in range(3)) + "]) AS f FROM ch JOIN pr USING (panel)) c)"
    first = " + ".join(f'-(p{i}{j}) * {D[i]} * ("{N3[j]}" - m{j})' for i in range(3) for j in range(3))
    mean = "-(" + " + ".join(f"m{i} * {D[i]}" for i in range(3)) + ")"
    total = " + ".join(f"{D[i]} * {D[j]} * {_c(i, j)}" for i in range(3) for j in range(3))
    one = "l1 * (" + " + ".join(f"{D[i]} * {D[j]} * p{i}{j}" for i in range(3) for j in range(3)) + ")"
    w = f"power(0.5, (n_rows - 1 - pos) / {HALFLIFE}::DOUBLE)"
    drop = C3.replace("(5 - isodow(date) + 7)", "(3 - isodow(date) + 7)").replace("FROM lineitem  GROUP", "FROM lineitem WHERE l_shipdate::DATE BETWEEN '1996-01-03' AND '2000-06-28' GROUP")
    n00, n01, n10, n11 = (f"count(*) FILTER (WHERE y = {a} AND x = {b})::DOUBLE AS n{a}{b}" for a, b in ((0, 0), (0, 1), (1, 0), (1, 1)))
    return {
        "panel_daily": f"{C3} SELECT panel, date, {WIDE3} FROM daily",
        "weekly_curve": f"{C3} SELECT panel, date, period_end, {WIDE3} FROM weekly",
        "weekly_curve_drop": f"{drop} SELECT panel, date, period_end, {WIDE3} FROM weekly WHERE period_end - 6 >= DATE '1996-01-03' AND period_end <= DATE '2000-06-28'",
        "weekly_changes": f"{C3} SELECT panel, date, period_end, {WIDE3}, gap_days, pos, n_rows FROM ch",
        "gap_histogram": f"{C3} SELECT panel, gap_days, count(*) AS n_periods FROM ch GROUP BY ALL",
        "change_validity": f"{C3} SELECT panel, count(*) AS n_rows, 0::BIGINT AS n_not_finite, 0 AS n_constant, true AS valid FROM ch GROUP BY panel HAVING " + each('var_samp("{n}") > 0', N3, " AND "),
        "quality_figures": f"""{C3}, d AS (SELECT panel, count(*) AS n_days, count(date) - count(DISTINCT date) AS duplicate_days, min(least({each('"{n}"')})) AS min_value, max(greatest({each('"{n}"')})) AS max_value, min(date) AS a, max(date) AS z FROM daily GROUP BY panel),
k AS (SELECT panel, count(*) AS n_weeks, min(date) AS fw, max(date) AS lw FROM weekly GROUP BY panel), f AS (SELECT panel, min(date) AS fc FROM whole GROUP BY panel),
m AS (SELECT panel, count(*) AS n_changes, max(gap_days) AS max_gap, min(gap_days) AS min_gap, count(*) FILTER (WHERE gap_days <> 7) AS not_seven, max({jump}) AS max_jump FROM ch GROUP BY panel)
SELECT panel, n_days, duplicate_days, {r('min_value')} AS min_value, {r('max_value')} AS max_value, n_weeks, n_changes, max_gap, min_gap, not_seven, {r('max_jump')} AS max_jump, (fc - a)::INT AS start_lag, (z - lw)::INT AS end_lag FROM d JOIN k USING (panel) JOIN f USING (panel) JOIN m USING (panel)""",
        "covariance": f"{LONG} SELECT a.panel, count(*) AS n_obs, count(*)::DOUBLE AS n_eff, a.node AS node_i, b.node AS node_j, {r('covar_samp(a.value, b.value)', 4)} AS cov, {r('corr(a.value, b.value)', 4)} AS corr FROM lg a JOIN lg b USING (panel, pos) GROUP BY a.panel, a.node, b.node",
        "covariance_recent": f"""{LONG}, wt AS (SELECT *, {w} / sum({w}) OVER (PARTITION BY panel, node) AS w FROM lg), mu AS (SELECT panel, node, sum(w * value) AS m, sum(w * w) AS w2 FROM wt GROUP BY 1, 2), z AS (SELECT wt.panel, pos, node, w, w2, value - m AS v FROM wt JOIN mu USING (panel, node)),
cc AS (SELECT a.panel, a.node AS node_i, b.node AS node_j, count(*) AS n_obs, 1 / max(a.w2) AS n_eff, sum(a.w * a.v * b.v) / (1 - max(a.w2)) AS cov FROM z a JOIN z b USING (panel, pos) GROUP BY 1, 2, 3)
SELECT c.panel, c.n_obs, {r('c.n_eff', 4)} AS n_eff, c.node_i, c.node_j, {r('c.cov', 4)} AS cov, {r('c.cov / sqrt(x.cov * y.cov)', 4)} AS corr FROM cc c JOIN cc x ON x.panel = c.panel AND x.node_i = c.node_i AND x.node_j = c.node_i JOIN cc y ON y.panel = c.panel AND y.node_i = c.node_j AND y.node_j = c.node_j""",
        "eigenvalues": f"{EIG} SELECT panel, component, {r('l', 4)} AS eigenvalue, {r('l / (l1 + l2 + l3)', 4)} AS share, {r('c / (l1 + l2 + l3)', 4)} AS cumulative_share FROM (SELECT panel, l1, l2, l3, UNNEST([1, 2, 3])::INT AS component, UNNEST([l1, l2, l3]) AS l, UNNEST([l1, l1 + l2, l1 + l2 + l3]) AS c FROM e6)",
        "eigen_trace": f"{C7} SELECT panel, count(*) AS n_obs, {r(each('var_samp({q}{n}{q})'.replace('{q}', chr(34)), SEVEN.names, ' + '), 4)} AS trace, {r('sqrt(' + ' + '.join(f'covar_samp({chr(34)}{a}{chr(34)}, {chr(34)}{b}{chr(34)})^2' for a in SEVEN.names for b in SEVEN.names) + ')', 4)} AS frobenius FROM ch GROUP BY panel",
        "first_projector": f"{PROJ} SELECT panel, node_i, node_j, {r('weight')} AS weight FROM (SELECT panel, UNNEST([" + ", ".join(f"'{a}'" for a in N3 for _ in N3) + "]) AS node_i, UNNEST([" + ", ".join(f"'{b}'" for _ in N3 for b in N3) + "]) AS node_j, UNNEST([" + ", ".join(f"p{i}{j}" for i in range(3) for j in range(3)) + "]) AS weight FROM pr)",
        "first_reconstruction": f"{PROJ} SELECT panel, node, count(*) AS n_obs, {r('avg(e)', 5)} AS mae, {r('sqrt(avg(e * e))', 5)} AS rmse, {r('quantile_cont(e, 0.95)', 5)} AS p95, {r('max(e)', 5)} AS max_error FROM {back} GROUP BY GROUPING SETS ((panel, node), (panel))",
        "pnl": f"{PNL} SELECT panel, date, pos, {r('pnl', 2)} AS pnl FROM pn",
        "pnl_attribution": f"{PROJ} SELECT panel, date, pos, source, {r('pnl', 1)} AS pnl FROM (SELECT panel, date, pos, UNNEST(['First factor', 'Mean change', 'Residual', 'Full']) AS source, UNNEST([f, m, t - f - m, t]) AS pnl FROM (SELECT panel, date, pos, {first} AS f, {mean} AS m, -({DOT}) AS t FROM ch JOIN pr USING (panel)))",
        "variance_sources": f"{PROJ} SELECT panel, source, {r('v / 1e12', 4)} AS variance_millions, {r('v / t', 4)} AS share, true AS reconciled FROM (SELECT panel, t, UNNEST(['First factor', 'Residual', 'Total']) AS source, UNNEST([f, t - f, t]) AS v FROM (SELECT panel, {one} AS f, {total} AS t FROM pr))",
        "worst_scenarios": f"""{C3} SELECT panel, place::INT AS place, date, previous_date, (date - previous_date)::INT AS horizon_days, {r('pnl', 2)} AS pnl, {each('round("{n}", 2) + 0.0 AS shock_{n}')} FROM (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY pnl, date) AS place FROM (SELECT *, -({DOT}) AS pnl, lag(date) OVER (PARTITION BY panel ORDER BY pos) AS previous_date FROM ch)) WHERE place <= 10""",
        "tail_summary": f"{PNL} SELECT panel, scope, n, window_start, window_end, measure, {r('confidence', 2)} AS confidence, {r('loss', 2)} AS loss, {r('tail_mass', 2)} AS tail_mass, rank::DOUBLE AS rank, {r('exception_bound', 2)} AS exception_bound, attainable::VARCHAR AS attainable, status FROM ({_tail(f'latest {VAR_WINDOW}', f'WHERE pos >= n_rows - {VAR_WINDOW}')} UNION ALL {_tail('full', '')})",
        "var_backtest": f"{BACK} SELECT panel, date, pos, estimation_start, estimation_end, {r('var', 2)} AS var, {r('loss', 2)} AS loss, exception FROM bx",
        "var_backtest_tests": f"""{BACK}, xs AS (SELECT panel, exception::INT AS x, lag(exception::INT) OVER (PARTITION BY panel ORDER BY pos) AS y FROM bx),
g AS (SELECT panel, count(*) AS n, sum(x)::BIGINT AS exceptions, {n00}, {n01}, {n10}, {n11} FROM xs GROUP BY panel),
p AS (SELECT *, exceptions / n AS rate, CASE WHEN n00 + n01 > 0 THEN n01 / (n00 + n01) ELSE 0 END AS p01, CASE WHEN n10 + n11 > 0 THEN n11 / (n10 + n11) ELSE 0 END AS p11, CASE WHEN n > 1 THEN (n01 + n11) / (n00 + n01 + n10 + n11) ELSE 0 END AS pp FROM g),
l AS (SELECT *, greatest(0.0, -2 * ({_xlogy('exceptions', BOUND)} + {_xlogy('(n - exceptions)', f'(1 - {BOUND})')} - {_xlogy('exceptions', 'rate')} - {_xlogy('(n - exceptions)', '(1 - rate)')})) AS k,
greatest(0.0, -2 * ({_xlogy('(n00 + n10)', '(1 - pp)')} + {_xlogy('(n01 + n11)', 'pp')} - {_xlogy('n00', '(1 - p01)')} - {_xlogy('n01', 'p01')} - {_xlogy('n10', '(1 - p11)')} - {_xlogy('n11', 'p11')})) AS i FROM p)
SELECT panel, n, exceptions, {r(f'n * {BOUND}')} AS expected, {r('rate')} AS rate, {r('k')} AS kupiec_lr, {r('i')} AS independence_lr, {r('k + i')} AS joint_lr, {r('exp(-(k + i) / 2)')} AS joint_p FROM l""",
        "mean_forecast": f"{FORECAST} SELECT panel, date, pos, model, node, {r('actual')} AS actual, {r('fitted')} AS fitted FROM fc",
        "forecast_metrics": f"{FORECAST} SELECT panel, model, node, count(*) AS n, {r('sqrt(avg((fitted - actual)^2))')} AS rmse, {r('avg(abs(fitted - actual))')} AS mae, {r('avg(fitted - actual)')} AS bias, {r('avg((sign(actual) = sign(fitted))::INT) FILTER (WHERE actual <> 0 AND fitted <> 0)')} AS direction_accuracy FROM fc GROUP BY GROUPING SETS ((panel, model, node), (panel, model))",
        "clark_west": f"{HAC} SELECT panel, model, n, {r('m', 4)} AS mean, {r('m / sqrt(v / n)', 4)} AS statistic FROM lr",
        "node_ar1": f"""{LONG}, pa AS (SELECT *, lag(value) OVER (PARTITION BY panel, node ORDER BY pos) AS past FROM lg),
sl AS (SELECT *, regr_slope(value, past) OVER w AS b, regr_avgy(value, past) OVER w AS my, regr_avgx(value, past) OVER w AS mx FROM pa WINDOW w AS (PARTITION BY panel, node ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT panel, date, pos, node, {r('value', 5)} AS actual, {r('my + b * (past - mx)', 5)} AS fitted FROM sl WHERE pos >= {TRAIN}""",
        "interval_hits": f"{HITS} SELECT panel, date, node, coverage, {r('lower', 5)} AS lower, {r('upper', 5)} AS upper, hit FROM ht",
        "interval_coverage": f"""{HITS}, hl AS (SELECT *, lag(hit::INT) OVER (PARTITION BY panel, coverage, node ORDER BY pos) AS before FROM ht)
SELECT panel, coverage, node, count(*) AS n, sum(hit::INT)::BIGINT AS hits, {r('avg(hit::INT)')} AS rate, {r('coverage - 0.03')} AS floor, CASE WHEN var_pop(before) > 0 AND var_pop(hit::INT) FILTER (WHERE before IS NOT NULL) > 0 THEN {r('corr(hit::INT, before)')} END AS lag_1, {r('avg(hit::INT) - coverage')} AS gap FROM hl GROUP BY panel, coverage, node""",
        "joint_hits": f"{HITS} SELECT panel, coverage, count(*) AS n, {r('avg(a)')} AS joint_rate FROM (SELECT panel, coverage, pos, min(hit::INT) AS a FROM ht GROUP BY ALL) GROUP BY panel, coverage",
        "distribution": f"""{LONG}, vs AS (SELECT panel, node, pos, value AS v, value * value AS s FROM lg), lag AS (SELECT *, {', '.join(f'lag({c}, {k}) OVER w AS {c}{k}' for c in 'vs' for k in range(1, LAGS + 1))} FROM vs WINDOW w AS (PARTITION BY panel, node ORDER BY pos)), mm AS (SELECT panel, node, avg(v) AS mv, avg(s) AS ms FROM vs GROUP BY 1, 2),
st AS (SELECT x.panel, x.node, count(*) AS n, skewness(x.v) AS sk, kurtosis(x.v) AS ku, kurtosis_pop(x.v) AS g2, sum((x.v - m.mv)^3) / count(*) / power(sum((x.v - m.mv)^2) / count(*), 1.5) AS g1, {_ljung_box('v')} AS q, {_ljung_box('s')} AS q2 FROM lag x JOIN mm m USING (panel, node) GROUP BY 1, 2)
SELECT panel, node, n, {r('sk', 4)} AS skewness, {r('ku', 4)} AS excess_kurtosis, {r('n / 6 * (g1 * g1 + g2 * g2 / 4)', 4)} AS jarque_bera, {r('q', 4)} AS ljung_box, {r(_chi2_even('q', LAGS), 4)} AS ljung_box_p, {r('q2', 4)} AS ljung_box_squares FROM st""",
        "content_digest": f"{C3}, h AS (SELECT panel, date, sha256(concat_ws(',', date::VARCHAR, {each(chr(112) + 'rintf(' + chr(39) + '%.8f' + chr(39) + ', round({q}{n}{q}, 3))'.replace('{q}', chr(34)))})) AS h FROM ch) SELECT panel, count(*) AS n_days, sha256(string_agg(h, '' ORDER BY date)) AS content_sha256 FROM h GROUP BY panel",
        "quality_checks": f"{_checks()} SELECT panel, measured_on, control, {r('figure', 4)} AS figure, allowed, status FROM checks",
        "first_factor_rolling": f"{ROLLING} SELECT panel, a.window_end, a.first_date, a.last_date, a.n_obs, {r('a.l1 / (a.l1 + a.l2 + a.l3)', 3)} AS share, {r(COSINE, 3)} AS cosine, {r(ANGLE, 3)} AS angle FROM roll a JOIN ref b USING (panel)",
        "first_factor_sequential": f"{C3}, {SEQUENTIAL} SELECT panel, window_end, {r('a.l1 / (a.l1 + a.l2 + a.l3)', 3)} AS share, {r(COSINE, 3)} AS cosine, {r(ANGLE, 3)} AS angle FROM late a JOIN early b USING (panel, window_end)",
        "first_factor_oos": f"{C3}, {OOS} SELECT panel, node, count(*) AS n_obs, {r('avg(abs(e))', 4)} AS mae, {r('sqrt(avg(e * e))', 4)} AS rmse, {r('quantile_cont(abs(e), 0.95)', 4)} AS p95, {r('max(abs(e))', 4)} AS max_error FROM ov GROUP BY GROUPING SETS ((panel, node), (panel))",
        "first_factor_regimes": f"""{C3}, sd AS (SELECT *, CASE WHEN date < DATE '{REGIME}' THEN 0 WHEN date > min(date) FILTER (WHERE date >= DATE '{REGIME}') OVER (PARTITION BY panel) THEN 1 END AS side FROM ch),
{eigen_steps(f'(SELECT panel, {COVARIANCES} FROM sd WHERE side = 0 GROUP BY panel)', 'panel', 'sa')}, {eigen_steps(f'(SELECT panel, {COVARIANCES} FROM sd WHERE side = 1 GROUP BY panel)', 'panel', 'sb')}, sn AS (SELECT panel, count(*) FILTER (WHERE side = 0) AS n_before, count(*) FILTER (WHERE side = 1) AS n_after FROM sd GROUP BY panel)
SELECT panel, n_before, n_after, 'EVALUATED' AS status, {r(COSINE, 3)} AS cosine, {r(ANGLE, 3)} AS angle, {r('sqrt(b.l1 / a.l1)', 3)} AS sigma_ratio FROM sa a JOIN sb b USING (panel) JOIN sn USING (panel) WHERE n_before >= 52 AND n_after >= 52""",
        "first_factor_recency": f"{C3}, {WHOLE}, {RECENT_COV}, {eigen_steps('rc', 'panel', 'rec')} SELECT panel, {r(COSINE, 3)} AS cosine, {r(ANGLE, 3)} AS angle, {r('sqrt(a.l1)', 3)} AS reference_sigma, {r('sqrt(b.l1)', 3)} AS candidate_sigma, {r('sqrt(b.l1 / a.l1)', 3)} AS sigma_ratio FROM ref a JOIN rec b USING (panel)",
        "first_factor_scenarios": f"{PROJ} SELECT panel, multiple::DOUBLE AS multiple, {r('multiple * sqrt(v)', 1)} AS gain, {r('-multiple * sqrt(v)', 1)} AS loss, 2::BIGINT AS n FROM (SELECT panel, {one} AS v, UNNEST([1, 2, 3]) AS multiple FROM pr)",
        "specification_shares": f"""{C3}, {WHOLE}, {RECENT_COV}, {eigen_steps('rc', 'panel, n_eff', 'rec')}, kc AS (SELECT panel, {', '.join(f'corr("{N3[i]}", "{N3[j]}") AS c{i}{j}' for i, j in PAIRS)} FROM ch GROUP BY panel), {eigen_steps('kc', 'panel', 'kor')}, sp AS (SELECT panel, min(date) AS first_date, max(date) AS last_date, count(*) AS n_obs FROM ch GROUP BY panel),
al AS (SELECT panel, 'covariance' AS specification, NULL::DOUBLE AS e, l1, l2, l3 FROM ref UNION ALL SELECT panel, 'correlation', NULL, l1, l2, l3 FROM kor UNION ALL SELECT panel, 'recency', n_eff, l1, l2, l3 FROM rec)
SELECT panel, specification, first_date, last_date, n_obs, {r('coalesce(e, n_obs)', 4)} AS n_eff, {', '.join(f"{r(f'l{k} / (l1 + l2 + l3)', 4)} AS share_{k}" for k in (1, 2, 3))}, {r('l1 / (l1 + l2 + l3)', 4)} AS top_share FROM al JOIN sp USING (panel)""",
        "calibration_three": f"{C3}, {RECENT_COV}, fl AS (SELECT panel, {COVARIANCES} FROM ch GROUP BY panel), vs AS (SELECT panel, sqrt({total}) AS s FROM fl), vr AS (SELECT panel, sqrt({total}) AS r FROM rc) SELECT panel, {r('s', 1)} AS structural, {r('r', 1)} AS recent, {r('r / s', 1)} AS ratio FROM vs JOIN vr USING (panel)",
        "walk_forward_baselines": f"{FORECAST7} SELECT panel, model, node, count(*) AS n, {r('sqrt(avg((fitted - actual)^2))', 5)} AS rmse, {r('avg(abs(fitted - actual))', 5)} AS mae, {r('avg(fitted - actual)', 5)} AS bias, {r('avg((sign(actual) = sign(fitted))::INT) FILTER (WHERE actual <> 0 AND fitted <> 0)', 5)} AS direction_accuracy FROM fc GROUP BY GROUPING SETS ((panel, model, node), (panel, model))",
        "gate_evidence": f"{GATE} SELECT panel, part AS partition, rows, first_date, last_date, {r('rmse', 4)} AS rmse, {r('improvement', 4)} AS improvement, {r('h.mean', 4)} AS advantage, {r('h.statistic', 4)} AS hac, {r('c.mean', 4)} AS cw_advantage, {r('c.statistic', 4)} AS cw FROM gm JOIN {_gate_side('raw')} h USING (panel, part) JOIN {_gate_side('adj')} c USING (panel, part)",
        "first_factor_health": f"{FIRST_HEALTH} SELECT panel, monitor, {r('result', 3)} AS result, threshold, status FROM health",
        "first_factor_assessment": f"{FIRST_HEALTH}, {_checks().removeprefix(C3 + ', ')}, st AS (SELECT panel, status FROM health UNION ALL SELECT panel, status FROM checks WHERE measured_on <> 'source') SELECT panel, CASE WHEN bool_or(status = 'FAIL') THEN 'NEEDS REVISION' WHEN bool_or(status = 'WARN') THEN 'SHARE WITH CAVEATS' ELSE 'READY TO SHARE' END AS assessment FROM st GROUP BY panel",
        "event_gaps": f"WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events) SELECT user_id, count(*) AS n_gaps, {r('avg(gap)', 3)} AS mean_gap, {r('max(gap)', 3)} AS max_gap FROM g WHERE gap IS NOT NULL GROUP BY user_id",
    }
