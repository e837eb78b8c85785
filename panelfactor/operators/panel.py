"""From raw observations to weekly curves and their changes, as plain DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DATE, GAP, PANEL, PERIOD_END, POS, col

WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
MISSING_TOKENS = ("", ".")


def daily_nodes(observations: DataFrame, panel, date, node, value, nodes) -> DataFrame:
    """Wide daily panel: mean ``value`` of each (panel, date, node); nodes without observations are null.

    One aggregation with map-side partial sums; the node list is given, so no job looks for it.
    """
    long = observations.select(panel.cast("string").alias(PANEL), F.to_date(date).alias(DATE), node.cast("string").alias("node"), value.cast("double").alias("value"))
    means = [F.avg(F.when(F.col("node") == n, F.col("value"))).alias(n) for n in nodes]
    return long.where(F.col("node").isin(list(nodes))).groupBy(PANEL, DATE).agg(*means)


def parse_panel(raw: DataFrame, nodes, start: str, end: str, panel: str = "curve") -> tuple[DataFrame, DataFrame]:
    """(typed daily panel, defects) of an all-string wide table.

    The date column is observation_date, DATE or Date; source ids are renamed only if all are there, and
    may not be mixed with node names. Null, empty and ``.`` are missing; other tokens that are no
    numbers, repeated dates and dates that don't parse are defects (kind, detail), and are for the caller
    to refuse with :func:`refuse_defects`. Rows outside [start, end] are dropped, extra columns too.
    """
    found = [c for c in ("observation_date", "DATE", "Date") if c in raw.columns]
    if len(found) != 1 or len(set(raw.columns)) != len(raw.columns):
        raise ValueError("exactly one date column and no repeated columns are needed")
    ids, names = set(nodes.series_ids), set(nodes.names)
    has_ids, has_names = ids & set(raw.columns), names & set(raw.columns)
    if has_ids and has_names:
        raise ValueError("source ids and node names are mixed")
    wanted = nodes.series_ids if ids and ids <= set(raw.columns) else nodes.names
    if absent := [c for c in wanted if c not in raw.columns]:
        raise ValueError(f"required columns are absent: {absent}")
    text = raw.select(F.trim(col(found[0])).alias("text_date"), *(F.trim(col(c)).alias(n) for c, n in zip(wanted, nodes.names, strict=True)))
    date = F.expr("try_cast(substring(text_date, 1, 10) AS DATE)")

    def missing(n):
        return col(n).isNull() | col(n).isin(*MISSING_TOKENS)

    numbers = {n: F.expr(f"try_cast(`{n}` AS DOUBLE)") for n in nodes.names}
    bad = F.array_compact(F.array(*(F.when(~missing(n) & (numbers[n].isNull() | F.isnan(numbers[n]) | (F.abs(numbers[n]) == float("inf"))), col(n)) for n in nodes.names)))
    typed = text.select(F.lit(panel).alias(PANEL), date.alias(DATE), *(F.when(~missing(n), numbers[n]).alias(n) for n in nodes.names), bad.alias("bad"), "text_date")
    defects = typed.where(F.col(DATE).isNull()).select(F.lit("date").alias("kind"), F.col("text_date").alias("detail"))
    defects = defects.unionByName(typed.select(F.lit("token").alias("kind"), F.explode("bad").alias("detail")))
    repeated = typed.where(F.col(DATE).isNotNull()).groupBy(DATE).count().where("count > 1")
    defects = defects.unionByName(repeated.select(F.lit("repeated date").alias("kind"), F.col(DATE).cast("string").alias("detail")))
    return typed.where(F.col(DATE).between(start, end)).select(PANEL, DATE, *(col(n) for n in nodes.names)), defects


def refuse_defects(defects: DataFrame) -> None:
    """Raise if there are any, with up to three examples."""
    examples = defects.limit(3).collect()
    if examples:
        raise ValueError("the panel has defects: " + "; ".join(f"{r.kind} {r.detail!r}" for r in examples))


def period_end(date: Column, anchor: str = "FRI") -> Column:
    """Last day of the week, ending on weekday ``anchor``, that ``date`` lies in."""
    if anchor not in WEEKDAYS:
        raise ValueError(f"anchor must be one of {WEEKDAYS}")
    return F.next_day(F.date_sub(date, 1), anchor)


def complete(daily: DataFrame, nodes) -> DataFrame:
    """Days on which every node is there."""
    return daily.dropna(how="any", subset=list(nodes))


def weekly_curve(daily: DataFrame, nodes, anchor: str = "FRI", policy: str = "include_and_flag", start: str | None = None, end: str | None = None) -> DataFrame:
    """Last complete day of each period, with its true date (panel, date, period_end, nodes).

    Completeness comes before sampling: values of different days are never mixed. An aggregation, not a
    window, so each map task sends one row for each period. With policy ``drop`` periods that begin
    before ``start`` or end after ``end`` are left out.
    """
    if policy not in ("drop", "include_and_flag"):
        raise ValueError("policy must be drop or include_and_flag")
    dated = complete(daily, nodes).withColumn(PERIOD_END, period_end(F.col(DATE), anchor))
    last = dated.groupBy(PANEL, PERIOD_END).agg(F.max_by(F.struct(F.col(DATE), *(col(n) for n in nodes)), F.col(DATE)).alias("x"))
    weekly = last.select(PANEL, F.col("x.date").alias(DATE), PERIOD_END, *(F.col(f"x.`{n}`").alias(n) for n in nodes))
    if policy == "drop":
        weekly = weekly.where(F.date_sub(PERIOD_END, 6) >= F.lit(start).cast("date")) if start else weekly
        weekly = weekly.where(F.col(PERIOD_END) <= F.lit(end).cast("date")) if end else weekly
    return weekly


def changes(weekly: DataFrame, nodes, scale: float = 100.0) -> DataFrame:
    """Change of each node since the row before, in basis points, with gap_days, pos and n_rows of the panel.

    The first row of a panel has no change and is left out. One shuffle by panel serves all windows.
    """
    by_date = Window.partitionBy(PANEL).orderBy(DATE)
    moved = weekly.select(
        PANEL, DATE, PERIOD_END,
        *(((col(n) - F.lag(col(n)).over(by_date)) * scale).alias(n) for n in nodes),
        F.datediff(F.col(DATE), F.lag(DATE).over(by_date)).alias(GAP),
        (F.row_number().over(by_date) - 2).cast("long").alias(POS),
        (F.count("*").over(Window.partitionBy(PANEL)) - 1).alias("n_rows"),
    )
    return moved.where(F.col(POS) >= 0)


def gap_histogram(change_rows: DataFrame) -> DataFrame:
    """How often each gap between observations occurs."""
    return change_rows.groupBy(PANEL, GAP).agg(F.count("*").alias("n_periods"))


def long_form(wide: DataFrame, nodes, keep=(PANEL, DATE, POS), value: str = "value") -> DataFrame:
    """One row for each node, with the kept columns."""
    return wide.select(*keep, F.explode(F.array(*(F.struct(F.lit(n).alias("node"), col(n).alias(value)) for n in nodes))).alias("x")).select(*keep, "x.node", f"x.{value}")


def validate_changes(change_rows: DataFrame, nodes, least_rows: int = 3) -> DataFrame:
    """One row for each panel: n_rows, non-finite values, nodes without variance, and whether the panel is fit for a model."""
    bad = sum(F.count_if(col(n).isNull() | F.isnan(col(n)) | (F.abs(col(n)) == float("inf"))) for n in nodes)
    flat = F.array_compact(F.array(*(F.when(F.coalesce(F.var_samp(col(n)), F.lit(0.0)) <= 2.220446049250313e-16, F.lit(n)) for n in nodes)))
    out = change_rows.groupBy(PANEL).agg(F.count("*").alias("n_rows"), bad.alias("n_not_finite"), flat.alias("constant_nodes"))
    return out.withColumn("valid", (F.col("n_rows") >= least_rows) & (F.col("n_not_finite") == 0) & (F.size("constant_nodes") == 0) & F.lit(len(nodes) >= 3))
