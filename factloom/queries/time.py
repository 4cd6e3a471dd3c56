"""Calendar periods, durations and date conventions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import time as T
from . import query
from .relational import r

SPAN = {"D": ("day", "INTERVAL 1 DAY", "s", 365), "W": ("week", "INTERVAL 7 DAY", "s + 6", 52), "ME": ("month", "INTERVAL 1 MONTH", "last_day(s)", 12), "QE": ("quarter", "INTERVAL 3 MONTH", "last_day(CAST(s + INTERVAL 2 MONTH AS DATE))", 4), "YE": ("year", "INTERVAL 1 YEAR", "last_day(CAST(s + INTERVAL 11 MONTH AS DATE))", None)}


def _series(freq: str, value: str, table: str = "orders", date: str = "o_orderdate") -> str:
    unit, step, end, year = SPAN[freq]
    yoy = f", round(100 * (value - lag(value, {year}) OVER (ORDER BY s)) / nullif(abs(lag(value, {year}) OVER (ORDER BY s)), 0), 4) AS year_on_year_pct" if year else ""
    return f"""WITH g AS (SELECT CAST(date_trunc('{unit}', {date}) AS DATE) AS s, CAST({value} AS DOUBLE) AS v, CAST(max({date}) AS DATE) AS l FROM {table} GROUP BY 1),
        p AS (SELECT CAST(unnest(generate_series(CAST(min(s) AS TIMESTAMP), CAST(max(s) AS TIMESTAMP), {step})) AS DATE) AS s FROM g), x AS (SELECT p.s, coalesce(v, 0) AS value, (SELECT max(l) FROM g) AS last FROM p LEFT JOIN g ON g.s = p.s)
        SELECT {end} AS period, round(value, 2) AS value, round(100 * (value - lag(value) OVER (ORDER BY s)) / nullif(abs(lag(value) OVER (ORDER BY s)), 0), 4) AS change_pct{yoy}, {end} <= last AS complete FROM x"""


def _run(t, freq, value="o_totalprice", how="sum"):
    out = T.over_time(t("orders"), "o_orderdate", freq, value, how)
    return r(r(out, 2, "value"), 4, *[c for c in ("change_pct", "year_on_year_pct") if c in out.columns])


@query(_series("D", "count(*)"))
def over_time_day(t):
    return _run(t, "D", None)


@query(_series("W", "sum(o_totalprice)"))
def over_time_week(t):
    return _run(t, "W")


@query(_series("ME", "sum(o_totalprice)"))
def over_time_month(t):
    return _run(t, "ME")


@query(_series("QE", "sum(o_totalprice)"))
def over_time_quarter(t):
    return _run(t, "QE")


@query(_series("YE", "sum(o_totalprice)"))
def over_time_year(t):
    return _run(t, "YE")


@query(f"SELECT period, change_pct FROM ({_series('ME', 'count(*)')})")
def over_time_change_pct(t):
    return _run(t, "ME", None).select("period", "change_pct")


@query(f"SELECT period, year_on_year_pct FROM ({_series('QE', 'count(*)')})")
def over_time_yoy(t):
    return _run(t, "QE", None).select("period", "year_on_year_pct")


@query("""WITH s AS (SELECT date_trunc('month', o_orderdate) AS s, avg(o_totalprice) AS v FROM orders GROUP BY 1) SELECT last_day(CAST(s AS DATE)) AS period, round(v, 2) AS value FROM s""")
def over_time_mean(t):
    return _run(t, "ME", how="mean").select("period", "value")


@query("SELECT CAST(max(o_orderdate) AS DATE) AS last_date, last_day(CAST(max(o_orderdate) AS DATE)) AS period_end, CAST(max(o_orderdate) AS DATE) < last_day(CAST(max(o_orderdate) AS DATE)) AS partial FROM orders")
def partial_last_period(t):
    return T.partial_last_period(t("orders"), "o_orderdate")


@query(f"""WITH s AS (SELECT *, lag(value) OVER (ORDER BY period) AS base FROM ({_series('ME', 'sum(o_totalprice)')}) WHERE complete), m AS (SELECT median(value) AS mid FROM s), k AS (SELECT s.* FROM s, m WHERE base >= 0.2 * mid AND change_pct IS NOT NULL)
    SELECT arg_max(period, change_pct) AS rise_period, round(max(change_pct), 3) AS rise_pct, arg_min(period, change_pct) AS fall_period, round(min(change_pct), 3) AS fall_pct FROM k""")
def settled_extremes(t):
    return r(T.settled_extremes(T.over_time(t("orders"), "o_orderdate", "ME", "o_totalprice")), 3, "rise_pct", "fall_pct")


GAPS = "SELECT l_shipmode_label AS label, epoch_us(l_shipdate - o_orderdate) / 1e6 / 86400 AS gap FROM (SELECT *, l_returnflag AS l_shipmode_label FROM lineitem) JOIN orders ON l_orderkey = o_orderkey"
STATS = "count(*) AS n, round(avg(gap), 4) AS mean, round(median(gap), 4) AS median, round(min(gap), 4) AS min, round(max(gap), 4) AS max, count(*) FILTER (gap < 0) AS n_negative"


def _gaps(t):
    return t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))


@query(f"SELECT {STATS} FROM ({GAPS})")
def duration_stats(t):
    return r(T.duration_stats(_gaps(t), "o_orderdate", "l_shipdate"), 4, "mean", "median", "min", "max")


@query(f"SELECT label, {STATS} FROM ({GAPS}) GROUP BY 1")
def duration_by_group(t):
    return r(T.duration_stats(_gaps(t), "o_orderdate", "l_shipdate", by="l_returnflag"), 4, "mean", "median", "min", "max")


@query("""WITH d AS (SELECT strftime(o_orderdate, '%d/%m/%Y') AS d FROM orders), x AS (SELECT CAST(d[1:2] AS INTEGER) AS a, CAST(d[4:5] AS INTEGER) AS b FROM d)
    SELECT count(*) FILTER (a > 12 AND b <= 12) AS day_first, count(*) FILTER (b > 12 AND a <= 12) AS month_first, count(*) FILTER (a <= 12 AND b <= 12) AS ambiguous FROM x""")
def date_convention_proof(t):
    return D.convention_counts(t("orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("d")), "d")


@query("SELECT CAST(0 AS BIGINT) AS n_negative, CAST(0 AS BIGINT) AS n_unread, CAST(3 AS DOUBLE) AS median_gap, false AS start_day_first, true AS end_day_first")
def date_pair_score(t):
    """Of the readings of two date columns, the one with fewest negative gaps, then fewest unread, then least median gap."""
    df = t("orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("s"), F.date_format(F.date_add("o_orderdate", 3), "dd-MM-yyyy").alias("e"))
    tries = [(a, b) for a in (False, True) for b in (False, True)]
    read = df.select(*[D.parse_date(F.col(c), first).alias(f"{c}{int(first)}") for c in ("s", "e") for first in (False, True)])  # each reading once a row
    gaps = read.select(*[T.duration(F.col(f"s{int(a)}"), F.col(f"e{int(b)}")).alias(f"gap{k}") for k, (a, b) in enumerate(tries)])
    scored = []
    for k in range(len(tries)):
        gap = F.col(f"gap{k}")
        scored += [F.count_if(gap < 0).alias(f"neg{k}"), F.count_if(gap.isNull()).alias(f"bad{k}"), F.percentile(F.abs(gap), 0.5).alias(f"mid{k}")]
    wide = gaps.agg(*scored)  # all four readings in one pass
    cells = [F.struct(F.col(f"neg{k}").alias("n_negative"), F.col(f"bad{k}").alias("n_unread"), F.col(f"mid{k}").alias("median_gap"), F.lit(a).alias("start_day_first"), F.lit(b).alias("end_day_first")) for k, (a, b) in enumerate(tries)]
    return wide.select(F.array_min(F.array(*cells)).alias("x")).select("x.*")
