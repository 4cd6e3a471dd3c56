"""Correlations, group comparisons, subgroup reversals and missingness, as aggregates with closed forms."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import numeric_columns
from ..functions.ranks import quantiles, running
from ..functions.statistics import chi2_upper, normal_two_sided
from ..limits import LIMITS, Refusal


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """a, b, r and n of every pair, pairwise complete, in one aggregate."""
    columns = columns or numeric_columns(df)
    pairs = list(combinations(columns, 2))
    whole = lambda a, b: F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull())
    wide = df.agg(*[x for k, (a, b) in enumerate(pairs) for x in (F.corr(a, b).alias(f"r{k}"), whole(a, b).alias(f"n{k}"))])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r"), F.col(f"n{k}").alias("n")) for k, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def mid_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with average ranks of ``column``. Ranks are taken over distinct values with their counts, and no task orders them all."""
    counts = df.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    ranks = running(counts, "_v", ["_c"]).select("_v", (F.col("_c_before") + (F.col("_c") + 1) / 2.0).cast("double").alias(name))
    return df.join(ranks, df[column] == ranks["_v"]).drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """r and n from mid-ranks of the rows that have both."""
    both = df.select(a, b).dropna()
    ranked = mid_ranks(mid_ranks(both, a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("r"), F.count("*").alias("n"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame | Refusal:
    """tau-b from distinct value pairs with counts. Pairs of cells are compared, so columns of too many cells are refused."""
    n = df.select(a, b).dropna().distinct().count()
    if n > LIMITS.kendall_cells:
        return Refusal(f"{n} different pairs of {a} and {b}: over {LIMITS.kendall_cells}")
    cells = df.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna().groupBy("x", "y").agg(F.count("*").cast("double").alias("c"))
    p, q = cells.alias("p"), cells.alias("q")
    sign = F.signum(F.col("p.x") - F.col("q.x")) * F.signum(F.col("p.y") - F.col("q.y"))
    score = p.join(q, F.col("p.x") < F.col("q.x")).agg(F.sum(F.col("p.c") * F.col("q.c") * sign).alias("s"))
    ties = lambda c: cells.groupBy(c).agg(F.sum("c").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"t{c}"), F.sum("t").alias("n"))
    one = score.crossJoin(ties("x")).crossJoin(ties("y").drop("n"))  # one row each
    total = F.col("n") * (F.col("n") - 1) / 2
    return one.select((F.col("s") / F.sqrt((total - F.col("tx")) * (total - F.col("ty")))).alias("tau"), F.col("n").cast("long").alias("n"))


def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    """n, mean and sample variance of each group."""
    return df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("label")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def welch(df: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """Welch's t, its degrees of freedom and Cohen's d (pooled) of two groups."""
    g = group_moments(df.filter(F.col(group).isin(first, second)), value, group)
    at = lambda c, label: F.max(F.when(F.col("label") == label, F.col(c)))
    one = g.agg(*[at(c, label).alias(f"{c}{k}") for k, label in ((1, first), (2, second)) for c in ("n", "mean", "var")])
    s1, s2 = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    dof = (s1 + s2) ** 2 / (s1**2 / (F.col("n1") - 1) + s2**2 / (F.col("n2") - 1))
    pooled = ((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / (F.col("n1") + F.col("n2") - 2)
    return one.select(((F.col("mean1") - F.col("mean2")) / F.sqrt(s1 + s2)).alias("t"), dof.alias("dof"), ((F.col("mean1") - F.col("mean2")) / F.sqrt(pooled)).alias("d"))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """F, its degrees of freedom and eta squared over groups of at least two rows."""
    g = group_moments(df, value, group).filter("n >= 2")
    one = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sum((F.col("n") - 1) * F.col("var")).alias("within"), F.sum(F.col("n") * F.col("mean") ** 2).alias("sq"))
    between = F.col("sq") - F.col("n") * F.col("grand") ** 2
    return one.withColumn("between", between).select(
        ((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"), (F.col("k") - 1).alias("dof_between"), (F.col("n") - F.col("k")).alias("dof_within"),
        (F.col("between") / (F.col("between") + F.col("within"))).alias("eta_squared"),
    )


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """Tie-corrected H over groups of at least two rows: groups, n, h."""
    rows = df.select(F.col(value).alias("v"), F.col(group).alias("g")).dropna()
    big = rows.groupBy("g").agg(F.count("*").alias("c")).filter("c >= 2").select("g")
    rows = rows.join(big, "g", "left_semi")
    sums = mid_ranks(rows, "v", "rank").groupBy("g").agg(F.sum("rank").alias("s"), F.count("*").alias("c"))
    one = sums.agg(F.count("*").alias("groups"), F.sum("c").alias("n"), F.sum(F.col("s") ** 2 / F.col("c")).alias("q"))
    ties = rows.groupBy("v").agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n**3 - n))
    return one.crossJoin(ties).select("groups", "n", h.alias("h"))  # one row each


def mann_whitney(df: DataFrame, value: str, flag: Column) -> DataFrame:
    """U of the flagged rows against the others, and its tie-corrected normal score: n1, n2, u, z."""
    rows = df.select(F.col(value).alias("v"), flag.alias("f")).dropna()
    sums = mid_ranks(rows, "v", "rank").agg(F.count_if("f").alias("n1"), F.count_if(~F.col("f")).alias("n2"), F.sum(F.when(F.col("f"), F.col("rank"))).alias("r1"))
    ties = rows.groupBy("v").agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    one = sums.crossJoin(ties).withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)  # one row each
    return one.select("n1", "n2", "u", ((F.col("u") - n1 * n2 / 2) / spread).alias("z"))


def chi2_independence(df: DataFrame, a: Column, b: Column, yates: bool = False) -> DataFrame | Refusal:
    """Chi-square statistic of a crosstab and its degrees of freedom."""
    cells = df.select(a.alias("a"), b.alias("b")).dropna().groupBy("a", "b").agg(F.count("*").cast("double").alias("o"))
    size = cells.agg(F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b")).first()
    if size["a"] * size["b"] > LIMITS.crosstab_cells:
        return Refusal(f"{size['a']} by {size['b']} levels: over {LIMITS.crosstab_cells} cells")
    ra, rb = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("rb"))
    total = cells.agg(F.sum("o").alias("n"))
    full = ra.crossJoin(rb).join(cells, ["a", "b"], "left").crossJoin(total).withColumn("e", F.col("ra") * F.col("rb") / F.col("n"))  # levels by levels
    gap = F.abs(F.coalesce("o", F.lit(0)) - F.col("e"))
    gap = F.greatest(gap - 0.5, F.lit(0.0)) if yates else gap
    return full.agg(F.sum(gap**2 / F.col("e")).alias("statistic"), ((F.count_distinct("a") - 1) * (F.count_distinct("b") - 1)).alias("dof"))


def subgroup_correlations(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """r of each group that is large enough and varies, and whether its sign is against the overall one."""
    per = df.groupBy(F.col(by).alias("label")).agg(F.corr(x, y).alias("r"), F.count("*").alias("n"), F.count_distinct(x).alias("dx"), F.count_distinct(y).alias("dy"))
    per = per.filter((F.col("n") >= LIMITS.subgroup_min_rows) & (F.col("dx") > 1) & (F.col("dy") > 1)).drop("dx", "dy")
    overall = df.agg(F.corr(x, y).alias("overall"))
    return per.crossJoin(overall).withColumn("reversed", (F.signum("r") != F.signum("overall")) & (F.abs("r") >= 0.05))  # one row


def simpson_rates(df: DataFrame, outcome: Column, contender: str, by: str, first: str, second: str) -> DataFrame:
    """Rates of two contenders inside each group of enough rows, with the overall rates beside them."""
    rows = df.filter(F.col(contender).isin(first, second)).select(outcome.cast("double").alias("y"), F.col(contender).alias("c"), F.col(by).alias("label"))
    rate = lambda k: F.avg(F.when(F.col("c") == k, F.col("y")))
    per = rows.groupBy("label").agg(rate(first).alias("first"), rate(second).alias("second"), F.count("*").alias("n")).filter(F.col("n") >= LIMITS.subgroup_min_rows)
    overall = rows.agg(rate(first).alias("overall_first"), rate(second).alias("overall_second"))
    against = F.signum(F.col("first") - F.col("second")) != F.signum(F.col("overall_first") - F.col("overall_second"))
    return per.crossJoin(overall).withColumn("reversed", against)  # one row


def missing_per_column(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, nulls and their share."""
    columns = columns or df.columns
    wide = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null"), F.try_divide(F.col(c), F.col("n")).alias("share")) for c in columns]
    return wide.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def missing_blocks(df: DataFrame, columns: list[str], least: float = 0.9) -> DataFrame:
    """Pairs of columns that are missing together: correlation of their null indicators."""
    flags = df.select(*[F.col(c).isNull().cast("double").alias(c) for c in columns])
    return correlations(flags, columns).filter(F.col("r") >= least).drop("n")


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, low, high and rows of equal-width bins; the last one holds the maximum."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    spot = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    rows = df.filter(F.col(column).isNotNull()).select(column).crossJoin(ends)  # one row
    out = rows.groupBy(spot.alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    return out.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def box_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """Quartiles and the rows beyond the fences, for each group."""
    q = quantiles(df.withColumn("label", F.col(group)), [value], [0.25, 0.5, 0.75], ["label"])
    q = q.select("label", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = LIMITS.iqr_reach * (F.col("q3") - F.col("q1"))
    out = df.join(q, df[group].eqNullSafe(q["label"])).groupBy("label", "q1", "median", "q3")
    return out.agg(F.count_if((F.col(value) < F.col("q1") - reach) | (F.col(value) > F.col("q3") + reach)).alias("n_outliers"))


#: Level of all tests of one column together, rows a test needs on either side, rows and labels of a crosstab.
DRIVER_ALPHA, DRIVER_ROWS, CROSSTAB_ROWS, DRIVER_LABELS = 0.05, 10, 20, 50


def missing_drivers(df: DataFrame, column: str, candidates: list[str] | None = None) -> DataFrame:
    """What tells whether ``column`` is blank: driver, kind, statistic, p, drives, high, low, label.

    All candidates (every other column that is not a mark of cleaning) are tested in one pass of counts each for numbers and texts: ranks of numbers of blank rows
    against the others (tie-corrected normal score; ``high`` and ``low`` are the medians of blank and other rows), crosstabs of labels with blanks, null a label of its own
    (chi-square, corrected for two by two; ``label`` is blank most often, at rate ``high``, ``low`` is the lowest rate). A column drives at the
    level of 0.05 divided by the number of candidates. Candidates with too few rows, one value or over 50 labels are left out.
    """
    spark = df.sparkSession
    names = [c for c in candidates or df.columns if c != column and not c.endswith(("_was_missing", "_was_capped", "_valid"))]
    kinds = dict.fromkeys(numeric_columns(df), "number")
    flag = F.col(f"`{column}`").isNull()
    alpha, found = DRIVER_ALPHA / max(1, len(names)), []
    numbers, labels = [c for c in names if c in kinds], [c for c in names if c not in kinds]
    if numbers:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in numbers])
        rows = df.select(flag.alias("blank"), F.explode(cells).alias("x")).select("blank", "x.*").filter("v IS NOT NULL")
        counts = rows.groupBy("column", "v").agg(F.count("*").alias("c"), F.count_if("blank").alias("b"))
        ranked = running(counts, "v", ["c"], ["column"])
        sums = ranked.groupBy("column").agg(F.sum("c").alias("n"), F.sum("b").alias("n1"), F.sum(F.col("b") * (F.col("c_before") + (F.col("c") + 1) / 2.0)).alias("r1"), F.sum(F.pow(F.col("c").cast("double"), 3) - F.col("c")).alias("ties"), F.count("*").alias("levels"))
        medians = {(r["column"], r["blank"]): r["q"][0] for r in quantiles(rows.select(F.col("column").alias("of"), "blank", "v"), ["v"], [0.5], ["of", "blank"]).drop("column").withColumnRenamed("of", "column").collect()}  # two a column
        for r in sums.collect():  # a row per column
            n, n1 = float(r["n"]), float(r["n1"])
            n2 = n - n1
            if min(n1, n2) < DRIVER_ROWS or r["levels"] < 2:
                continue
            spread = (n1 * n2 / 12 * (n + 1 - r["ties"] / (n * (n - 1)))) ** 0.5
            # The normal score with the half step towards the middle.
            u = r["r1"] - n1 * (n1 + 1) / 2
            z = (abs(u - n1 * n2 / 2) - 0.5) / spread if spread else 0.0
            p = normal_two_sided(max(z, 0.0))
            found.append((r["column"], "number", z, p, p < alpha, medians[r["column"], True], medians[r["column"], False], None))
    if labels:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("(blank)")).alias("v")) for c in labels])
        counts = df.select(flag.alias("blank"), F.explode(cells).alias("x")).select("blank", "x.*").groupBy("column", "v").agg(F.count("*").cast("double").alias("c"), F.count_if("blank").cast("double").alias("b"))
        totals = counts.groupBy("column").agg(F.sum("c").alias("n"), F.sum("b").alias("nb"), F.count("*").alias("k")).filter(f"k BETWEEN 2 AND {DRIVER_LABELS} AND n >= {CROSSTAB_ROWS} AND nb > 0 AND nb < n")
        both = counts.join(totals, "column")
        step = F.when(F.col("k") == 2, 0.5).otherwise(0.0)  # two by two
        off = lambda o, e: F.pow(F.greatest(F.abs(o - e) - step, F.lit(0.0)), 2) / e
        e1, e2 = F.col("c") * F.col("nb") / F.col("n"), F.col("c") * (F.col("n") - F.col("nb")) / F.col("n")
        rate = F.col("b") / F.col("c")
        per = both.groupBy("column").agg(F.sum(off(F.col("b"), e1) + off(F.col("c") - F.col("b"), e2)).alias("x"), F.max("k").alias("k"), F.max(F.struct(rate.alias("r"), "v")).alias("hi"), F.min(rate).alias("lo"))
        for r in per.collect():  # a row per column
            p = chi2_upper(spark, r["x"], r["k"] - 1)
            found.append((r["column"], "label", r["x"], p, p < alpha, r["hi"]["r"], r["lo"], r["hi"]["v"]))
    found.sort(key=lambda x: (x[3], x[0]))
    return spark.createDataFrame(found, "driver string, kind string, statistic double, p double, drives boolean, high double, low double, label string")


def simpson(df: DataFrame, outcome: str, contender: str, by: list[str]) -> DataFrame | Refusal:
    """Does the level of ``contender`` that is best overall also win inside every group? A row per column of ``by`` and group of enough rows:
    by, label, n, winner, loser, winner_rate, loser_rate, reversed, and the column's verdict: paradox, reverses, holds or unchecked.

    The best and the worst level by the mean of ``outcome`` over complete rows are compared; groups that lack one of them are left out, and fewer
    than two groups check nothing. Over 50 levels are refused.
    """
    out = None
    for column in by:
        rows = df.select(F.col(outcome).cast("double").alias("y"), F.col(contender).cast("string").alias("c"), F.col(column).cast("string").alias("label")).dropna()
        levels = rows.groupBy("c").agg(F.avg("y").alias("m"))
        size = levels.agg(F.count("*").alias("n"), F.max(F.struct("m", "c"))["c"].alias("winner"), F.min(F.struct("m", "c"))["c"].alias("loser")).first()
        if size["n"] > LIMITS.high_cardinality:
            return Refusal(f"{size['n']} levels of {contender}: over {LIMITS.high_cardinality}")
        rate = lambda k: F.avg(F.when(F.col("c") == k, F.col("y")))  # noqa: B023, E731
        per = rows.groupBy("label").agg(F.count("*").alias("n"), rate(size["winner"]).alias("winner_rate"), rate(size["loser"]).alias("loser_rate")).filter(F.col("n") >= LIMITS.subgroup_min_rows).dropna(subset=["winner_rate", "loser_rate"])
        per = per.withColumn("reversed", F.col("loser_rate") > F.col("winner_rate"))
        one = per.agg(F.count("*").alias("groups"), F.count_if("reversed").alias("against"))
        verdict = F.when(F.col("groups") < 2, "unchecked").when(F.col("against") == F.col("groups"), "paradox").when(F.col("against") > 0, "reverses").otherwise("holds")
        part = per.crossJoin(one).select(F.lit(column).alias("by"), "label", "n", F.lit(size["winner"]).alias("winner"), F.lit(size["loser"]).alias("loser"), "winner_rate", "loser_rate", "reversed", verdict.alias("verdict"))  # one row
        out = part if out is None else out.union(part)
    return out
