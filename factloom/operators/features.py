"""Features and model measures as expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import running, wide_quantiles


def date_parts(df: DataFrame, column: str) -> DataFrame:
    """year, month, day, day of week (Monday 0) and weekend flag of a date column."""
    d = F.col(column)
    return df.withColumns({
        f"{column}_year": F.year(d), f"{column}_month": F.month(d), f"{column}_day": F.dayofmonth(d), f"{column}_dayofweek": F.weekday(d), f"{column}_is_weekend": (F.weekday(d) >= 5).cast("int"),
    })


def one_hot(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """A 0/1 column per level; unknown and null are all zeros."""
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in levels})


def frequency_encode(df: DataFrame, column: str) -> DataFrame:
    """Each value's share of the non-null rows; null gets 0."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    share = counts.crossJoin(df.agg(F.count(column).alias("_all"))).select("_v", (F.col("_c") / F.col("_all")).alias("_f"))  # one row
    return df.join(share, df[column] == share["_v"], "left").withColumn(f"{column}_freq", F.coalesce("_f", F.lit(0.0))).drop("_v", "_f")


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median-filled, then centred and scaled by the population deviation (1 where there is none)."""
    med = wide_quantiles(df, columns, [0.5]).select(*[F.col(f"`{c}`")[0].alias(f"_md_{c}") for c in columns])
    filled = df.crossJoin(med).withColumns({c: F.coalesce(F.col(c), F.col(f"_md_{c}")) for c in columns}).drop(*[f"_md_{c}" for c in columns])  # one row
    stats = filled.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns}
    return filled.crossJoin(stats).withColumns(scaled).drop(*[x for c in columns for x in (f"_m_{c}", f"_s_{c}")])  # one row


def stratified_split(df: DataFrame, label: str, id_col: str, test: float = 0.2) -> DataFrame:
    """``split`` train or test: in each class the share of least hashes is the test part."""
    # Hashes are spread evenly, so their first two digits deal a class to 256 tasks; counts of the digits before give the rest of a rank.
    hashed = df.withColumn("_h", F.md5(F.col(id_col).cast("string"))).withColumn("_d", F.conv(F.left("_h", F.lit(2)), 16, 10).cast("int"))
    counts = hashed.groupBy(F.col(label).alias("_l"), F.col("_d").alias("_e")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy("_l").orderBy("_e")  # 256 rows a class
    counts = counts.withColumns({"_before": F.sum("_c").over(w) - F.col("_c"), "_all": F.sum("_c").over(Window.partitionBy("_l"))})
    nth = F.row_number().over(Window.partitionBy(label, "_d").orderBy("_h", id_col)) + F.col("_before")
    rows = hashed.join(counts, F.col(label).eqNullSafe(F.col("_l")) & F.col("_d").eqNullSafe(F.col("_e")))
    return rows.withColumn("split", F.when(nth <= F.ceil(F.col("_all") * test), "test").otherwise("train")).select(*df.columns, "split")


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """precision, recall, f1 and support per class; zero where undefined."""
    cells = confusion(df, truth, predicted)
    hit = cells.filter("truth = predicted").select(F.col("truth").alias("label"), F.col("n").alias("tp"))
    t, p = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support")), cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("made"))
    out = t.join(p, "label", "full").join(hit, "label", "left").fillna(0)
    precision, recall = F.coalesce(F.try_divide("tp", "made"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    out = out.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.select("label", "precision", "recall", f1.alias("f1"), "support")


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """n, rmse, mae, r2 and the residuals' mean and population deviation."""
    e = F.col(truth) - F.col(predicted)
    one = df.agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(truth).alias("var"), F.avg(e).alias("residual_mean"), F.stddev_pop(e).alias("residual_std"))
    return one.select("n", F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide("mse", "var")).alias("r2"), "residual_mean", "residual_std")


def roc_points(df: DataFrame, label: Column, score: str) -> DataFrame:
    """One point per distinct score, ties together: threshold, tpr, fpr. Only distinct scores are ordered."""
    by = df.groupBy(F.col(score).alias("threshold")).agg(F.count_if(label).alias("p"), F.count_if(~label).alias("n"))
    placed = running(by, "threshold", ["p", "n"])
    share = lambda c: F.try_divide(F.col(f"{c}_all") - F.col(f"{c}_before"), F.col(f"{c}_all"))
    return placed.select("threshold", share("p").alias("tpr"), share("n").alias("fpr"))


def auc(df: DataFrame, label: Column, score: str) -> DataFrame:
    """Area under the curve from mid-ranks of distinct scores with counts."""
    by = df.groupBy(F.col(score).alias("s")).agg(F.count_if(label).alias("p"), F.count_if(~label).alias("n"))
    one = running(by, "s", ["n"]).withColumnRenamed("n_before", "below").agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return one.select(F.try_divide(F.col("u"), F.col("p") * F.col("n")).alias("auc"))


def task_kind(df: DataFrame, target: str) -> DataFrame:
    """regression, binary or multiclass, from the target's values."""
    numeric = not dict(df.dtypes)[target].startswith(("string", "boolean"))
    one = df.agg(F.count_distinct(target).alias("levels"), *([(F.max(target) - F.min(target)).alias("spread"), F.bool_and(F.col(target) == F.floor(target)).alias("whole")] if numeric else []))
    binary = F.when(F.col("levels") == 2, "binary")
    if not numeric:
        return one.select("levels", binary.when(F.col("levels") <= 20, "multiclass").otherwise("unknown").alias("task"))
    return one.select("levels", binary.when((F.col("levels") > 20) | ~F.col("whole") | (F.col("spread") > 20), "regression").otherwise("multiclass").alias("task"))
