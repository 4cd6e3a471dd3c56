"""One table of what stands out in a dataset, and what to do next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates
from ..functions.frames import date_columns, numeric_columns, text_columns
from .cleaning import is_marker
from .profile import cleaning_warnings, coded_column, describe, duplicate_rows, outlier_fences, profile
from .statistics import correlations, missing_blocks, missing_per_column

#: Share of a text column's values that read as dates; empty share that is told; least share of blanks that can form blocks; correlation of blanks in a block; share of
#: rows beyond the fences; mean against median; rows for each; share of the commonest label; labels that can be charted; correlations told; rows they need.
DATE_SHARE, EMPTY, GAPPY, TOGETHER, OUTLYING, LOPSIDED, IMBALANCED, CHARTABLE, STRONG, LEAST_ROWS = 0.8, 0.2, 0.01, 0.9, 0.01, 1.5, 0.9, 50, 0.4, 5
OUTLIER_ROWS, LOPSIDED_ROWS, LIST_ROWS, LIST_SHARE, LIST_WORDS = 8, 20, 10, 0.5, 100


def column_kinds(df: DataFrame) -> dict[str, str]:
    """Each column's kind: marker, constant, number, code, date, id or category; from one pass of counts, one of values of number columns, and one of texts."""
    counts = {r["column"]: r for r in profile(df).collect()}  # a row per column
    numbers = [c for c in numeric_columns(df) if counts[c]["distinct"] > 1 and not is_marker(c)]
    coded: set[str] = set()
    if numbers:
        tests = [coded_column(df, c).select(F.lit(c).alias("column"), "coded") for c in numbers]
        for t in tests[1:]:
            tests[0] = tests[0].union(t)
        coded = {r["column"] for r in tests[0].collect() if r["coded"]}
    words = text_columns(df)
    dated = set(date_columns(df))
    if words:
        reads = lambda c: dates.parse_date(F.col(c), False).isNotNull() | dates.parse_date(F.col(c), True).isNotNull()
        shares = df.agg(*[F.avg(F.when(F.col(c).isNotNull(), F.coalesce(reads(c), F.lit(False)).cast("double"))).alias(c) for c in words]).first()
        dated |= {c for c in words if (shares[c] or 0) >= DATE_SHARE}
    out = {}
    for c, r in counts.items():
        if is_marker(c):
            out[c] = "marker"
        elif r["distinct"] <= 1:
            out[c] = "constant"
        elif c in numbers:
            out[c] = "code" if c in coded else "number"
        else:
            out[c] = "date" if c in dated else "id" if r["distinct"] == r["n_rows"] else "category"
    return out


def blocks_of(pairs: list[tuple[str, str]], columns: list[str]) -> list[list[str]]:
    """Columns in order, each with those it is paired with; a column that stands in a block opens none."""
    near = {c: {b if a == c else a for a, b in pairs if c in (a, b)} for c in columns}
    found, seen = [], set()
    for c in columns:
        if c not in seen and near[c]:
            found.append([c, *[o for o in columns if o in near[c]]])
            seen.update(found[-1])
    return found


def packed_lists(df: DataFrame, columns: list[str]) -> dict[str, tuple[str, int, int]]:
    """Columns that hold lists: separator, combinations and single values. One pass over all of them."""
    seps = F.array(*[F.lit(s) for s in (",", ";", "|")])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    rows = df.select(F.explode(cells).alias("x")).select("x.*").filter("v IS NOT NULL").groupBy("column", "v").agg(F.count("*").alias("c")).select("column", "v", "c", F.explode(seps).alias("sep"))
    parts = F.expr(r"filter(transform(split(v, concat('\\Q', sep, '\\E')), x -> trim(x)), x -> x != '')")
    rows = rows.withColumn("parts", parts).withColumn("holds", F.contains("v", F.col("sep")))
    one = rows.groupBy("column", "sep").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("holds"), F.col("c")).otherwise(0)).alias("held"), F.count_distinct(F.size("parts")).alias("sizes"), F.count("*").alias("combinations"))
    words = rows.select("column", "sep", F.explode("parts").alias("w")).groupBy("column", "sep").agg(F.count_distinct("w").alias("singles"))
    fits = (F.col("n") >= LIST_ROWS) & (F.col("held") >= LIST_SHARE * F.col("n")) & (F.col("singles") <= LIST_WORDS) & ((F.col("sizes") >= 2) | (F.col("combinations") >= 2 * F.col("singles")))
    found = one.join(words, ["column", "sep"]).filter(fits).groupBy("column").agg(F.max(F.struct("held", "sep", "combinations", "singles")).alias("m")).collect()  # a row per column
    return {r["column"]: (r["m"]["sep"], r["m"]["combinations"], r["m"]["singles"]) for r in found}


def analyze_dataset(df: DataFrame, target: str | None = None) -> DataFrame:
    """kind, subject, value and text of everything that stands out, over all rows.

    ``role`` of each column; ``empty`` from a fifth of blanks on; ``block`` of columns that go blank in the same rows (with how many); ``duplicates``; ``imputed`` and
    ``capped`` shares; ``outliers`` from a hundredth of the rows on, else ``lopsided`` where the mean is half again the median; ``list`` columns with their
    single values, else ``imbalance`` (share of the commonest label, with how many rows others have) or ``cardinality``; ``correlation`` with the
    target, or of 0.4 and more; ``from`` and ``until`` of the first date column; and ``next`` steps in order. Markers of cleaning, codes and ids are left out of
    statistics. Statistics collect a row per column or pair of columns.
    """
    spark, kinds = df.sparkSession, column_kinds(df)
    of = lambda *k: [c for c in df.columns if kinds[c] in k]
    numbers, labels, stamps = of("number"), of("category"), of("date")
    out: list[tuple[str, str, float | None, str | None]] = [("role", c, None, k) for c, k in kinds.items()]
    holes = {r["column"]: r["share"] or 0.0 for r in missing_per_column(df).collect()}
    out += [("empty", c, s, None) for c, s in holes.items() if s > EMPTY]
    gappy = [c for c in df.columns if not is_marker(c) and GAPPY <= holes[c] < 1]
    blocks = blocks_of([(r["a"], r["b"]) for r in missing_blocks(df, gappy, TOGETHER).collect()], gappy) if len(gappy) > 1 else []
    if blocks:
        none = lambda block: F.count_if(F.expr(" AND ".join(f"`{c}` IS NULL" for c in block)))
        together = df.agg(*[none(b).alias(str(k)) for k, b in enumerate(blocks)]).first()
        out += [("block", ", ".join(b), float(together[str(k)]), None) for k, b in enumerate(blocks)]
    copies = duplicate_rows(df).first()["n_duplicates"]
    out += [("duplicates", "rows", float(copies), None)] if copies else []
    out += [(r["kind"], r["column"], r["share"], None) for r in cleaning_warnings(df).collect()]
    if numbers:
        n = {r["column"]: r["non_null"] for r in profile(df.select(*numbers)).collect()}
        fences = {r["column"]: r for r in outlier_fences(df, numbers).collect()}
        middle = {r["column"]: r for r in describe(df, numbers).collect()}
        for c in numbers:
            if n[c] >= OUTLIER_ROWS and fences[c]["n_outliers"] >= max(1, OUTLYING * n[c]):
                out.append(("outliers", c, float(fences[c]["n_outliers"]), None))
            elif n[c] > LOPSIDED_ROWS and middle[c]["median"] and middle[c]["mean"] > LOPSIDED * middle[c]["median"]:
                out.append(("lopsided", c, middle[c]["mean"] / middle[c]["median"], None))
    lists = packed_lists(df, labels) if labels else {}
    out += [("list", c, float(single), sep) for c, (sep, _, single) in lists.items()]
    plain, crowded = [c for c in labels if c not in lists], set()
    if plain:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in plain])
        counts = df.select(F.explode(cells).alias("x")).select("x.*").filter("v IS NOT NULL").groupBy("column", "v").agg(F.count("*").alias("c"))
        tops = counts.groupBy("column").agg(F.sum("c").alias("n"), F.count("*").alias("levels"), F.max(F.struct("c", F.col("v"))).alias("top"))
        for r in tops.collect():  # a row per column
            rest = r["n"] - r["top"]["c"]
            if r["top"]["c"] >= IMBALANCED * r["n"]:
                out.append(("imbalance", r["column"], r["top"]["c"] / r["n"], f"{r['top']['v']}; {rest} other rows"))
            elif r["levels"] > CHARTABLE:
                out.append(("cardinality", r["column"], float(r["levels"]), None))
            if r["levels"] > CHARTABLE:
                crowded.add(r["column"])
    if len(numbers) > 1:
        for r in correlations(df, numbers).collect():
            if r["r"] is not None and r["n"] >= LEAST_ROWS and (target in (r["a"], r["b"]) if target in numbers else abs(r["r"]) >= STRONG):
                out.append(("correlation", f"{r['a']} ~ {r['b']}", r["r"], None))
    if stamps:
        day = F.col(stamps[0]) if stamps[0] in date_columns(df) else F.coalesce(dates.parse_date(F.col(stamps[0]), False), dates.parse_date(F.col(stamps[0]), True))
        ends = df.agg(F.date_format(F.min(day), "yyyy-MM-dd").alias("a"), F.date_format(F.max(day), "yyyy-MM-dd").alias("b")).first()
        out += [("from", stamps[0], None, ends["a"]), ("until", stamps[0], None, ends["b"])]
    chart = [c for c in plain if c not in crowded]
    steps = [
        ("clean_dataset", any(holes[c] > EMPTY for c in holes) or copies), (f"plot_column {numbers[0]}" if numbers else "", numbers), (f"analyze_multivalue {next(iter(lists))}" if lists else "", lists),
        (f"plot_relationship {chart[0]} {numbers[0]}" if chart and numbers else "", chart and numbers), (f"pivot_dataset {labels[0]} {numbers[0]}" if labels and numbers else "", labels and numbers and not chart),
        (f"analyze_over_time {stamps[0]} {numbers[0]}" if stamps and numbers else "", stamps and numbers), ("analyze_correlations", len(numbers) > 1), ("analyze_missing", any(holes[c] > EMPTY for c in holes) or blocks),
    ]
    out += [("next", str(k), float(k), s) for k, s in enumerate([s for s, due in steps if due], 1)]
    return spark.createDataFrame(out, T.StructType([T.StructField("kind", T.StringType()), T.StructField("subject", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("text", T.StringType())]))
