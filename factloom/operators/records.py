"""Search journals, fine-tuning rows, chunk indexes and checked arithmetic."""

from __future__ import annotations

import tempfile
import ast
import operator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import once
from ..functions.ranks import running
from ..shipping import ship

_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.USub: operator.neg, ast.UAdd: operator.pos}


@lru_cache(maxsize=10_000)  # common expressions recur, most others are met once
def evaluate(expression: str | None) -> float | None:
    """A number from + - * / % ^ and brackets over numbers; null for anything else."""

    def walk(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](walk(node.left), walk(node.right))
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow):
            base, power = walk(node.left), walk(node.right)
            if abs(power) > 64:
                raise ValueError("power too large")
            return base**power
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](walk(node.operand))
        raise ValueError("not arithmetic")

    try:
        text = (expression or "").replace(",", "").replace("×", "*").replace("÷", "/").replace("^", "**").replace("%", "/100")
        return float(walk(ast.parse(text, mode="eval").body))
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, TypeError, RecursionError):
        return None


def check_arithmetic(df: DataFrame, expression: str, claim: str, tolerance: float = 0.01) -> DataFrame:
    """``df`` with ``value`` and ``holds``: the claim is within the tolerance, as it stands or read as per cent."""

    ship(df.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def value(e: pd.Series) -> pd.Series:
        return e.map(evaluate)

    near = lambda c: F.abs(F.col("value") - c) <= tolerance * F.greatest(F.abs(c), F.lit(1e-9))
    c = F.col(claim)
    return df.withColumn("value", value(expression)).withColumn("holds", F.coalesce(near(c) | near(c * 100) | near(c / 100), F.lit(False)))


#: Fixed value: how far a stated result may be off, as a share of the larger of the two.
STATED_TOLERANCE = 0.01


def check_computations(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, status and wrong of computations in words like ``a + b = 3; c / d = 0.25 = 25%``.

    Parts between semicolons are claims; the first side of a claim's equals signs is the expression (commas and per cent signs off), the others state its result: the
    first number in each, in per cent if a sign follows it, which then may state the value or a hundred times it. A claim is verified when any of its statements is
    right, wrong when none is, and says nothing if it has no number or no arithmetic. A row is ``mismatch`` if a claim is wrong (``wrong`` lists them),
    ``verified`` if one is right, else empty. Expressions are evaluated where they stand, those that a worker has seen of late not again.
    """
    ship(df.sparkSession)
    said = F.filter(F.split(text_col, ";"), lambda p: F.contains(p, F.lit("=")))
    parts = df.select(F.col(id_col).alias("id"), F.explode_outer(said).alias("part"))  # a row at least for every id
    claims = parts.select("id", "part", F.regexp_replace(F.trim(F.substring_index("part", "=", 1)), "[,%]", "").alias("expression"))

    @F.pandas_udf(T.DoubleType())
    def value(e: pd.Series) -> pd.Series:
        return e.map(evaluate)

    def read(x: Column) -> Column:
        number = lambda plain: F.regexp_extract(plain, r"-?\d+(?:\.\d+)?", 0)
        found = lambda plain: once(number(plain), lambda n: F.struct(n.try_cast("double").alias("v"), (F.locate("%", plain) > F.instr(plain, n)).alias("percent")))
        return once(F.regexp_replace(x, ",", ""), found)

    near = lambda a, v: F.abs(a - v) / F.greatest(F.abs(a), F.abs(v), F.lit(1e-9)) <= STATED_TOLERANCE
    actual = F.col("actual")
    fits = lambda s: near(actual, s["v"]) | (s["percent"] & near(actual * 100, s["v"]))
    numbers = F.filter(F.transform(F.slice(F.split("part", "="), 2, F.size(F.split("part", "="))), lambda x: read(F.trim(x))), lambda s: s["v"].isNotNull())
    right = F.when(actual.isNotNull(), once(numbers, lambda found: F.when(F.size(found) > 0, F.exists(found, fits))))
    judged = claims.withColumn("actual", value("expression")).select("id", F.trim("part").alias("part"), right.alias("right"))
    per = judged.groupBy("id").agg(F.bool_and("right").alias("all"), F.array_sort(F.collect_list(F.when(~F.col("right"), F.col("part")))).alias("wrong"))
    known = F.col("id").isNotNull()
    status = F.when(F.col("all").isNull() | ~known, "").when(F.col("all"), "verified").otherwise("mismatch")
    return per.select("id", status.alias("status"), F.when(known, F.col("wrong")).otherwise(F.array().cast("array<string>")).alias("wrong"))


def best_nodes(nodes: DataFrame, by: str, n: int = 1) -> DataFrame:
    """The best finished nodes of each run; whether lower is better goes by the majority of the run's nodes."""
    good = nodes.filter(~F.col("is_buggy") & F.col("metric").isNotNull())
    lower = F.avg(F.col("lower_is_better").cast("double")).over(Window.partitionBy(by)) > 0.5
    ranked = good.withColumn("_key", F.when(lower, F.col("metric")).otherwise(-F.col("metric")))
    place = F.row_number().over(Window.partitionBy(by).orderBy("_key", "id"))
    return ranked.withColumn("place", place).filter(F.col("place") <= n).drop("_key")


def buggy_leaves(nodes: DataFrame) -> DataFrame:
    """Buggy nodes that nothing was built on."""
    parents = nodes.select(F.col("parent_id").alias("_p")).dropna().distinct()
    return nodes.filter("is_buggy").join(parents, F.col("id") == F.col("_p"), "left_anti")


def run_lengths(df: DataFrame, by: list[str], order: str, flag: Column) -> DataFrame:
    """``run``: how many flagged rows in a row end at this one; any other row sets it back."""
    w = Window.partitionBy(*by).orderBy(order)
    island = F.sum(F.when(flag, 0).otherwise(1)).over(w)
    rows = df.withColumn("_flag", flag).withColumn("_island", island)
    count = F.sum(F.col("_flag").cast("int")).over(Window.partitionBy(*by, "_island").orderBy(order))
    return rows.withColumn("run", F.when(F.col("_flag"), count).otherwise(0)).drop("_flag", "_island")


def debug_depth(nodes: DataFrame, by: str | None = None) -> DataFrame:
    """``nodes`` with ``depth``: how many debug nodes in a row, up the parents, end at this one (0 for other stages and for roots).

    Ancestors are found by pointer jumping: each round doubles the reach, so a chain of n takes log n joins, and after as many rounds as the number of
    nodes has bits only nodes that are their own ancestors, or stand below such, still point up: they lie on a cycle and have a null depth.
    """
    keys = [by] if by else []
    at = nodes.select(*keys, "id", F.when((F.col("stage") == "debug") & F.col("parent_id").isNotNull(), F.col("parent_id")).alias("up")).withColumn("depth", F.col("up").isNotNull().cast("long"))
    spark = nodes.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    for _ in range(nodes.count().bit_length() + 1):
        above = at.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        same = [F.col("up") == F.col("_id"), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]]
        at = at.join(above, same, "left").select(*keys, "id", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"))
        at = at.checkpoint()  # read by the next round and by the test of its end
        if not at.filter("up IS NOT NULL").head(1):
            break
    at = at.withColumn("depth", F.when(F.col("up").isNull(), F.col("depth")))
    return nodes.join(at.drop("up"), [*keys, "id"])


def finetune_rows(df: DataFrame, prompt: str, completion: str, order: list[str], share: float = 0.1) -> DataFrame:
    """Rows with both sides filled, and ``part``: of ten or more the first share, in order, validates.

    Row numbers over all rows come from counts per value of the leading order column (a number), whose running sums no single task takes.
    """
    known = df.filter((F.trim(F.coalesce(prompt, F.lit(""))) != "") & (F.trim(F.coalesce(completion, F.lit(""))) != ""))
    lead = order[0]
    placed = running(known.groupBy(F.col(lead).alias("_lead")).agg(F.count("*").alias("_n")), "_lead", ["_n"])
    nth = F.row_number().over(Window.partitionBy(lead).orderBy(*order)) + F.col("_n_before")
    held = F.when(F.col("_n_all") >= 10, F.greatest(F.lit(1), F.floor(F.col("_n_all") * share))).otherwise(0)
    out = known.join(placed, F.col(lead) == F.col("_lead")).withColumn("_nth", nth)
    return out.withColumn("part", F.when(F.col("_nth") <= held, "validation").otherwise("train")).select(*df.columns, "part")


def upsert(index: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The index with fresh rows in place of old ones of the same key."""
    return index.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)
