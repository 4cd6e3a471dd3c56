"""What happened in runs and sessions, in lines to be read: attempts, sessions, single sessions, guardrail findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import INJECTIONS

#: Attempts of a summary, failed ones at least; characters of a plan, of a reason, of a task.
SUMMARY_NODES, LEAST_FAILED, PLAN_CHARS, REASON_CHARS, TASK_CHARS = 12, 2, 300, 200, 36


def journal_summary(nodes: DataFrame, by: str, n: int = SUMMARY_NODES) -> DataFrame:
    """by, place, line: the last ``n`` good attempts of each run in order, then the last failed ones, at least two and as many as there is room for.

    ``nodes(<by>, id, step, stage, metric, lower_is_better, is_buggy, plan, analysis, term_out)``. A node is good when it is not buggy and has a metric. A failed one gives
    its analysis, or else the end of its output.
    """
    rows = nodes.withColumn("good", ~F.coalesce("is_buggy", F.lit(False)) & F.col("metric").isNotNull())
    back = Window.partitionBy(by, "_part").orderBy(F.desc("step"), F.desc("id"))
    part = F.when(F.col("good"), 0).when(F.coalesce("is_buggy", F.lit(False)), 1)
    rows = rows.withColumn("_part", part).filter("_part IS NOT NULL").withColumn("_back", F.row_number().over(back))
    room = rows.filter("_part = 0").groupBy(by).agg(F.least(F.count("*"), F.lit(n)).alias("_good"))
    rows = rows.join(room, by, "left").withColumn("_room", F.when(F.col("_part") == 0, n).otherwise(F.greatest(F.lit(LEAST_FAILED), n - F.coalesce("_good", F.lit(0)))))
    rows = rows.filter(F.col("_back") <= F.col("_room"))
    lower = F.when(F.col("lower_is_better"), " (lower better)").otherwise("")
    good = F.concat(F.lit(" metric="), F.round("metric", 5).cast("string"), lower, F.lit(": "), F.left(F.coalesce("plan", F.lit("")), F.lit(PLAN_CHARS)))
    reason = F.when(F.coalesce("analysis", F.lit("")) != "", F.left("analysis", F.lit(REASON_CHARS))).otherwise(F.right(F.coalesce("term_out", F.lit("")), F.lit(REASON_CHARS)))
    line = F.concat(F.lit("attempt "), F.col("step").cast("string"), F.lit(" ["), "stage", F.lit("]"), F.when(F.col("_part") == 0, good).otherwise(F.concat(F.lit(" FAILED: "), reason)))
    place = F.row_number().over(Window.partitionBy(by).orderBy("_part", F.desc("_back")))
    return rows.select(by, place.alias("place"), line.alias("line"))


def list_sessions(steps: DataFrame, session: str, at: str, kind: Column, task: Column, n: int = 10) -> DataFrame:
    """The ``n`` sessions that began last: session, began, duration (null while one is open), calls, corrections, outcome (of its end; null while open), task.

    ``kind`` is task, call, correction or end for a step, else anything; ``task`` the text of a step. A limit is the feature.
    """
    rows = steps.select(F.col(session).alias("session"), F.col(at).alias("at"), kind.alias("kind"), task.alias("text"))
    one = rows.groupBy("session").agg(
        F.min("at").alias("began"), (F.max(F.when(F.col("kind") == "end", F.col("at"))) - F.min("at")).alias("duration"), F.count_if(F.col("kind") == "call").alias("calls"), F.count_if(F.col("kind") == "correction").alias("corrections"),
        F.max_by(F.when(F.col("kind") == "end", F.col("text")), F.when(F.col("kind") == "end", F.col("at"))).alias("outcome"), F.left(F.coalesce(F.min_by(F.when(F.col("kind") == "task", F.col("text")), F.when(F.col("kind") == "task", F.col("at"))), F.lit("")), F.lit(TASK_CHARS)).alias("task"),
    )
    return one.orderBy(F.desc("began"), "session").limit(n)


def recall_session(steps: DataFrame, session: str, at: str, role: str, text: str, prefix: str) -> DataFrame:
    """place and line of the sessions whose id begins with ``prefix`` (four characters at least), each step on one line."""
    if len(prefix) < 4:
        raise ValueError("a session is recalled by at least four characters of its id")
    rows = steps.filter(F.col(session).cast("string").startswith(prefix))
    said = F.concat(F.lit("["), F.col(role), F.lit("] "), F.left(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(PLAN_CHARS)))
    return rows.select(F.col(session).alias("session"), F.row_number().over(Window.partitionBy(session).orderBy(at)).alias("place"), said.alias("line"))


def guardrail_summary(results: DataFrame, tool: str, text: str) -> DataFrame:
    """tool, pattern, n, first: what of the scan's patterns stood in which tool's results, how often, and the wording that was met first in order."""
    found = F.array_compact(F.array(*[F.when(F.col(text).rlike(f"(?i){p}"), F.struct(F.lit(name).alias("pattern"), F.regexp_extract(text, f"(?i){p}", 0).alias("wording"))) for name, p in INJECTIONS.items()]))
    rows = results.select(F.col(tool).alias("tool"), F.explode(found).alias("f"))
    return rows.groupBy("tool", F.col("f.pattern").alias("pattern")).agg(F.count("*").alias("n"), F.min("f.wording").alias("first"))
