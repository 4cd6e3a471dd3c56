"""Delimiter-packed lists, chunks, search, guards and event logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..limits import LIMITS, Refusal
from .aggregate import aggregate

#: Wording of instructions hidden in data, by name.
INJECTIONS = {
    "classic override attempt": r"ignore (all |any )?previous instructions",
    "instruction override attempt": r"disregard (the )?(system prompt|your instructions)",
    "role/mode override attempt": r"you are now (in )?(developer|admin|dan|unrestricted) mode",
    "prompt-extraction attempt": r"reveal (your |the )?(system prompt|instructions)",
    "covert-action instruction": r"do not (tell|inform|mention).{0,30}(user|person)",
    "fake-authorization framing": r"this is (a |an )?(test|override).{0,20}(approved|authorized)",
}
#: The names of failures by kind, in the order they are tried.
FAILURES = {
    "syntax": ("SyntaxError", "IndentationError", "TabError"),
    "import": ("ImportError", "ModuleNotFoundError", "No module named"),
    "file": ("FileNotFoundError", "No such file or directory", "IsADirectoryError"),
}
RUNTIME_ERRORS = ("TypeError", "NameError", "AttributeError", "ValueError", "RuntimeError", "KeyError", "IndexError", "AssertionError")
OTHER_ERRORS = (
    "UnboundLocalError", "NotADirectoryError", "PermissionError", "FileExistsError", "RecursionError", "MemoryError", "ZeroDivisionError", "StopIteration", "OverflowError",
)
EXIT = r"\[exit(?:\s+code)?\s+[1-9]\d*\]"


def quoted(sep: str) -> str:
    """A separator as a literal for split."""
    return f"\\Q{sep}\\E"


def values_of(c: Column, sep: str) -> Column:
    """The trimmed, non-empty parts of a packed list."""
    return F.filter(F.transform(F.split(c, quoted(sep)), lambda x: F.trim(x)), lambda x: x != "")


def multivalue_detect(df: DataFrame, column: str) -> DataFrame:
    """For each separator: share of values that hold it, and whether the column packs lists by it. One pass over the values, one over their parts.

    A list has parts in varying number, or else at least twice as many different combinations as single values.
    """
    seps = F.array(*[F.lit(s) for s in (",", ";", "|")])
    rows = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("v"), F.explode(seps).alias("sep"))
    parts = F.expr(r"filter(transform(split(v, concat('\\Q', sep, '\\E')), x -> trim(x)), x -> x != '')")
    rows = rows.withColumn("parts", parts)
    one = rows.groupBy("sep").agg(
        F.count("*").alias("n"), F.avg(F.contains("v", F.col("sep")).cast("double")).alias("share"), F.count_distinct(F.size("parts")).alias("part_counts"), F.count_distinct("v").alias("combinations"),
    )
    words = rows.select("sep", F.explode("parts").alias("w")).groupBy("sep").agg(F.count_distinct("w").alias("vocabulary"))
    packed = (F.col("n") >= 10) & (F.col("share") >= 0.5) & (F.col("vocabulary") <= 100) & ((F.col("part_counts") >= 2) | (F.col("combinations") >= 2 * F.col("vocabulary")))
    return one.join(words, "sep", "left").select("sep", "share", "part_counts", F.coalesce("vocabulary", F.lit(0)).alias("vocabulary"), F.coalesce(packed, F.lit(False)).alias("packed"))


def analyze_multivalue(df: DataFrame, column: str, sep: str = ",", value_col: str | None = None, how: str = "mean", min_rows: int | None = None) -> DataFrame:
    """Per list value: rows and share of rows (shares may pass 100 %), or the aggregate of ``value_col`` for values with enough rows."""
    rows = df.withColumn("_value", F.explode(values_of(F.col(column), sep)))
    if value_col is None:
        total = df.agg(F.count(column).alias("total"))
        return rows.groupBy(F.col("_value").alias("value")).agg(F.count("*").alias("n")).crossJoin(total).select("value", "n", (F.col("n") / F.col("total")).alias("share"))  # one row
    out = rows.groupBy(F.col("_value").alias("value")).agg(F.count(value_col).alias("n"), aggregate(how, F.col(value_col)).alias(how))
    return out.filter(F.col("n") >= (min_rows or LIMITS.min_group_rows))


def check_vocabulary(df: DataFrame, column: str, sep: str = ",") -> int | Refusal:
    n = df.select(F.explode(values_of(F.col(column), sep)).alias("w")).agg(F.count_distinct("w")).first()[0]
    return n if n <= LIMITS.vocabulary else Refusal(f"{n} distinct values in {column}")


def chunk_lines(df: DataFrame, id_col: str, text_col: str, width: int = 60, overlap: int = 10) -> DataFrame:
    """Windows of lines: id, start_line and end_line (from 1), content; blank windows are left out."""
    step = width - overlap
    lines = df.select(F.col(id_col).alias("id"), F.split(text_col, "\n").alias("lines"))
    starts = lines.withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.size("lines") - 1, F.lit(0)), F.lit(step))))
    content = F.array_join(F.slice("lines", F.col("start") + 1, width), "\n")
    out = starts.select("id", (F.col("start") + 1).alias("start_line"), F.least(F.col("start") + width, F.size("lines")).alias("end_line"), content.alias("content"))
    return out.filter(F.regexp_replace("content", r"(?U)\s+", "") != "")


def terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]{3,}"), F.lit(0))


def bm25(df: DataFrame, id_col: str, text_col: str, query: list[str], k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id and score of the best documents for the query's terms; only query terms are counted, lengths come from arrays."""
    docs = df.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("t")).withColumn("len", F.size("t"))
    known = F.filter("t", lambda x: x.isin(query))
    corpus = docs.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    tf = docs.select("id", "len", F.explode(known).alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    df_ = tf.groupBy("term").agg(F.count("*").alias("df"))
    rows = tf.join(F.broadcast(df_), "term").crossJoin(corpus)  # df: a row per query term; corpus: one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return rows.groupBy("id").agg(F.sum(idf * weight).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_topk(df: DataFrame, id_col: str, vector_col: str, target: DataFrame, k: int = 6) -> DataFrame:
    """id and cosine of the k nearest to the one vector in ``target`` (one row, column ``target``)."""
    return df.crossJoin(target).select(F.col(id_col).alias("id"), cosine(F.col(vector_col), F.col("target")).alias("score")).orderBy(F.desc("score"), "id").limit(k)  # one row


def page_budget_select(df: DataFrame, by: list[str], page: str, text_col: str, query: list[str], budget: int = 60_000) -> DataFrame:
    """Pages by term hits until the budget of characters is passed, at least one for each document; all of them where they fit."""
    hits = sum((F.size(F.regexp_extract_all(F.lower(text_col), F.lit(re.escape(q)), F.lit(0))) for q in query), F.lit(0))
    rows = df.select(*by, page, (F.length(text_col) + 1).alias("size"), hits.alias("hits"))
    w = Window.partitionBy(*by)
    order = w.orderBy(F.desc("hits"), page)
    rows = rows.withColumns({"running": F.sum("size").over(order), "total": F.sum("size").over(w), "nth": F.row_number().over(order)})
    return rows.filter((F.col("total") <= budget) | (F.col("running") <= budget) | (F.col("nth") == 1)).select(*by, page, "hits")


def injection_scan(df: DataFrame, id_col: str, text_col: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """id and pattern name for each pattern that a text holds; texts are annotated, never changed."""
    tests = [F.when(F.col(text_col).rlike(f"(?i){p}"), F.lit(name)) for name, p in (patterns or INJECTIONS).items()]
    return df.select(F.col(id_col).alias("id"), F.explode(F.array_compact(F.array(*tests))).alias("pattern"))


def key_values(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``Label: value`` pairs of lines and their bar-separated segments: short keys of few words, values of bounded length; the first wins per key."""
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r"\n|\|")).alias("pos", "segment"))
    pair = lines.withColumns({"key": F.trim(F.regexp_extract("segment", r"^\s*([^:\n]{1,45}?)\s*:\s*(\S.{0,119})$", 1)), "value": F.trim(F.regexp_extract("segment", r"^\s*([^:\n]{1,45}?)\s*:\s*(\S.{0,119})$", 2))})
    known = pair.filter((F.col("key") != "") & (F.size(F.split("key", r"\s+")) <= 5))
    first = F.row_number().over(Window.partitionBy("id", F.lower("key")).orderBy("pos"))
    return known.withColumn("_n", first).filter("_n = 1").select("id", "key", "value")


def repetition_runs(df: DataFrame, by: list[str], order: str, signature: Column) -> DataFrame:
    """Steps that are the third equal one in a row, or close a cycle A, B, A, B."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("_s", signature)
    lag = lambda k: F.lag("_s", k).over(w)
    rows = rows.withColumns({"_1": lag(1), "_2": lag(2), "_3": lag(3)})
    same = (F.col("_s") == F.col("_1")) & (F.col("_s") == F.col("_2"))
    cycle = (F.col("_s") == F.col("_2")) & (F.col("_1") == F.col("_3")) & (F.col("_s") != F.col("_1"))
    kind = F.when(same, "repeat").when(cycle, "cycle")
    return rows.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(*by, order, "kind")


def session_turns(df: DataFrame, session: str, role: str, text_col: str) -> DataFrame:
    """Turns of each session, the user's among them, and characters said."""
    return df.groupBy(session).agg(F.count("*").alias("n_turns"), F.count_if(F.col(role) == "user").alias("n_user"), F.sum(F.length(text_col)).alias("n_chars"))


def session_metrics(df: DataFrame, session: str, kind: str, time: str) -> DataFrame:
    return df.groupBy(session).agg(F.count("*").alias("n_steps"), F.count_distinct(kind).alias("n_kinds"), F.max(time).alias("last"), F.min(time).alias("first"))


def is_error(c: Column, tool: Column | str | None = None) -> Column:
    """Whether a tool's result tells of a failure: a traceback, an error prefix, a bad exit code, a timeout, or an exception's name before a colon or line end."""
    names = [n for kind in ("syntax", "import", "file") for n in FAILURES[kind] if " " not in n] + [*RUNTIME_ERRORS, *OTHER_ERRORS]
    found = F.contains(c, F.lit("Traceback (most recent call last)")) | c.startswith("Error: ") | c.startswith("Error executing") | c.rlike(EXIT)
    found = found | F.contains(F.lower(c), F.lit("timed out after")) | c.rlike("(" + "|".join(names) + ")(:|\n)")
    return found | c.startswith(F.concat(F.lit("Error running '"), tool if isinstance(tool, Column) else F.col(tool), F.lit("'"))) if tool is not None else found


def error_class(c: Column) -> Column:
    """The kind of failure a result's text tells of; the first kind that fits, else generic. For results that are errors."""
    out = None
    for kind, names in FAILURES.items():
        test = c.rlike("|".join(names))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    out = out.when(F.contains(F.lower(c), F.lit("timed out")), "timeout")
    out = out.when(c.rlike("Traceback|(" + "|".join(RUNTIME_ERRORS) + "):"), "runtime").when(c.rlike(EXIT), "shell")
    return F.when(c.isNotNull(), out.otherwise("generic"))


def playbook_dedupe(df: DataFrame, by: list[str], order: str, text_col: str, budget: int, width: int = 300) -> DataFrame:
    """Newest lessons first until the budget of characters: blanks collapsed, cut to width, one of each regardless of case."""
    line = F.left(F.trim(F.regexp_replace(text_col, r"\s+", " ")), F.lit(width))
    rows = df.select(*by, order, line.alias("line"))
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by, F.lower("line")).orderBy(order))).filter("_n = 1").drop("_n")
    running = F.sum(F.length("line") + 1).over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return once.withColumn("_sum", running).filter(F.col("_sum") <= budget).drop("_sum")


def compact(c: Column, limit: int = 2000, head: int = 1200, tail: int = 600) -> Column:
    """A long result as its head and tail."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(head)), F.lit("\n…\n"), F.right(c, F.lit(tail)))).otherwise(c)
