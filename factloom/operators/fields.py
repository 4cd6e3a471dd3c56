"""Fields out of replies and payloads, ids by content, labels for charts, and the group shorthand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_group_spec(spec: str) -> tuple[list[str], dict[str, str]]:
    """``region,month:sum(sales),mean(price)`` -> keys and aggregations by column. Names may hold anything but the marks ``: , ( )``; what cannot be
    read is an error that says where."""
    parts, depth, text = [], 0, ""  # (closing mark, text) of every stretch between marks, in order
    for at, mark in enumerate(spec + ","):
        if mark not in ":,()":
            text += mark
            continue
        depth += {"(": 1, ")": -1}.get(mark, 0)
        if depth not in (0, 1) or (depth and mark in ":,"):
            raise ValueError(f"misplaced {mark!r} at {at} of {spec!r}")
        parts.append((mark, text.strip()))
        text = ""
    ends = [i for i, (mark, _) in enumerate(parts) if mark == ":"]
    if len(ends) > 1:
        raise ValueError(f"more than one ':' in {spec!r}")
    cut = ends[0] + 1 if ends else len(parts)
    keys, how = [name for _, name in parts[:cut] if name], {}
    if any(mark in "()" for mark, _ in parts[:cut]):
        raise ValueError(f"brackets among the keys of {spec!r}")
    rest = [p for p in parts[cut:] if p != (",", "")]
    for (opening, function), (closing, column) in zip(rest[::2], rest[1::2], strict=False):
        if (opening, closing) != ("(", ")") or not function or not column:
            raise ValueError(f"no aggregation like sum(sales) in {function or column!r} of {spec!r}")
        how[column] = function.lower()
    if len(rest) % 2:
        raise ValueError(f"no aggregation like sum(sales) in {rest[-1][1]!r} of {spec!r}")
    return keys, how


def clean_label(c: Column, width: int = 42) -> Column:
    """A label on one line, cut with an ellipsis; blank ones say so."""
    flat = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    cut = F.when(F.length(flat) > width, F.concat(F.left(flat, F.lit(width - 1)), F.lit("…"))).otherwise(flat)
    return F.when(flat == "", "(blank)").otherwise(cut)


def plot_sample(df: DataFrame, id_col: str, limit: int = 20_000) -> DataFrame:
    """At most ``limit`` rows, those of least hash, with ``sampled_of``: how many there are in all. A chart's sample always says so."""
    total = df.agg(F.count("*").alias("sampled_of"))
    return df.orderBy(F.xxhash64(id_col), id_col).limit(limit).crossJoin(total)  # one row


def content_id(name: Column, content: Column) -> Column:
    """``<name>-<first 12 of the content's SHA-256>``, the name reduced to safe characters."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"[^A-Za-z0-9._-]+", "_")
    stem = F.regexp_replace(stem, r"^_+|_+$", "")
    return F.concat(F.when(stem == "", "document").otherwise(stem), F.lit("-"), F.left(F.sha2(content, 256), F.lit(12)))


#: A JSON string, whole; and what is no part of any object once strings are blanked.
JSON_STRING = r'"[^"\\]*(?:\\.[^"\\]*)*"'


def json_objects(text: Column) -> Column:
    """The outermost balanced objects of a text, in order; braces inside of strings do not count.

    Strings are blanked (as long as they were), so that depth is a running count of braces. An object runs from a brace that opens at depth 0 to
    the one that closes it; a brace that never closes is skipped.
    """
    blank = F.array_join(F.transform(
        F.split(F.regexp_replace(F.translate(text, "\x01\x02", "  "), JSON_STRING, "\x01$0\x02"), "[\x01\x02]"),
        lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit("_"), F.length(p))).otherwise(p)), "")
    upto = F.regexp_extract_all(blank, F.lit("[^{}]*[{}]"), F.lit(0))  # what runs to each brace
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("open"), F.array().cast("array<struct<b: int, e: int>>").alias("found"))

    def step(got: Column, x: Column) -> Column:
        at = (got["at"] + F.length(x)).alias("at")
        opened = F.concat(got["open"], F.array(got["at"] + F.length(x)))
        last = F.element_at(got["open"], -1)
        inner = F.filter(got["found"], lambda o: o["b"] < last)  # what the object that closes here holds is part of it
        closed = F.struct(at, F.slice(got["open"], 1, F.size(got["open"]) - 1).alias("open"), F.concat(inner, F.array(F.struct(last.alias("b"), (got["at"] + F.length(x)).alias("e")))).alias("found"))
        return F.when(x.endswith("{"), F.struct(at, opened.alias("open"), got["found"].alias("found"))).when(F.size(got["open"]) == 0, F.struct(at, got["open"].alias("open"), got["found"].alias("found"))).otherwise(closed)

    spans = F.aggregate(upto, begin, step, lambda got: got["found"])
    return F.transform(spans, lambda o: F.substring(text, o["b"], o["e"] - o["b"] + 1))


def json_text(c: Column) -> Column:
    """The JSON object in a reply: thinking blocks off, then that of a fenced block, else the last balanced one that parses; null if there is none."""
    plain = F.trim(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))
    fenced = F.regexp_extract(plain, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    good = lambda text: F.filter(json_objects(text), lambda x: F.try_parse_json(x).isNotNull())
    last = lambda text: F.transform(F.array(text), lambda x: F.try_element_at(good(x), F.lit(-1)))[0]  # noqa: E731  a text is made, and looked through, once
    return F.coalesce(last(fenced), last(plain))


def payload_fields(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, name, value of a payload's fields: those of a ``fields`` list of objects (with confidence), else its own scalar members."""
    row = df.select(F.col(id_col).alias("id"), json_text(F.col(json_col)).alias("j"))
    listed = F.from_json(F.get_json_object("j", "$.fields"), "array<struct<name: string, value: string, confidence: double>>")
    own = F.transform(F.map_entries(F.from_json("j", "map<string, string>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"), F.lit(None).cast("double").alias("confidence")))
    fields = F.coalesce(listed, F.filter(own, lambda x: ~x["value"].rlike(r"^\s*[\[{]")))
    out = row.select("id", F.posexplode(fields).alias("pos", "f")).select("id", "pos", "f.*")
    return out.filter((F.trim(F.coalesce("name", F.lit(""))) != "") & F.col("value").isNotNull())


def dedupe_fields(fields: DataFrame) -> DataFrame:
    """One row of each (id, name, value), regardless of case and blanks: the most confident, then the first."""
    same = F.lower(F.regexp_replace("value", r"(?U)\s+", ""))
    nth = F.row_number().over(Window.partitionBy("id", F.lower("name"), same).orderBy(F.desc_nulls_last("confidence"), "pos"))
    return fields.withColumn("_n", nth).filter("_n = 1").drop("_n")
