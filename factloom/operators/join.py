"""Guarded equi-joins: what a join will do to rows and measures is counted before it is done."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import NUMBERS, same_keys
from ..limits import LIMITS, Refusal
from .aggregate import measures

HOWS = ("left", "inner", "right", "outer")


def resolve_keys(left: DataFrame, right: DataFrame, on: list[str] | None = None, left_on: list[str] | None = None, right_on: list[str] | None = None) -> list[tuple[str, str]] | Refusal:
    """Aligned key pairs; without any, the only shared id-like column or the only shared column."""
    if on:
        left_on = right_on = on
    if not left_on and not right_on:
        shared = [c for c in left.columns if c in right.columns]
        ids = [c for c in shared if c.lower().endswith(("id", "key", "code"))]
        pick = ids if len(ids) == 1 else shared
        if len(pick) != 1:
            return Refusal(f"cannot choose a key among {', '.join(shared) or 'no shared columns'}")
        left_on = right_on = pick
    if len(left_on or []) != len(right_on or []):
        return Refusal("left and right keys differ in number")
    if missing := [c for c in left_on if c not in left.columns] + [c for c in right_on if c not in right.columns]:
        return Refusal(f"no such columns: {', '.join(missing)}")
    return list(zip(left_on, right_on, strict=True))


def match_counts(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], null_safe: bool = True) -> DataFrame:
    """``left`` with ``matches``: how many rows of ``right`` each row meets. ``right`` is counted by key first."""
    per_key = right.groupBy(*[F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(pairs)]).agg(F.count("*").alias("_n"))
    cond = same_keys([(a, f"_k{i}") for i, (a, _) in enumerate(pairs)], null_safe)
    return left.alias("l").join(per_key.alias("r"), cond, "left").withColumn("matches", F.coalesce("_n", F.lit(0))).drop("_n", *[f"_k{i}" for i in range(len(pairs))])


def forecast_rows(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], null_safe: bool = True) -> DataFrame:
    """Rows that each kind of join will give, and orphans on both sides, from two counts by key."""
    back = [(b, a) for a, b in pairs]
    m, r = F.col("matches"), F.col("matches")
    one = match_counts(left, right, pairs, null_safe).agg(
        F.coalesce(F.sum(m), F.lit(0)).alias("inner_rows"), F.coalesce(F.sum(F.greatest(m, F.lit(1))), F.lit(0)).alias("left_rows"), F.count_if(m == 0).alias("left_orphans"), F.count("*").alias("n_left")
    )
    two = match_counts(right, left, back, null_safe).agg(
        F.coalesce(F.sum(F.greatest(r, F.lit(1))), F.lit(0)).alias("right_rows"), F.count_if(r == 0).alias("right_orphans"), F.count("*").alias("n_right")
    )
    both = one.crossJoin(two)  # one row each
    return both.withColumn("outer_rows", F.col("left_rows") + F.col("right_orphans"))


def measure_impact(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], columns: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Each left measure's total before and after the join, and what falls out with unmatched rows."""
    columns = columns or measures(left, [a for a, _ in pairs])
    weight = F.col("matches") if how in ("inner", "right") else F.greatest(F.col("matches"), F.lit(1))
    sums = []
    for c in columns:
        v = F.col(c)
        sums += [F.sum(v).alias(f"{c}__before"), F.sum(v * weight).alias(f"{c}__after"), F.coalesce(F.sum(F.when(F.col("matches") == 0, v)), F.lit(0)).alias(f"{c}__lost")]
    wide = match_counts(left, right, pairs).agg(*sums)
    cells = [F.struct(F.lit(c).alias("measure"), *[F.col(f"{c}__{k}").cast("double").alias(k) for k in ("before", "after", "lost")]) for c in columns]
    return wide.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def key_relationship(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """left_unique, right_unique and the relationship: 1-1, 1-n, n-1 or n-n."""

    def repeated(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n") <= 1, F.lit(True)).alias(name))

    both = repeated(left, [a for a, _ in pairs], "left_unique").crossJoin(repeated(right, [b for _, b in pairs], "right_unique"))  # one row each
    side = lambda c: F.when(F.col(c), "1").otherwise("n")
    return both.withColumn("relationship", F.concat_ws("-", side("left_unique"), side("right_unique")))


def orphans(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], null_safe: bool = True) -> DataFrame:
    """Left rows without a partner."""
    return left.alias("l").join(right.alias("r"), same_keys(pairs, null_safe), "left_anti")


def key_problems(df: DataFrame, key: str) -> DataFrame:
    """Over all rows: share of zero-padded keys, of keys with outer white space, and blanks."""
    c = F.col(key).cast("string")
    return df.agg(
        F.avg(c.rlike(r"^0\d+$").cast("double")).alias("padded_share"),
        F.avg((c != F.regexp_replace(c, r"(?U)^\s+|\s+$", "")).cast("double")).alias("untrimmed_share"),
        F.count_if(c.isNull() | (F.trim(c) == "")).alias("blank_keys"),
    )


def key_kind(df: DataFrame, key: str) -> str:
    """number, date or text."""
    kind = df.schema[key].dataType
    return "number" if isinstance(kind, NUMBERS) else "date" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "text"


def key_notes(left: DataFrame, right: DataFrame, a: str, b: str) -> list[str]:
    """Why keys may not match though they look as if they should: type, zero padding, white space, case, blanks. Over all rows."""
    notes = []
    kinds = key_kind(left, a), key_kind(right, b)
    mine, other = key_problems(left, a).first(), key_problems(right, b).first()
    if kinds[0] != kinds[1]:
        notes.append(f"TYPE MISMATCH: left {a} holds {kinds[0]}s, right {b} holds {kinds[1]}s; cast one side first")
    if kinds == ("text", "text"):
        padded = [x["padded_share"] or 0.0 for x in (mine, other)]
        if abs(padded[0] - padded[1]) > 0.2:
            notes.append(f"ZERO PADDING: {a if padded[0] > padded[1] else b} keeps leading zeros and the other side does not")
        loose = [x["untrimmed_share"] or 0.0 for x in (mine, other)]
        if max(loose) > 0.01:
            notes.append(f"WHITESPACE: {max(loose):.0%} of values in {a if loose[0] >= loose[1] else b} have outer blanks; trim first")
        overlap = case_only_overlap(left, right, (a, b)).first()
        if overlap["n_keys"] and not overlap["exact"] and overlap["case_only"]:
            notes.append(f"CASE: {a} and {b} share no values as written, but {overlap['case_only']} match in lower case")
    notes += [f"BLANK KEYS: {x['blank_keys']} {side} row(s) have no {k}" for x, side, k in ((mine, "left", a), (other, "right", b)) if x["blank_keys"]]
    return notes


def case_only_overlap(left: DataFrame, right: DataFrame, key: tuple[str, str]) -> DataFrame:
    """Distinct left keys that match as they stand, and only without regard to case."""
    a = left.select(F.col(key[0]).cast("string").alias("k")).dropna().distinct()
    b = right.select(F.col(key[1]).cast("string").alias("k")).dropna().distinct()
    exact = b.select("k", F.lit(1).alias("exact"))
    lower = b.select(F.lower("k").alias("lk")).distinct().withColumn("loose", F.lit(1))
    out = a.join(exact, "k", "left").withColumn("lk", F.lower("k")).join(lower, "lk", "left")
    return out.agg(F.count("*").alias("n_keys"), F.count("exact").alias("exact"), F.count_if(F.col("exact").isNull() & F.col("loose").isNotNull()).alias("case_only"))


def join_datasets(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str = "left", names: tuple[str, str] = ("left", "right"), null_safe: bool = True) -> DataFrame:
    """The join itself; clashing columns get ``_<left>`` and ``_<right>``, equal key names stay one column."""
    if how not in HOWS:
        raise ValueError(f"how is one of {', '.join(HOWS)}")
    keys = [a for a, b in pairs if a == b]
    clash = {c for c in left.columns if c in right.columns} - set(keys)
    mine, other = (lambda c: F.col(f"l.`{c}`")), (lambda c: F.col(f"r.`{c}`"))
    out: list[Column] = []
    for c in left.columns:
        if c in keys:
            out.append(F.coalesce(mine(c), other(c)).alias(c) if how in ("right", "outer") else mine(c))
        else:
            out.append(mine(c).alias(f"{c}_{names[0]}") if c in clash else mine(c))
    out += [other(c).alias(f"{c}_{names[1]}") if c in clash else other(c) for c in right.columns if c not in keys]
    return left.alias("l").join(right.alias("r"), same_keys(pairs, null_safe), "full" if how == "outer" else how).select(*out)


@dataclass(frozen=True)
class JoinForecast:
    """The card that a person approves before a join runs."""

    how: str
    rows: dict[str, int]
    relationship: str
    impact: list[dict]
    flags: tuple[str, ...]
    problems: tuple[str, ...] = ()


def forecast(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str = "left") -> JoinForecast | Refusal:
    """Counts, relationship, measure impact and risk flags; no overlap at all is refused."""
    rows = forecast_rows(left, right, pairs).first().asDict()
    if rows["inner_rows"] == 0:
        return Refusal("; ".join(["no key value occurs on both sides", *[note for a, b in pairs for note in key_notes(left, right, a, b)]]))
    relationship = key_relationship(left, right, pairs).first()["relationship"]
    impact = [r.asDict() for r in measure_impact(left, right, pairs, how=how).collect()] if measures(left, [a for a, _ in pairs]) else []
    flags = []
    if rows[f"{how}_rows"] > max(rows["n_left"], 1) and relationship.endswith("-n"):
        flags.append("fan-out")
    if how in ("inner", "right") and rows["left_orphans"]:
        flags.append("rows lost")
    if how in ("inner", "right") and any(abs(i["lost"] or 0) >= LIMITS.measure_loss * abs(i["before"] or 0) > 0 for i in impact):
        flags.append("measure lost")
    if rows["left_orphans"] > 0.99 * rows["n_left"]:
        flags.append("overlap under 1 %")
    problems = tuple(note for a, b in pairs for note in key_notes(left, right, a, b))
    flags += sorted({note.split(":")[0].lower() for note in problems})
    return JoinForecast(how, rows, relationship, impact, tuple(flags), problems)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
