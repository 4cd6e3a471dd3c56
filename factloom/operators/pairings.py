"""Claims in prose that link a label of one dimension with a label of another, held against the cross-tab of the two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..limits import LIMITS, Refusal

#: Wordings that make a pairing of two labels.
LINKS = [
    " for ", " before ", " ahead of ", " during ", " at ", " in ", " on ", " where ", " drives", " driven by", " leads", " lead ", " promote", " push", " stock",
    " front-load", " front load", " bundle", " target", " prioriti",
]
#: Where a line is cut into clauses; the shortest label that is looked for.
CLAUSES, LEAST_LABEL = r"[,;•]|(?<=[A-Za-z])\.\s+", 3
#: Endings of a column's name that nobody writes; after which a plural takes -es.
KEY_WORDS, HISSING = ("id", "ids", "name", "names", "code", "key"), ("s", "x", "ch", "sh")


def column_aliases(column: str) -> list[str]:
    """How prose names a column: as it is, with blanks, without a closing id or name, each also in the plural."""
    spaced = " ".join(column.replace("_", " ").replace("-", " ").split())
    words = spaced.split()
    bare = " ".join(words[:-1]) if len(words) > 1 and words[-1].lower() in KEY_WORDS else spaced
    single = {w.lower() for w in (column, spaced, bare)}
    return sorted(w for w in single | {w + ("es" if w.endswith(HISSING) else "s") for w in single} if len(w) >= LEAST_LABEL)


def place_in(text: Column, label: Column) -> Column:
    """Where a label stands in a text as a whole (from 1), case aside; 0 where it does not."""
    quoted = F.concat(F.lit(r"(?iu)(?<!\w)\Q"), label, F.lit(r"\E(?!\w)"))
    return F.regexp_instr(text, quoted)


def _named(clauses: DataFrame, labels: DataFrame) -> DataFrame:
    """id, n, label, at: labels in clauses. A label is met by its first word, then looked for as a whole."""
    word = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    spoken = clauses.select("id", "n", "clause", F.explode(F.array_distinct(word(F.col("clause")))).alias("word"))
    known = labels.filter(F.length("label") >= LEAST_LABEL).withColumn("word", F.get(word(F.col("label")), 0))
    return spoken.join(known, "word").withColumn("at", place_in(F.col("clause"), F.col("label"))).filter("at > 0").select("id", "n", "label", "at")


def claimed_pairs(lines: DataFrame, a_labels: DataFrame, b_labels: DataFrame) -> DataFrame:
    """id, unit, text, a, b: the pairs of labels that lines(id, text) claim.

    A line is cut into clauses, and clauses are put together again until both dimensions are named: each such unit is one claim, if it has one of the
    linking words. A label belongs with the nearest of the other dimension, seen from either; of equally near ones the first in order.
    """
    clauses = lines.select("id", F.posexplode(F.filter(F.transform(F.split("text", CLAUSES), lambda c: F.trim(c)), lambda c: c != "")).alias("n", "clause"))
    found = [_named(clauses, x).withColumn("side", F.lit(side)) for side, x in (("a", a_labels), ("b", b_labels))]
    named = found[0].union(found[1])
    sides = named.groupBy("id", "n").agg(F.max(F.col("side") == "a").alias("has_a"), F.max(F.col("side") == "b").alias("has_b"))
    flagged = clauses.join(sides, ["id", "n"], "left").select("id", "n", "clause", F.coalesce("has_a", F.lit(False)).alias("has_a"), F.coalesce("has_b", F.lit(False)).alias("has_b"))
    # The clauses of one line in order: open sides and the number of finished units go from one to the next.
    start = F.struct(F.lit(0).alias("unit"), F.lit(False).alias("a"), F.lit(False).alias("b"), F.array().cast("array<int>").alias("units"))

    def add(got: Column, c: Column) -> Column:
        a, b = got["a"] | c["has_a"], got["b"] | c["has_b"]
        whole, units = a & b, F.concat(got["units"], F.array(got["unit"]))
        return F.struct((got["unit"] + whole.cast("int")).alias("unit"), (a & ~whole).alias("a"), (b & ~whole).alias("b"), units.alias("units"))

    parts = flagged.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "clause", "has_a", "has_b"))).alias("c"))
    parts = parts.withColumn("u", F.aggregate("c", start, add)).select("id", F.explode(F.arrays_zip("c", F.col("u.units").alias("unit"))).alias("x"), F.col("u.unit").alias("whole")).filter("x.unit < whole")
    parts = parts.select("id", "x.c.n", "x.unit", "x.c.clause")
    before = Window.partitionBy("id", "unit").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("shift", F.coalesce(F.sum(F.length("clause") + 2).over(before), F.lit(0)))
    units = parts.groupBy("id", "unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "clause"))), lambda x: x["clause"]), ", ").alias("text"))
    spoken = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    units = units.filter(F.exists(F.array(*[F.lit(w) for w in LINKS]), lambda w: F.contains(spoken, w)))
    at = named.join(parts, ["id", "n"]).groupBy("id", "unit", "side", "label").agg(F.min(F.col("at") + F.col("shift")).alias("at"))
    side = lambda s: at.filter(F.col("side") == s).select("id", "unit", F.col("label").alias(s), F.col("at").alias(f"at_{s}"))
    both = side("a").join(side("b"), ["id", "unit"]).withColumn("far", F.abs(F.col("at_a") - F.col("at_b")))  # labels of one unit
    nearest = lambda one, other: both.groupBy("id", "unit", one).agg(F.min(F.struct("far", other))[other].alias(other)).select("id", "unit", "a", "b")
    return nearest("a", "b").union(nearest("b", "a")).distinct().join(units, ["id", "unit"]).select("id", "unit", "text", "a", "b")


def judged_pairings(pairs: DataFrame, cells: DataFrame) -> DataFrame | Refusal:
    """``pairs`` (a, b) that the cross-tab cells(a, b, v) do not bear out, with: laggard, within, position, levels, leader, v, leader_v.

    A label is a laggard in the profile of the other when it ranks behind the third and behind the half of at least three levels; levels
    that never meet count with 0. First a is looked for among the levels of b's profile, then b among those of a's. A label in both
    dimensions is no pairing, nor are labels that the cross-tab does not have. A cross-tab of too many cells is refused.
    """
    size = cells.agg(F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b")).first()
    if size["a"] * size["b"] > LIMITS.crosstab_cells:
        return Refusal(f"a cross-tab of {size['a']} by {size['b']}: over {LIMITS.crosstab_cells} cells")
    # All levels of both, of which there are at most crosstab_cells pairs.
    grid = cells.select("a").distinct().join(F.broadcast(cells.groupBy().agg(F.collect_set("b").alias("bs")))).select("a", F.explode("bs").alias("b"))
    grid = grid.join(cells, ["a", "b"], "left").select("a", "b", F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"))

    def placed(one: str, other: str) -> DataFrame:
        w = Window.partitionBy(other)
        order = w.orderBy(F.desc("v"), one)
        rows = grid.withColumns({"position": F.row_number().over(order), "levels": F.count("*").over(w), "leader": F.first(one).over(order), "leader_v": F.first("v").over(order)})
        late = (F.col("levels") >= 3) & (F.col("position") > F.greatest(F.lit(3), F.floor((F.col("levels") + 1) / 2)))
        return rows.filter(late).select("a", "b", F.struct(F.col(one).alias("laggard"), F.col(other).alias("within"), "position", "levels", "leader", "v", "leader_v").alias(f"_{one}"))

    out = pairs.filter("a <> b").join(grid.select("a", "b"), ["a", "b"], "left_semi").join(placed("a", "b"), ["a", "b"], "left").join(placed("b", "a"), ["a", "b"], "left")
    return out.withColumn("_x", F.coalesce("_a", "_b")).filter("_x IS NOT NULL").select(*pairs.columns, "_x.*")


def pairing_claims(lines: DataFrame, df: DataFrame, a: str, b: str, value: str | None = None) -> DataFrame | Refusal:
    """Sentences of lines(id, text) that pair levels of ``a`` and ``b`` which hardly meet, by rows or the sum of ``value``."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg((F.sum(value) if value else F.count("*")).cast("double").alias("v"))
    labels = lambda c: cells.select(F.col(c).alias("label")).distinct()
    return judged_pairings(claimed_pairs(lines, labels("a"), labels("b")), cells)
