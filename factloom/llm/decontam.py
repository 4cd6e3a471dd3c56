"""Benchmark decontamination by SimHash of item-sized windows; DataFrame operations only.

Words are the lower-cased runs of letters (with their combining marks) and digits; a shingle is five words (a shorter item is one shingle). A window of an
item's size in words is similar to it when their bags of shingles have a weighted Jaccard similarity of 0.8 or more.

Windows are laid where they can be similar. Moving a window to the right until its first shingle is one of the item's loses
nothing they share, so only windows that begin at such a place (or end with the document) need a test; of them, those
whose places that hold the item's shingles are too few for the threshold are left out. Both steps are exact: if any window of
a document is similar, one that is laid is.

Windows and items get 64-bit SimHash fingerprints over their features: a shingle with its number of occurrence, so that the
weighted similarity of bags is the similarity of feature sets. ``blocks`` is the multi-index: an item size has a radius and one
block more, so by the pigeonhole principle every fingerprint pair within the radius agrees in a block. The radius follows from
the item's length: for its count of shingles the largest angle that the threshold allows, as a share of 64 bits, and
``DEVIATIONS`` standard deviations more (items of under five shingles must be equal: radius 0). At most about one in 10,000 of the
windows exactly at the threshold lies beyond. A window meets only the items it is laid for, so there are no more pairs than windows laid, however many items
are of one length. Pairs that the blocks yield are verified by exact similarity.

Null and empty texts and items hold nothing and are clean. Repeated rows share their result. Documents shorter
than an item are one window. Ties go to the item that sorts first. Empty tables give empty results, or clean documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, written

SHINGLE, THRESHOLD, BITS, DEVIATIONS = 5, 0.8, 64, 5.5
#: The benchmark's shingles are broadcast up to this count (about 40 bytes each) and shuffled beyond; results are the same.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def shingles(df: DataFrame, array: str, keep: list[str], width: int = SHINGLE) -> DataFrame:
    """A row per shingle of ``array``: keep, pos, shingle (hash). Shifted copies are zipped, so the work stays in generated code."""
    n = F.size(array)
    shifted = [F.slice(array, k + 1, F.greatest(n - (width - 1), F.lit(1))).alias(f"w{k}") for k in range(width)]
    row = F.posexplode(F.arrays_zip(*shifted)).alias("pos", "w")
    return df.filter(n > 0).select(*keep, row).select(*keep, "pos", F.xxhash64(*[F.coalesce(f"w.w{k}", F.lit("")) if k < width else F.lit("") for k in range(SHINGLE)]).alias("shingle"))


def simhash(df: DataFrame, key: list[str]) -> DataFrame:
    """key, size (shingles) and fingerprint. Two bits' counts share one sum: each lane holds 32 bits."""
    half = BITS // 2
    lanes = [F.sum(F.shiftrightunsigned("shingle", j).bitwiseAND(F.lit((1 << half) | 1))).alias(f"s{j}") for j in range(half)]
    sums = df.groupBy(*key).agg(F.count("*").alias("size"), *lanes)

    def bit(count: Column, j: int) -> Column:
        return F.when(2 * count > F.col("size"), F.lit((1 << j) if j < 63 else -(1 << 63))).otherwise(F.lit(0))

    low = [bit(F.col(f"s{j}").bitwiseAND(F.lit((1 << half) - 1)), j) for j in range(half)]
    high = [bit(F.shiftrightunsigned(f"s{j}", half), j + half) for j in range(half)]
    return sums.select(*key, "size", reduce(Column.bitwiseOR, [*low, *high]).alias("fingerprint"))


def with_radius(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with radius: bits by which fingerprints of an item of ``item_words`` words and of a similar window may differ."""
    n = f"greatest(1, item_words - {SHINGLE - 1})"
    overlap = f"ceil({threshold / (1 + threshold)!r}D * (m + {n}) - 1e-9D)"  # what sets of m and n features must share
    feasible = f"filter(sequence(cast(ceil({threshold!r}D * {n} - 1e-9D) AS int), {n}), m -> {overlap} <= m)"
    cosine = f"array_min(transform({feasible}, m -> {overlap} / sqrt(m * {n})))"
    p = F.acos(F.least(F.lit(1.0), F.expr(cosine))) / 3.141592653589793
    return df.withColumn("radius", F.least(F.floor(BITS * p + DEVIATIONS * F.sqrt(BITS * p * (1 - p))), F.lit(BITS - 1)).cast("int"))


def blocks(df: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each of the radius + 1 blocks that the fingerprint's bits are dealt to: the multi-index."""
    at = lambda k: f"cast(({k}) * {BITS} div (radius + 1) AS int)"
    width = f"({at('k + 1')} - {at('k')})"
    mask = f"CASE WHEN {width} = {BITS} THEN -1L ELSE shiftleft(1L, {width}) - 1L END"
    values = F.expr(f"transform(sequence(0, radius), k -> shiftrightunsigned(fingerprint, {at('k')}) & ({mask}))")
    return df.select(*keep, F.posexplode(values).alias("block", "value"))


def features(df: DataFrame, key: list[str]) -> DataFrame:
    """key and shingle -> a row for each occurrence, with a hash of its own."""
    bag = df.groupBy(*key, "shingle").agg(F.count("*").alias("n"))
    nth = bag.select(*key, "shingle", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth"))
    return nth.select(*key, F.when(F.col("nth") == 1, F.col("shingle")).otherwise(F.xxhash64("shingle", "nth")).alias("shingle"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """A row per contaminated row and item: key, item_id, similarity (of the best window)."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("iw")).filter(F.size("iw") > 0)
    items = items.withColumn("item_words", F.size("iw"))
    item_rows = written(shingles(items, "iw", ["item_id", "item_words"]), "items")
    item_features = written(features(item_rows, ["item_id", "item_words"]), "item-features")
    kinds = item_rows.select("shingle", "item_id", "item_words").distinct()
    bounded = F.broadcast if item_rows.count() <= BROADCAST_ROWS else (lambda df: df)

    base = docs.select(row_key(id_col, text_col).alias("key"), words(F.col(text_col)).alias("dw")).withColumn("doc_words", F.size("dw"))
    hits = shingles(base, "dw", ["key", "doc_words"]).join(bounded(kinds), "shingle")
    for width in [r[0] for r in kinds.filter(F.col("item_words") < SHINGLE).select("item_words").distinct().collect()]:  # at most four
        hits = hits.union(shingles(base, "dw", ["key", "doc_words"], width).join(bounded(kinds.filter(F.col("item_words") == width)), "shingle"))
    # Per document and item: the document's places that hold one of the item's shingles. A window has m shingles, the item n.
    n, m = f"greatest(1, item_words - {SHINGLE - 1})", f"greatest(1, least(item_words, doc_words) - {SHINGLE - 1})"
    found = hits.groupBy("key", "item_id", "item_words", "doc_words").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    found = found.select("key", "item_id", "item_words", "places", F.expr(n).alias("n"), F.greatest(F.col("doc_words") - F.col("item_words"), F.lit(0)).alias("latest"), F.expr(f"cast(ceil({threshold / (1 + threshold)!r}D * ({n} + {m}) - 1e-9D) AS int)").alias("need"))
    starts = "transform(filter(sequence(0, greatest(0, size(places) - need)), i -> get(places, i + need - 1) - places[i] <= n - 1), i -> least(places[i], latest))"
    seeds = found.filter(F.size("places") >= F.col("need")).select("key", "item_id", "item_words", F.explode(F.expr(starts)).alias("start")).distinct()
    seeds = written(seeds, "windows")  # a window and the item it is laid for
    lists = seeds.groupBy("key").agg(F.collect_set(F.struct("item_words", "start")).alias("windows"))
    cut = (
        base.join(lists, "key")
        .dropDuplicates(["key"])
        .select("key", "dw", F.explode("windows").alias("w"))
        .select("key", F.col("w.item_words").alias("item_words"), F.col("w.start").alias("start"), F.slice("dw", F.col("w.start") + 1, F.col("w.item_words")).alias("ww"))
    )
    key = ["key", "item_words", "start"]
    window_features = written(features(shingles(cut, "ww", key), key), "window-features")
    prints = with_radius(simhash(window_features, key), threshold)
    item_prints = with_radius(simhash(item_features, ["item_id", "item_words"]), threshold)
    index = blocks(item_prints, ["item_id", "item_words", F.col("size").alias("item_size"), F.col("fingerprint").alias("item_print"), "radius"])
    near = (
        blocks(prints.join(seeds, key), [*key, "item_id", "size", "fingerprint"])
        .join(index, ["item_id", "item_words", "block", "value"])
        .filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= F.col("radius"))
        .select(*key, "size", "item_id", "item_size")
        .distinct()
    )
    common = near.join(window_features, key).join(item_features, ["item_id", "item_words", "shingle"]).groupBy(*key, "item_id", "size", "item_size").agg(F.count("*").alias("both"))
    similarity = F.col("both") / (F.col("size") + F.col("item_size") - F.col("both"))
    return common.withColumn("similarity", similarity).filter(F.col("similarity") >= threshold).groupBy("key", "item_id").agg(F.max("similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, kept (no item found), n_items, item_id (the most similar), similarity."""
    found = contamination(docs, benchmark, threshold, id_col, text_col)
    best = found.groupBy("key").agg(F.count("*").alias("n_items"), F.min(F.struct(-F.col("similarity"), "item_id")).alias("best"))
    return (
        docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"))
        .join(best, "key", "left")
        .select("doc_id", F.col("best").isNull().alias("kept"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("best.item_id").alias("item_id"), (-F.col("best.col1")).alias("similarity"))
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without a benchmark item, with all their columns."""
    dirty = contamination(docs, benchmark, threshold, id_col, text_col).select("key").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), row_key(id_col, text_col).alias("key"))
    return rows.join(dirty, "key", "left_anti").select("_row.*")
