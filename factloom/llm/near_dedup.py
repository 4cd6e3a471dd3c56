"""Near-duplicate documents by bottom-k sketches of one hash function.

A text's words (ASCII lower case, ASCII white space) give its set of distinct w-word shingles, hashed to 64 bits by keyed hashes of the
words; sets are made again where they are needed rather than written (they would take twice the corpus's room). Equal sets are one class from the start, and one set of each is compared. A set's sketch
retains its k least values of one function of a shingle: a byte for how common it is, by a counting table of fixed size over
all documents, then 56 bits of its hash. With k = n - ceil(0.8 n) + 1, two sets of similarity 0.8 or more share a
retained value, whatever the function: no link can be missed. The inverted lists of retained values generate overlaps.

Short lists give all their pairs. A longer list is compared with hubs, not with itself: its least member first, then, while it still
holds several components, one member of each with one of the largest, then growing shares of the members outside its largest component, until all of those have been hubs: of two components' members
one is outside the largest, so no pair is left out. A pair that shares several long lists is met in the first of them only. Each pair is first
estimated on the sketch of the union: below the smaller of the two sketches' ends both are known in full, so what they share there and
what is left of either beyond bounds the intersection, and pairs that cannot reach the threshold are dropped before any set is
fetched. The others are verified on full sets, by a second, independent hash. A hub with many partners is dealt to several tasks, each with its set.
Links are joined into components in Spark. Sides that grow with the corpus are merge-joined at every size, never broadcast.

Null, empty and blank texts have an empty set, link with nothing and stay; so does a row of a null id. Repeated rows are equal
sets; rows of one id and different texts are linked each by its own text. Ids may be of any type that has an order. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import chunks, row_key, texts, written
from .components import components, joined

SLOT_BITS, SHORT_LIST, PARTNERS, EARLIER = 20, 12, 256, 16
MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts_: list[str], shingle: int, lane: int = 0, labels: bool = False) -> tuple[list[np.ndarray], list[bytes | None]]:
    """The sorted distinct hashes of each text's shingles, by the words' first or second code (``lane``); with ``labels`` also a digest
    of each set by both codes. The words of all the texts are coded together."""
    found = [words.split(t.encode("utf-8", "surrogatepass").lower()) for t in texts_]
    codes = words.codes(list(chain.from_iterable(found)))
    sets, made, at = [], [], 0
    for w in found:
        n, width = len(w), min(shingle, len(w))
        if not n:
            sets.append(np.empty(0, np.uint64))
            made.append(None)
            continue
        both = [hashed(codes[k][at : at + n], width) for k in ((0, 1) if labels else (lane,))]
        at += n
        if labels:
            s, first = np.unique(both[0], return_index=True)
            made.append(hashlib.blake2b(s.tobytes() + both[1][first].sum().tobytes(), digest_size=16).digest())
        else:
            s = np.unique(both[0])
        sets.append(s)
    return sets, made


def hashed(code: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` neighbouring words."""
    total = np.full(len(code) - width + 1, width, np.uint64)
    for k in range(width):
        total += code[k : k + len(total)] * np.uint64(MULTIPLIERS[k % 6] + 2 * (k // 6))
    return mixed(total)


def in_parts(values: list[str], shingle: int, lane: int = 0) -> Iterator[np.ndarray]:
    for part in chunks(values):
        yield from shingle_sets(part, shingle, lane)[0]


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _describe(shingle: int, kind: T.DataType):
    """row, doc_id, n_shingles and class of each row; then, as rows of their own, what the task counted in each block of slots."""
    from pyspark.sql.pandas.types import to_arrow_type

    names = ["row", "doc_id", "n_shingles", "label", "part", "counts"]
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = np.zeros(1 << SLOT_BITS, np.int32)
        for b in batches:
            n, label = [], []
            for part in chunks(b.column("text").to_pylist()):
                sets, made = shingle_sets(part, shingle, labels=True)
                n += map(len, sets)
                label += made
                counted += np.bincount(slot(np.concatenate(sets)), minlength=len(counted)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(label, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
        for k in range(16):
            part = np.minimum(counted[k << SLOT_BITS - 4 : k + 1 << SLOT_BITS - 4], 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, id_type), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), pa.array([part.tobytes()])], names=names)

    return run


def _add_up(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SLOT_BITS - 4, np.int64)
    for b in batches:
        for raw in b.column("counts"):
            total += np.frombuffer(raw.as_py(), np.uint8)
    # Orders of magnitude in eighths are order enough, and one byte.
    level = np.minimum(255, (8 * np.log2(np.maximum(total, 1))).astype(np.int64)).astype(np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()])], names=["part", "levels"])


def retained(s: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The sketch: the k least values of a set, in order."""
    k = len(s) - -(-percent * len(s) // 100) + 1
    return np.sort((levels[slot(s)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)))[:k]


def _sketches(shingle: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            sets = list(in_parts(b.column("text").to_pylist(), shingle))
            made = [retained(s, levels, percent).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(made, pa.binary())], names=["row", "n", "sketch"])

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each retained value of a sketch, with its place there."""
    for b in batches:
        raws = b.column("sketch").to_pylist()
        sizes = np.array([len(raw) // 8 for raw in raws], np.int64)
        at = pa.array(np.repeat(np.arange(len(raws)), sizes))
        pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raws), np.int64)), pa.array(pos.astype(np.int32)), b.column("node").take(at), b.column("n").take(at)], names=["value", "pos", "node", "n"])


def possible(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, percent: int) -> bool:
    """Union-sketch estimate as a bound: whether sets of these sketches and sizes can reach the threshold."""
    end = min(a[-1], b[-1])
    both = len(np.intersect1d(a, b, assume_unique=False))
    most = both + min(n_a - np.searchsorted(a, end, "right"), n_b - np.searchsorted(b, end, "right"))
    return 100 * most >= percent * (n_a + n_b - most)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union on the full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _compare(percent: int, shingle: int):
    """Rows sorted by hub and share, the hub's own first: the pairs that pass, on sketches or, with ``shingle``, on full sets of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, mine, size = None, None, 0
        for b in batches:
            left, right = [], []
            raw = b.column("data").to_pylist()
            sets = in_parts(raw, shingle, 1) if shingle else (np.frombuffer(x, np.uint64) for x in raw)
            for h, other, n, s in zip(b.column("hub").to_pylist(), b.column("node").to_pylist(), b.column("n").to_pylist(), sets, strict=True):
                if h == other:
                    hub, mine, size = h, s, n
                elif h == hub and (similar(mine, s, percent) if shingle else possible(mine, s, size, n, percent)):
                    left.append(h)
                    right.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _passing(pairs: DataFrame, data: DataFrame, percent: int, shingle: int = 0) -> DataFrame:
    """The pairs (hub, node) that pass, as (a, b). ``data``: node, n, data. A hub's partners are dealt to shares of about ``PARTNERS``."""
    shares = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("shares"))
    mine = shares.select("hub", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("hub").alias("node"))
    others = pairs.hint("merge").join(shares, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share"), "node")
    rows = others.union(mine).hint("merge").join(data, "node").repartition("hub", "share").sortWithinPartitions("hub", "share", F.col("hub") != F.col("node"))
    return rows.select("hub", "node", "n", "data").mapInArrow(_compare(percent, shingle), "a long, b long")


def _links(pairs: DataFrame, sketches: DataFrame, sources: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Verified links among ``pairs`` (hub, node): those the union sketch leaves, on full sets."""
    left = written(_passing(pairs, sketches, percent).toDF("hub", "node"), "estimated")
    return written(_passing(left, sources, percent, shingle), "verified")


def _judged(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, n_shingles, component_id and kept of each row."""
    spark = docs.sparkSession
    base = texts(docs, id_col, text_col).withColumn("row", row_key("doc_id", "text"))
    kind = base.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("row", T.StringType()), T.StructField("doc_id", kind), T.StructField("n_shingles", T.LongType()), T.StructField("label", T.BinaryType()),
        T.StructField("part", T.IntegerType()), T.StructField("counts", T.BinaryType()),
    ])
    described = written(base.mapInArrow(_describe(shingle, kind), schema), "sets")
    rows = described.filter("part IS NULL").select("row", "doc_id", "n_shingles", "label")
    parts = described.filter("part IS NOT NULL").select("part", "counts").groupBy("part").applyInArrow(_add_up, "part int, levels binary")
    levels = b"".join(r["levels"] for r in sorted(parts.collect(), key=lambda r: r["part"])) or bytes(1 << SLOT_BITS)
    shared = spark.sparkContext.broadcast(levels)  # one byte a slot: 1 MB, whatever the corpus

    known = rows.filter("label IS NOT NULL AND doc_id IS NOT NULL")
    classes = known.groupBy("label").agg(F.min("doc_id").alias("least_id"), F.min("row").alias("row"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbered as it is written
    one = classes.select("row", "node")
    sketches = base.select("row", "text").mapInArrow(_sketches(shingle, percent, shared), "row string, n long, sketch binary").filter("n > 0")
    sketches = written(sketches.hint("merge").join(one, "row").select("node", "n", "sketch"), "sketches")
    entries = sketches.mapInArrow(_entries, "value long, pos int, node long, n long")
    lists = written(entries.groupBy("value").agg(F.count("*").alias("size"), F.min("n").alias("least_n")).filter("size > 1").drop("size"), "values")
    # A pair is met in the list of the first value the two share, where what follows must still reach the needed overlap.
    # A member that cannot do so even with the list's smallest admissible partner leaves the list.
    smallest = F.greatest(F.col("least_n"), F.ceil(F.col("n") * percent / 100.0))
    able = (F.col("n") - F.col("pos")) * (100 + percent) >= percent * (F.col("n") + smallest)
    able = written(entries.hint("merge").join(lists, "value").filter(able).drop("least_n"), "members")
    lists = written(able.groupBy("value").agg(F.count("*").alias("size"), F.min("node").alias("hub")).filter("size > 1"), "values")
    members = written(able.hint("merge").join(lists, "value"), "lists")
    fits = (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")) & (F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) * (100 + percent) >= percent * (F.col("a.n") + F.col("b.n")))
    short = members.filter(F.col("size") <= SHORT_LIST).select("value", "node", "n", "pos")
    pairs = short.alias("a").hint("merge").join(short.alias("b"), (F.col("a.value") == F.col("b.value")) & (F.col("a.node") < F.col("b.node")) & fits).select(F.col("a.node").alias("hub"), F.col("b.node").alias("node"))
    # A member's first long lists: a pair that shares one of them before this list is met there.
    firsts = F.slice(F.array_sort(F.collect_list(F.struct("pos", "value")).over(Window.partitionBy("node"))), 1, EARLIER)  # of one sketch
    earlier = F.transform(F.filter(firsts, lambda x: x["pos"] < F.col("pos")), lambda x: x["value"])
    long = written(members.filter(F.col("size") > SHORT_LIST).select("value", "node", "n", "pos", "hub", earlier.alias("earlier")), "long-lists")
    pairs = written(pairs.union(long.filter((F.size("earlier") == 0) & (F.col("hub") != F.col("node"))).select("hub", "node")).distinct(), "pairs")
    sketch_rows = sketches.select("node", "n", F.col("sketch").alias("data")).dropDuplicates(["node"])
    candidates = pairs.select(F.col("hub").alias("node")).union(pairs.select("node")).union(long.select("node")).distinct().hint("merge").join(one, "node")
    sources = base.select("row", F.col("text").alias("data")).hint("merge").join(candidates, "row").select("node", F.lit(0).cast("long").alias("n"), "data").dropDuplicates(["node"])
    sources = written(sources, "candidates")
    links = _links(pairs, sketch_rows, sources, percent, shingle)
    found = components(links)
    done, sparing, hubs = pairs, True, 8
    while True:  # long lists that still hold several components; in the end all outside the largest have been hubs, so it ends
        placed = long.hint("merge").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        by_value = placed.groupBy("value", "component").agg(F.count("*").alias("share"))
        several = by_value.groupBy("value").agg(F.count("*").alias("k"), F.max(F.struct("share", "component"))["component"].alias("largest"), (F.sum("share") - F.max("share")).alias("outside"))
        placed = written(placed.hint("merge").join(several.filter("k > 1").drop("k"), "value"), "open-lists")
        most = placed.agg(F.max("outside")).first()[0]
        if most is None:
            break
        if sparing:  # one member of each component with one of the largest: few pairs that join most
            one = F.min(F.struct(F.xxhash64("node").alias("order"), "node", "n", "pos", "earlier")).alias("m")
            others = placed.groupBy("value", "component", "largest").agg(one).select("value", "component", "largest", "m.*")
            chosen = others.filter(F.col("component") == F.col("largest"))
        else:  # about ``hubs`` members of a list from outside its largest component, or all of them, with all members of others
            share = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) * F.col("outside") < F.lit(hubs << 20)
            others, chosen = placed, placed.filter((F.col("component") != F.col("largest")) & ((F.col("outside") <= hubs) | share))
        more = (
            others.alias("a")
            .hint("merge")
            .join(chosen.alias("b"), (F.col("a.value") == F.col("b.value")) & (F.col("a.component") != F.col("b.component")) & fits & ~F.arrays_overlap("a.earlier", "b.earlier"))
            .select(F.least("a.node", "b.node").alias("hub"), F.greatest("a.node", "b.node").alias("node"))
            .distinct()
        )
        more = written(more.hint("merge").join(done, ["hub", "node"], "left_anti"), "pairs")
        if more.head(1):
            done = done.union(more)
            new = _links(more, sketch_rows, sources, percent, shingle)
            if new.head(1):
                found = joined(found, new)
        elif not sparing and most <= hubs:
            break  # all members outside the largest component of every open list have been hubs: all pairs are settled
        if not sparing:
            hubs *= 8
        sparing = False
    placed = classes.hint("merge").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    ids = written(placed.select("label", "component").hint("merge").join(least, "component").select("label", "component_id"), "components")
    out = rows.hint("merge").join(ids, "label", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("row", "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (least doc_id reachable), kept."""
    return _judged(docs, shingle, percent, id_col, text_col).drop("row")


def representatives(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one document stays for each component, with all their columns."""
    gone = _judged(docs, shingle, percent, id_col, text_col).filter("NOT kept").select("row").distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("doc_id"), text.alias("text")).select("_row", row_key("doc_id", "text").alias("row"))
    return rows.hint("merge").join(gone, "row", "left_anti").select("_row.*")
