"""Repeated byte strings by longest-previous-factor arrays in suffix order.

Every window of ``length`` bytes has an anchor: the first of its k-grams of least hash. Equal windows have equal anchors at equal
offsets, and neighbouring windows mostly share one, so a text is cut into records: maximal runs of window
starts with one anchor. Records whose anchor occurs once hold no repeat. Records that are equal in full, by a 128-bit BLAKE2
digest of their bytes, are repeats in full. Records that share an anchor and differ are laid out as text, one of each
content: in a block of them all window starts are put in suffix order (``length`` bytes deep), the common prefixes of
neighbours are measured on the bytes, and the previous and next smaller positions give each start's longest previous factor,
the previous and next larger ones its longest later factor. A start whose factor has ``length`` bytes is a repeat.

A group of more than ``HOT`` different records is split on the way to its blocks: its records are cut into runs of 17, then 5, then 1
neighbouring offsets, each run grouped anew by the bytes that all its windows have in common. At every step groups of one
are done, equal runs are repeats in full, and groups that have become small enough go to their blocks; single windows that share all
bytes are equal. Everything in between is counted by partial aggregates and joins that Spark can split, so a passage
that a third of all documents share is no task's alone.

``remove_repeats`` marks every copy, or, with ``keep_first``, all but the first in order of id and place. Rows are known by id and
text hash; repeated rows share their result, and are repeats of each other (with ``keep_first`` they count as one). Ids of any type
will do. Null, empty and short texts are left alone. Low-entropy texts (one byte over and over) give a record a window, no more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts, written

GRAM, HOT, BLOCK_WINDOWS, WIDTHS = 128, 300, 20_000, (17, 5, 1)
#: Any string of so many bytes that another document holds too has a shared gram among those compared.
PASSAGE = 256
#: Odd bases of two rolling hashes, and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
_tables: dict = {}


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, kept and grown as texts need."""
    if which not in _tables or len(_tables[which][0]) < n:
        size = max(n, 1 << 17)
        made = []
        for b in (BASES[which], INVERSES[which]):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _tables[which] = tuple(made)
    return _tables[which]


class Rolling:
    """Hashes of any stretch of a text in constant time."""

    def __init__(self, data: np.ndarray, which: int = 0):
        if "bytes" not in _tables:
            _tables["bytes"] = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[1]))
        up, self.down = powers(len(data) + 1, which)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_tables["bytes"][data] * up[: len(data)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, n: int) -> np.ndarray:
        return mixed((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def least_positions(h: np.ndarray, window: int) -> np.ndarray:
    """For each window of hashes the position of its first least one, by their upper halves: block-wise running minima from both sides.

    The lower half of each compared value is its position, so a minimum tells where it stands and ties go left.
    """
    n = len(h) - window + 1
    blocks = -(-len(h) // window)
    padded = np.full(blocks * window, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)
    grid = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[window - 1 : window - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def records(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """first and last window start, anchor position and anchor hash of each record; then, with first -1, the further grams of windows of ``PASSAGE`` bytes."""
    h = Rolling(np.frombuffer(data, np.uint8)).every(GRAM)
    first = last = at = np.empty(0, np.int64)
    if len(data) >= length:
        anchors = least_positions(h, length - GRAM + 1)
        cut = np.flatnonzero(np.diff(anchors)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut - 1, [len(anchors) - 1]])
        at = anchors[first]
    more = np.setdiff1d(least_positions(h, PASSAGE - GRAM + 1), at) if len(data) >= PASSAGE else at[:0]
    none = np.full(len(more), -1)
    at = np.concatenate([at, more])
    return np.concatenate([first, none]), np.concatenate([last, none]), at, h[at]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _runs(length: int):
    names = ["doc_id", "h", "first", "last", "at", "anchor", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, where, content = [], [], []
            for i, raw in enumerate(b.column("data").to_pylist()):
                got.append(records(raw, length))
                where.append(np.full(len(got[-1][0]), i))
                content += [digest(raw[a : z + length]) if a >= 0 else None for a, z in zip(got[-1][0].tolist(), got[-1][1].tolist(), strict=True)]
            if got:
                first, last, at, anchor = map(np.concatenate, zip(*got, strict=True))
                rows = pa.array(np.concatenate(where))
                outside = first < 0
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(rows), b.column("h").take(rows), pa.array(first, pa.int32(), mask=outside), pa.array(last, pa.int32(), mask=outside), pa.array(at, pa.int32()), pa.array(anchor.view(np.int64)), pa.array(content, pa.binary())],
                    names=names,
                )

    return run


def _pieces(length: int):
    """Lays out the wanted records of a text."""
    names = ["g", "doc_id", "h", "first", "at", "c", "m", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (raw, wanted) in enumerate(zip(b.column("data").to_pylist(), b.column("wanted").to_pylist(), strict=True)):
                rows = pa.array(np.full(len(wanted), i))
                columns = [pa.array([r[k] for r in wanted], kind) for k, kind in (("first", pa.int32()), ("at", pa.int32()), ("c", pa.int64()), ("m", pa.int64()))]
                data = pa.array([raw[r["first"] : r["last"] + length] for r in wanted], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r["anchor"] for r in wanted], pa.int64()), b.column("doc_id").take(rows), b.column("h").take(rows), *columns, data], names=names)

    return run


def _cut(length: int, width: int):
    """Cuts pieces into runs of ``width`` offsets from their anchor, under the hash of what the run's windows have in common."""
    import xxhash

    names = ["g", "content", "doc_id", "h", "first", "at", "c", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, g, content, first, data = [], [], [], [], []
            for i, (start, at, raw) in enumerate(zip(b.column("first").to_pylist(), b.column("at").to_pylist(), b.column("data").to_pylist(), strict=True)):
                end = start + len(raw) - length  # the last window start
                for k in range((at - end) // width, (at - start) // width + 1):  # offsets k * width and on, before the anchor
                    a, z = max(start, at - k * width - width + 1), min(end, at - k * width)
                    if a > z:
                        continue
                    piece = raw[a - start : z - start + length]
                    core = raw[at - k * width - start : at - k * width - start + length - width + 1]
                    row.append(i), first.append(a), data.append(piece), content.append(digest(piece))
                    g.append(xxhash.xxh3_64_intdigest(core) - (1 << 63))
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(content, pa.binary()), b.column("doc_id").take(rows), b.column("h").take(rows), pa.array(first, pa.int32()), b.column("at").take(rows), b.column("c").take(rows), pa.array(data, pa.binary())], names=names)

    return run


def nearest_smaller(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place in suffix order the common prefix with the nearest place before it whose position is smaller (0 if none).

    ``common[i]`` is the common prefix of places i - 1 and i. All places jump along each other's pointers at once.
    """
    to, least = np.arange(len(position)) - 1, common.copy()
    open_ = np.flatnonzero(to >= 0)
    while len(open_):
        open_ = open_[position[to[open_]] > position[open_]]
        at = to[open_]
        least[open_] = np.minimum(least[open_], least[at])
        to[open_] = to[at]
        open_ = open_[to[open_] >= 0]
    least[to < 0] = 0
    return least


def factors(block: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's window starts: each one's text, and the lengths (at most ``length``) of its longest previous and longest later factor."""
    joined = np.frombuffer(b"".join(block), np.uint8)
    ends = np.cumsum([len(x) for x in block])
    starts = np.concatenate([np.arange(e - len(x), e - length + 1) for x, e in zip(block, ends, strict=True)])
    view = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(joined, length)[starts])
    order = np.argsort(view.view(f"S{length}").ravel(), kind="stable")  # suffix order; equal ones by position
    view = view[order]
    differ = view[1:] != view[:-1]
    common = np.zeros(len(order) + 1, np.int64)
    common[1:-1] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    out = []
    for position in (order, -order):
        ahead = nearest_smaller(position, common[:-1])
        behind = nearest_smaller(position[::-1], common[1:][::-1])[::-1]
        found = np.empty(len(order), np.int64)
        found[order] = np.maximum(ahead, behind)
        out.append(found)
    return np.repeat(np.arange(len(block)), [len(x) - length + 1 for x in block]), *out


def stretches(marked: np.ndarray, first: int, length: int) -> list[tuple[int, int]]:
    """The byte intervals that runs of marked starts cover."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.view(np.int8), [0]])))
    return [(first + int(a), first + int(z) - 1 + length) for a, z in zip(edge[::2], edge[1::2], strict=True)]


def _blocks(length: int, keep_first: bool, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (doc_id, h, first, c, bytes) of whole groups, and of the group still open

        def solved(rows: list[tuple]):
            d, h, s, e = [], [], [], []
            of, earlier, later = factors([r[4] for r in rows], length)
            marked = earlier >= length if keep_first else (earlier >= length) | (later >= length)
            cuts = np.searchsorted(of, np.arange(len(rows) + 1))
            for k, (doc, key, first, c, _) in enumerate(rows):
                if keep_first or c == 1:  # of several equal ones all are marked already
                    for a, z in stretches(marked[cuts[k] : cuts[k + 1]], first, length):
                        d.append(doc), h.append(key), s.append(a), e.append(z)
            return pa.RecordBatch.from_arrays([pa.array(d, kind), pa.array(h, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["doc_id", "h", "s", "e"])

        open_group, windows = None, 0
        for b in batches:
            for g, *row in zip(*[b.column(c).to_pylist() for c in ("g", "doc_id", "h", "first", "c", "data")], strict=True):
                if g != open_group:
                    if windows >= BLOCK_WINDOWS:  # a group has at most HOT records: bounded
                        yield solved(held)
                        held, windows = [], 0
                    open_group = g
                held.append(tuple(row))
                windows += len(row[4]) - length + 1
        if held:
            yield solved(held)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        removed, spans, sha = [], [], []
        for raw, found in zip(b.column("data"), b.column("found").to_pylist(), strict=True):
            raw = raw.as_py()
            out, at, n = hashlib.sha256(), 0, 0
            end = -1
            for r in sorted((r["s"], r["e"]) for r in found or ()):
                if r[0] > end:  # touching stretches are one run
                    n += 1
                    out.update(raw[max(end, 0) : r[0]])
                    at += r[1] - r[0]
                    end = r[1]
                elif r[1] > end:
                    at += r[1] - end
                    end = r[1]
            out.update(raw[max(end, 0) :])
            removed.append(at)
            spans.append(n)
            sha.append(out.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), b.column("n_shared")],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"],
        )


def repeated_stretches(base: DataFrame, length: int, keep_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """doc_id, h, s, e: byte intervals made of repeated windows; and doc_id, h, n_shared: grams that other documents hold too. ``base`` has doc_id, h and data."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = base.schema["doc_id"].dataType
    made = lambda *rest: T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, t) for n, t in rest]])
    long_, int_, binary = T.LongType(), T.IntegerType(), T.BinaryType()
    long = base.filter(F.length("data") >= min(length, PASSAGE))
    runs = written(long.mapInArrow(_runs(length), made(("h", long_), ("first", int_), ("last", int_), ("at", int_), ("anchor", long_), ("content", binary))), "records")
    doc = F.struct("doc_id", "h")
    many = runs.groupBy("anchor").agg(F.count("first").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"), (F.min(doc) != F.max(doc)).alias("across"))
    many = written(many.filter("n > 1 OR across").select("anchor", "n", (F.col("lo") == F.col("hi")).alias("equal"), "across"), "anchors")
    shared = written(runs.hint("merge").join(many, "anchor"), "shared")
    grams = shared.filter("across").groupBy("doc_id", "h").agg(F.count("*").alias("n_shared"))
    whole = lambda df: df.select("doc_id", "h", F.col("first").alias("s"), (F.col("last") + length).alias("e"))

    def copies(df: DataFrame, of: list[str], carry: list[str]) -> tuple[DataFrame, DataFrame]:
        """A row per content: how often it occurs, and its first place with ``carry``; and the rows to be removed with all their windows."""
        place = ["doc_id", "h", "first"]
        counts = written(df.groupBy(*of).agg(F.count("*").alias("again"), F.min(F.struct(*place, *carry)).alias("one")), "contents")
        twice = df.hint("merge").join(counts.filter("again > 1").select(*of, F.struct(*[f"one.{c}" for c in place]).alias("one")), of)
        return counts.select(*of, "again", "one.*"), twice.filter(F.struct(*place) != F.col("one")) if keep_first else twice

    rows = shared.filter("first IS NOT NULL AND n > 1")
    counts, again = copies(rows, ["anchor", "content"], ["last", "at"])
    out = whole(again)
    firsts = counts.hint("merge").join(many.filter("NOT equal").select("anchor"), "anchor").withColumnRenamed("again", "c")
    sizes = written(firsts.groupBy("anchor").agg(F.count("*").alias("m")), "sizes")
    wanted = (
        firsts.hint("merge").join(sizes, "anchor")
        .groupBy(F.col("doc_id").alias("w_id"), F.col("h").alias("w_h"))
        .agg(F.collect_list(F.struct("anchor", "first", "last", "at", "c", "m")).alias("wanted"))  # records of one text
    )
    laid = long.hint("merge").join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h"))).dropDuplicates(["doc_id", "h"]).select("doc_id", "h", "data", "wanted")
    piece = made(("h", long_), ("first", int_), ("at", int_), ("c", long_), ("m", long_), ("data", binary)).add("g", long_)
    pieces = written(laid.mapInArrow(_pieces(length), T.StructType([piece["g"], *piece.fields[:-1]])), "pieces")
    small = [pieces.filter(F.col("m") <= HOT)]
    hot = pieces.filter(F.col("m") > HOT)
    for width in WIDTHS:
        if not hot.head(1):
            break
        fields = made(("h", long_), ("first", int_), ("at", int_), ("c", long_), ("data", binary)).fields
        units = hot.mapInArrow(_cut(length, width), T.StructType([T.StructField("g", long_), T.StructField("content", binary), *fields]))
        units = written(units.withColumn("last", F.col("first") + F.length("data") - length), "runs")
        counts, again = copies(units, ["g", "content"], ["at", "c", "data"])
        out = out.union(whole(again if keep_first else again.filter("c = 1")))
        sizes = written(counts.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1"), "sizes")
        left = counts.withColumn("c", F.greatest("c", "again")).hint("merge").join(sizes, "g")
        left = written(left.select("g", "doc_id", "h", "first", "at", "c", "m", "data"), "left")
        small.append(left.filter(F.col("m") <= HOT))
        hot = left.filter(F.col("m") > HOT)
    for part in small:
        dealt = part.select("g", "doc_id", "h", "first", "c", "data").repartition("g").sortWithinPartitions("g", "doc_id", "h", "first")
        out = out.union(dealt.mapInArrow(_blocks(length, keep_first, to_arrow_type(kind)), made(("h", long_), ("s", int_), ("e", int_))))
    return written(out, "stretches"), grams


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", keep_first: bool = False) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared (128-byte grams found in other documents too)."""
    base = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("h"), F.encode("text", "utf-8").alias("data"))
    searched = base.dropDuplicates(["doc_id", "h"]) if keep_first else base
    found, grams = repeated_stretches(searched, length, keep_first)
    both = found.select("doc_id", "h", F.struct("s", "e").alias("x"), F.lit(0).cast("long").alias("n")).union(grams.select("doc_id", "h", F.lit(None).cast("struct<s: int, e: int>"), "n_shared"))
    known = both.groupBy(F.col("doc_id").alias("f_id"), F.col("h").alias("f_h")).agg(F.collect_set("x").alias("found"), F.sum("n").alias("n_shared"))  # stretches of one text
    rows = base.hint("merge").join(known, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")), "left")
    rows = rows.select("doc_id", F.length("data").cast("long").alias("n_bytes"), "data", "found", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
    names = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("n_shared", T.LongType())]
    return rows.mapInArrow(_kept, T.StructType([base.schema["doc_id"], *[T.StructField(n, t) for n, t in names]]))
