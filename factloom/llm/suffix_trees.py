"""Repeated word windows by prefix-partitioned suffix trees.

A window is ``length`` consecutive words of one document. Every window has an anchor: the first of its grams of a third of its length
with the least hash. Neighbouring windows mostly share their anchor and form a record, so suffixes travel together.

1. **Prefixes of a gram.** The suffixes that start at anchors are counted by their first gram. A gram that occurs once begins no repeat.
2. **Equal records.** Records that are equal in full (anchor and two 64-bit codes of their words) are one leaf of a tree with many places: all but
   the first place are repeats in full, by aggregates and joins that Spark can split, however many copies there are.
3. **Subtrees.** Different records of one gram are a memory-sized group, and one task builds its two trees on the words themselves: suffixes to the
   right of the anchor in lexicographic order with the common prefixes of neighbours, and those to the left, read backwards. A run of
   neighbours with a common prefix of r words is a node of that depth. A node of depth d on the left and one of depth ``length - d`` on the right
   together are a window d words before the anchor: with two places or more it is a (part of a) maximal repeat, and all places but the first are marked.
4. **Longer prefixes.** A gram with over ``GROUP`` different records is split by prefixes of the whole window (two 64-bit codes): at that depth a group is
   a single node, and aggregates find its first place.

The first place is that of the least doc_id, then start; windows are judged on the input. Rows are known by id and text hash, so rows of one
id with different texts are two documents (in the order of those hashes), repeated rows share their result and do not make each other repeats. A null id
comes before the others. Null and blank texts have no words; short ones no window. Stretches of a few words over and over repeat
within their own text; such records are found where the text is read and sent on as one row a stretch. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as words_
from .common import texts, written
from .substring_dedup import least_positions, mixed, powers

GROUP, CHUNK_ROWS, CHUNK_BYTES = 5000, 20_000, 1 << 20


def gram_of(length: int) -> int:
    return max(1, length // 3)


def _window_codes(code: np.ndarray, n: int, which: int) -> np.ndarray:
    """A code of every n neighbouring words."""
    up, down = powers(len(code) + 1, which)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(code * up[: len(code)], dtype=np.uint64)])
    return mixed((sums[n:] - sums[:-n]) * down[: len(sums) - n])


class Records:
    """The records of some texts together. ``codes``: of their words one after the other; ``sizes``: how many each text has.

    ``text``, ``first``, ``last`` (window starts within the text), ``at`` (place of the anchor) and ``anchor`` (its code) of each; with a second code
    of the words also ``c1`` and ``c2``, codes of all of a record's words, and ``again``: whether an earlier record of the text has the same ones.
    """

    def __init__(self, codes: list[np.ndarray], sizes: np.ndarray, length: int):
        gram, ends = gram_of(length), np.cumsum(sizes)
        begins = ends - sizes
        text = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
        start = np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0), np.maximum(sizes - length + 1, 0)) + begins[text]
        grams = _window_codes(codes[0], gram, 0) if len(start) else np.empty(0, np.uint64)
        anchors = least_positions(grams, length - gram + 1)[start] if len(start) else start
        cut = np.flatnonzero(np.diff(anchors, prepend=-1))  # an anchor lies within its window, so texts differ in theirs
        self.text, first, at = text[cut], start[cut], anchors[cut]
        last = start[np.concatenate([cut[1:], [len(start)]]) - 1] if len(cut) else first
        self.anchor = grams[at]
        self.first, self.last, self.at = first - begins[self.text], last - begins[self.text], at - begins[self.text]
        if len(codes) > 1:
            self.c1, self.c2 = (_stretch_codes(code, first, last + length, k) for k, code in enumerate(codes))
            self.again = np.ones(len(cut), bool)
            self.again[np.unique(mixed(self.c1 ^ mixed(self.c2)) + self.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]] = False


def _stretch_codes(code: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    up, down = powers(len(code) + 1, which)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(code * up[: len(code)], dtype=np.uint64)])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _parts(column: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Place of the first text, and the words of some texts together."""
    at, held, size = 0, [], 0
    for i, raw in enumerate(column):
        data = raw.as_py()
        held.append(words_.split(data))
        size += len(data)
        if size >= CHUNK_BYTES:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def _coded(held: list[list[bytes]], lanes: int = 2) -> tuple[list[np.ndarray], np.ndarray]:
    return words_.codes(list(chain.from_iterable(held)), lanes), np.array([len(w) for w in held], np.int64)


def _grams(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, held in _parts(b.column("data")):
            yield pa.RecordBatch.from_arrays([pa.array(Records(*_coded(held, 1), length).anchor.view(np.int64))], names=["g"])


def _records(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """All records; of neighbouring ones that repeat within their text one row with ``again``, which need not be compared with anything."""
    names = ["g", "c1", "c2", "doc_id", "h", "first", "last", "at", "again"]
    for b in batches:
        for place, held in _parts(b.column("data")):
            r = Records(*_coded(held), length)
            follows = r.again & np.concatenate([[False], r.again[:-1] & (r.text[1:] == r.text[:-1])]) if len(r.text) else r.again
            head = np.flatnonzero(~follows)
            last = r.last[np.concatenate([head[1:], [len(follows)]]) - 1] if len(head) else r.last
            rows = pa.array(place + r.text[head])
            columns = [pa.array(c[head].view(np.int64)) for c in (r.anchor, r.c1, r.c2)] + [b.column("doc_id").take(rows), b.column("h").take(rows)]
            columns += [pa.array(c.astype(np.int32)) for c in (r.first[head], last, r.at[head])] + [pa.array(r.again[head])]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _lay(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The words of the wanted records of a text, one blank between two."""
    names = ["g", "doc_id", "h", "first", "at", "m", "data"]
    for b in batches:
        for i, (raw, wanted) in enumerate(zip(b.column("data"), b.column("wanted").to_pylist(), strict=True)):
            words = words_.split(raw.as_py())
            rows = pa.array(np.full(len(wanted), i))
            columns = [pa.array([r[k] for r in wanted], kind) for k, kind in (("first", pa.int32()), ("at", pa.int32()), ("m", pa.int64()))]
            data = pa.array([b" ".join(words[r["first"] : r["last"] + length]) for r in wanted], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r["g"] for r in wanted], pa.int64()), b.column("doc_id").take(rows), b.column("h").take(rows), *columns, data], names=names)


def depths(group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tree of one side, given by rows of word numbers: their lexicographic order within groups, and each row's common prefix
    with the row before (-1 where a group begins)."""
    order = np.lexsort([*side.T[::-1], group])
    same = side[order[1:]] == side[order[:-1]]
    common = np.where(same.all(axis=1), side.shape[1], np.argmin(same, axis=1)) if side.shape[1] else np.zeros(len(order) - 1, np.int64)
    common = np.where(group[order[1:]] == group[order[:-1]], common, -1)
    return order, np.concatenate([[-1], common])


def nodes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Each row's node of a depth: a run of neighbours whose common prefixes reach it."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def later_places(group: np.ndarray, left: np.ndarray, right: np.ndarray, before: np.ndarray, windows: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Rows by windows: whether a row's window (counted from its first) has an earlier place. ``left``: words before the anchor,
    nearest first; ``right``: words from it on; ``before``: words before the anchor; ``rank``: order of the anchors' places."""
    marked = np.zeros((len(group), int(windows.max(initial=0))), bool)
    right_order, right_common = depths(group, right)
    left_order, left_common = depths(group, left)
    for d in range(left.shape[1] + 1):
        mine = np.flatnonzero((before >= d) & (before - d < windows))
        if len(mine) < 2:
            continue
        a, b = nodes(right_order, right_common, length - d)[mine], nodes(left_order, left_common, d)[mine]
        order = np.lexsort([rank[mine], b, a])
        mine, a, b = mine[order], a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        lead = mine[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = mine[rank[mine] != rank[lead]]
        marked[later, before[later] - d] = True
    return marked


def _dense_ranks(batch: pa.Table, keys: list[str]) -> np.ndarray:
    order = pc.sort_indices(batch, sort_keys=[(k, "ascending") for k in keys], null_placement="at_start").to_numpy()
    rank = np.zeros(len(order), np.int64)
    steps = np.zeros(len(order), bool)
    for k in keys:
        dense = pc.rank(batch.column(k), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        steps[1:] |= dense[1:] != dense[:-1]
    rank[order] = np.cumsum(steps)
    return rank


def _trees(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group: the stretches of repeated windows."""
    held: list[pa.RecordBatch] = []
    wide = length - gram_of(length)

    def solved(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        group, first, at = (table.column(c).to_numpy() for c in ("g", "first", "at"))
        lists = pc.split_pattern(table.column("data").cast(pa.large_binary()), " ").combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        ends = np.asarray(lists.offsets)
        number = np.asarray(lists.values.dictionary_encode().indices)
        ends, number = ends - ends[0], number[: len(number)]
        before = (at - first).astype(np.int64)
        held_words = np.diff(ends)
        windows = held_words - length + 1

        def side(shift: np.ndarray) -> np.ndarray:
            where = before[:, None] + shift[None, :]
            inside = (where >= 0) & (where < held_words[:, None])
            return np.where(inside, number[np.where(inside, ends[:-1, None] + where, 0)], -1)

        marked = later_places(group, side(-1 - np.arange(wide)), side(np.arange(length)), before, windows, _dense_ranks(table, ["doc_id", "h", "at"]), length)
        edge = np.diff(np.pad(marked.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, s = np.nonzero(edge == 1)
        _, e = np.nonzero(edge == -1)
        rows = pa.array(row)
        ids = table.column("doc_id").take(rows).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [_array(ids), _array(table.column("h").take(rows).combine_chunks()), pa.array((first[row] + s).astype(np.int32)), pa.array((first[row] + e - 1 + length).astype(np.int32))], names=["doc_id", "h", "s", "e"]
        )

    rows = 0
    for b in batches:
        g = b.column("g").to_numpy()
        if rows + len(g) > CHUNK_ROWS and held:  # what is complete of the open chunk: groups have at most GROUP rows, so it stays bounded
            table = pa.Table.from_batches([*held, b])
            everything = np.concatenate([*[h.column("g").to_numpy() for h in held], g])
            others = np.flatnonzero(everything != everything[-1])
            cut = int(others[-1]) + 1 if len(others) else 0
            if cut:
                for at, end in _whole_groups(everything[:cut]):
                    yield solved(table.slice(at, end - at))
            held = table.slice(cut).to_batches()
        else:
            held.append(b)
        rows = sum(h.num_rows for h in held)
    if rows:
        table = pa.Table.from_batches(held)
        everything = table.column("g").to_numpy()
        for at, end in _whole_groups(everything):
            yield solved(table.slice(at, end - at))


def _array(column) -> pa.Array:
    return column if isinstance(column, pa.Array) else (pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0))


def _whole_groups(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts at group ends, about ``CHUNK_ROWS`` apart."""
    ends = np.concatenate([np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    at = 0
    for i, end in enumerate(ends):
        if end - at >= CHUNK_ROWS or i == len(ends) - 1:
            yield at, int(end)
            at = int(end)


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every window of a record with the codes of all its words: prefixes of the full depth."""
    for b in batches:
        first = b.column("first").to_numpy()
        for place, held in _parts(b.column("data")):
            codes, sizes = _coded(held)
            n = sizes - length + 1
            row = np.repeat(np.arange(len(held)), n)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = (np.cumsum(sizes) - sizes)[row] + within
            w1, w2 = (_stretch_codes(code, at, at + length, k) for k, code in enumerate(codes))
            rows = pa.array(place + row)
            yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), b.column("doc_id").take(rows), b.column("h").take(rows), pa.array((first[place + row] + within).astype(np.int32))], names=["w1", "w2", "doc_id", "h", "s"])


def repeated_windows(base: DataFrame, length: int) -> DataFrame:
    """doc_id, h, s, e: stretches of words (end exclusive) made of windows that have an earlier place. ``base`` has doc_id, h and data (UTF-8)."""
    made = lambda *rest: T.StructType([base.schema["doc_id"], *[T.StructField(n, t) for n, t in rest]])
    long_, int_, binary = T.LongType(), T.IntegerType(), T.BinaryType()
    long = base.filter(F.length("data") >= 2 * length - 1)  # words and blanks of one window
    grams = long.select("data").mapInArrow(partial(_grams, length=length), "g long").groupBy("g").count()
    grams = written(grams.filter("count > 1").select("g"), "grams")
    schema = T.StructType([T.StructField(n, long_) for n in ("g", "c1", "c2")] + made(("h", long_), ("first", int_), ("last", int_), ("at", int_), ("again", T.BooleanType())).fields)
    found = long.mapInArrow(partial(_records, length=length), schema).hint("merge").join(grams, "g")  # the gram of a repeat within a text occurs twice
    found = written(found, "shared")
    shared = found.filter("NOT again")
    place = F.struct("doc_id", "h", "first")
    leaves = shared.groupBy("g", "c1", "c2").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "h", "first", "last", "at")).alias("one"))
    leaves = written(leaves, "leaves")
    several = leaves.filter("copies > 1").select("g", "c1", "c2", F.struct("one.doc_id", "one.h", "one.first").alias("one"))
    inner = found.filter("again").select("doc_id", "h", F.col("first").alias("s"), (F.col("last") + length).alias("e"))
    copies = shared.hint("merge").join(several, ["g", "c1", "c2"]).filter(place != F.col("one"))
    marks = inner.union(copies.select("doc_id", "h", F.col("first").alias("s"), (F.col("last") + length).alias("e")))
    sizes = written(leaves.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1"), "sizes")
    wanted = leaves.select("g", "one.*").hint("merge").join(sizes, "g")
    wanted = wanted.groupBy(F.col("doc_id").alias("w_id"), F.col("h").alias("w_h")).agg(F.collect_list(F.struct("g", "first", "last", "at", "m")).alias("wanted"))  # records of one text
    laid = long.hint("merge").join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h"))).select("doc_id", "h", "data", "wanted")
    piece = made(("h", long_), ("first", int_), ("at", int_), ("m", long_), ("data", binary))
    pieces = written(laid.mapInArrow(partial(_lay, length=length), T.StructType([T.StructField("g", long_), *piece.fields])), "pieces")
    small = pieces.filter(F.col("m") <= GROUP).select("g", "doc_id", "h", "first", "at", "data").repartition("g").sortWithinPartitions("g")
    marks = marks.union(small.mapInArrow(partial(_trees, length=length), made(("h", long_), ("s", int_), ("e", int_))))
    if sizes.filter(F.col("m") > GROUP).head(1):
        schema = T.StructType([T.StructField("w1", long_), T.StructField("w2", long_), *made(("h", long_), ("s", int_)).fields])
        full = written(pieces.filter(F.col("m") > GROUP).select("doc_id", "h", "first", "data").mapInArrow(partial(_windows, length=length), schema), "windows")
        lead = full.groupBy("w1", "w2").agg(F.count("*").alias("k"), F.min(F.struct("doc_id", "h", "s")).alias("one")).filter("k > 1").drop("k")
        later = full.hint("merge").join(lead, ["w1", "w2"]).filter(F.struct("doc_id", "h", "s") != F.col("one"))
        marks = marks.union(later.select("doc_id", "h", "s", (F.col("s") + length).alias("e")))
    return marks


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = b.column("found").to_pylist()
        total, removed, sha, spans = [], [], [], []
        for place, held in _parts(b.column("data")):
            for i, words in enumerate(held):
                s, e = (np.array([r[k] for r in found[place + i] or ()], np.int64) for k in ("s", "e"))
                change = np.bincount(s, minlength=len(words) + 1) - np.bincount(e, minlength=len(words) + 1)
                gone = np.cumsum(change)[: len(words)] > 0
                total.append(len(words))
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join(compress(words, ~gone)) if removed[-1] else b" ".join(words)).hexdigest())
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).view(np.int8)))
                spans.append([{"start": a, "end": z} for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [b.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, kind)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])


def remove_repeated_passages(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, n_removed, kept_sha256, and the removed stretches of words as ``spans`` (start, end exclusive)."""
    base = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("h"), F.encode("text", "utf-8").alias("data"))
    marks = written(repeated_windows(base, length), "marks")
    known = marks.groupBy(F.col("doc_id").alias("f_id"), F.col("h").alias("f_h")).agg(F.collect_list(F.struct("s", "e")).alias("found"))  # stretches of one text
    rows = base.hint("merge").join(known, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")), "left").select("doc_id", "data", "found")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    names = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("spans", span)]
    return rows.mapInArrow(_kept, T.StructType([base.schema["doc_id"], *[T.StructField(n, t) for n, t in names]]))
