"""Ranked lexical search by range-maximum queries over posting lists.

Terms are maximal runs of ASCII letters, digits and other characters beyond ASCII; only A-Z are lower-cased. One pass over whole texts writes the
postings of the queries' terms (document, number of terms, term ids, occurrences), from which the corpus counts come. Then
tasks take segments of at most ``SEGMENT`` documents, in order of id. In a segment each term has its list of impacts
(weight times saturated occurrences, an exact integer) under a sparse table: the maximum over any range of documents, and its first document, in
two look-ups. A query starts with the interval of all documents, bounded by the sum of its terms' maxima. The intervals
of highest bound are taken first: the document of the highest single impact is scored in full, and the interval is split there in two,
bounded anew. A query is done in a segment when no bound reaches its tenth score; equal scores go by id, so an interval whose bound
only equals that score is left when all its ids are larger. A task carries each query's best from segment to segment, so bounds are
held against ever higher scores, and gives at most ``top`` rows a query; those few are ranked by a window.

The queries are a stated set: they are taken in blocks of at most ``BLOCK_BYTES`` of text, which go to all tasks, and every block meets all
documents. Null and empty texts hold no term. A query without terms, or without a document above 0, has no rows. Repeated rows of documents are
ranked each; repeated queries are asked once. A null id comes after the others. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, texts, written

SEGMENT, BATCH, BLOCK_BYTES = 4096, 128, 1 << 20
#: An impact and, below it, its document's place from the right, so that a maximum is the first document of the highest impact.
PLACE_BITS = 13
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split(b" ") if text else []


def _words(text: str) -> list[bytes]:
    return [w for w in terms_of(text) if w]


def saturated(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The integer share of a term's weight that a document of n terms gets for tf occurrences."""
    m = 10 + (90 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _postings(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """doc_id, number of terms, and ids and occurrences of the queries' terms, of texts with at least one term."""
    number = shared.value
    for b in batches:
        at = 0
        for part in chunks(b.column("text").to_pylist()):
            found = [_words(t) for t in part]
            n = np.array([len(w) for w in found], np.int64)
            ids = np.fromiter(map(number.get, chain.from_iterable(found), repeat(-1)), np.int64, int(n.sum()))
            doc = np.repeat(np.arange(len(part)), n)
            keys, tf = np.unique((doc * (len(number) + 1) + ids)[ids >= 0], return_counts=True)
            doc, ids = np.divmod(keys, len(number) + 1)
            offsets = pa.array(np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32))
            columns = [b.column("doc_id").slice(at, len(part)), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tf"]).filter(pa.array(n > 0))
            at += len(part)


class Segment:
    """Posting lists of some documents under one sparse table; documents are numbered in order of id."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, documents: int, terms: int):
        order = pc.sort_indices(batch, sort_keys=[("doc_id", "ascending")], null_placement="at_end")
        batch = batch.take(order)
        self.ids, self.size = batch.column("doc_id").to_pylist(), batch.num_rows
        held = np.diff(batch.column("terms").offsets.to_numpy())
        doc = np.repeat(np.arange(self.size), held)
        term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tf"))
        impact = weights[term] * saturated(tf, batch.column("n").to_numpy()[doc], documents, terms)
        by_term = np.argsort(term, kind="stable")
        term, self.doc = term[by_term], doc[by_term]
        self.first = np.searchsorted(term, np.arange(len(weights) + 1))
        levels = [impact[by_term] << PLACE_BITS | (SEGMENT - self.doc)]
        width = 1
        while 2 * width <= self.size and len(levels[-1]) >= 2 * width:
            last = levels[-1].copy()
            last[:-width] = np.maximum(levels[-1][:-width], levels[-1][width:])
            levels.append(last)
            width *= 2
        self.table = np.stack(levels)
        self.log = np.zeros(self.size + 2, np.int64)
        self.log[1:] = np.floor(np.log2(np.arange(1, self.size + 2)))

    def maxima(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Impact and place of the maximum in posting ranges [left, right); 0 where a range is empty."""
        some = right > left
        k = self.log[np.where(some, right - left, 1)]
        left, last = np.where(some, left, 0), np.where(some, right - (1 << k), 0)
        return np.where(some, np.maximum(self.table[k, left], self.table[k, last]), 0)


class Best:
    """A query's best documents so far, best first."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    def least(self) -> int:
        """The score a document must reach."""
        return -self.rows[-1][0] if len(self.rows) == self.top else 1

    def add(self, score: int, doc_id) -> None:
        bisect.insort(self.rows, (-score, doc_id is None, 0 if doc_id is None else doc_id))
        del self.rows[self.top :]

    def cut(self, ids: list) -> int:
        """The first place of a segment whose id is not before the last row's."""
        if len(self.rows) < self.top:
            return len(ids)
        return bisect.bisect_left(ids, self.rows[-1][1:], key=lambda i: (i is None, 0 if i is None else i))


def search_segment(s: Segment, query: np.ndarray, best: Best) -> None:
    """Best-first search of one query (term ids) in one segment."""
    query = query[s.first[query + 1] > s.first[query]]
    if not len(query):
        return
    # Number of a term's postings before each place: where any interval begins and ends in its list.
    before = np.zeros((len(query), s.size + 1), np.int64)
    for i, t in enumerate(query):
        before[i, s.doc[s.first[t] : s.first[t + 1]] + 1] = 1
    before = s.first[query][:, None] + np.cumsum(before, axis=1)

    def bounds(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = s.maxima(before[:, lo], before[:, hi])
        return (found >> PLACE_BITS).sum(axis=0), found.max(axis=0)

    lo, hi = np.array([0]), np.array([s.size])
    bound, peak = bounds(lo, hi)
    least, cut = best.least(), best.cut(s.ids)
    while True:
        alive = (bound > least) | ((bound == least) & (lo < cut))
        lo, hi, bound, peak = lo[alive], hi[alive], bound[alive], peak[alive]
        if not len(lo):
            return
        if len(lo) > BATCH:
            pick = np.argpartition(bound, len(lo) - BATCH)
            rest, pick = pick[:-BATCH], pick[-BATCH:]
        else:
            rest, pick = np.arange(0), np.arange(len(lo))
        at = SEGMENT - (peak[pick] & ((1 << PLACE_BITS) - 1))
        start, end = before[:, at], before[:, at + 1]
        scores = np.where(end > start, s.table[0][np.where(end > start, start, 0)] >> PLACE_BITS, 0).sum(axis=0)
        for i in np.flatnonzero(scores >= least):
            if scores[i] >= best.least():
                best.add(int(scores[i]), s.ids[at[i]])
        least, cut = best.least(), best.cut(s.ids)
        new_lo, new_hi = np.concatenate([lo[pick], at + 1]), np.concatenate([at, hi[pick]])
        some = new_hi > new_lo
        new_lo, new_hi = new_lo[some], new_hi[some]
        new_bound, new_peak = bounds(new_lo, new_hi)
        lo, hi = np.concatenate([lo[rest], new_lo]), np.concatenate([hi[rest], new_hi])
        bound, peak = np.concatenate([bound[rest], new_bound]), np.concatenate([peak[rest], new_peak])


def _search(batches: Iterator[pa.RecordBatch], shared: Broadcast, top: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    queries, weights, documents, terms = shared.value
    best = [Best(top) for _ in queries]
    held: list[pa.RecordBatch] = []

    def search() -> None:
        table = pa.Table.from_batches(held).combine_chunks()
        for b in table.to_batches(max_chunksize=SEGMENT):
            segment = Segment(pa.RecordBatch.from_arrays([c if not c.offset else pa.concat_arrays([c]) for c in b.columns], names=b.schema.names), weights, documents, terms)
            for query, found in zip(queries, best, strict=True):
                search_segment(segment, query, found)
        held.clear()

    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= SEGMENT:
            search()
    if held:
        search()
    rows = [(q, None if null else doc, -score) for q, found in enumerate(best) for score, null, doc in found.rows]
    columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, names=["q", "doc_id", "score"])


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Item ids with their distinct terms, in blocks of bounded size; items without terms are left out."""
    block, size = [], 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).distinct().toLocalIterator():
        words = sorted(set(_words(r["t"] or "")))
        if words:
            block.append((r["i"], words))
            size += sum(map(len, words))
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(
    docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text"
) -> DataFrame:
    """The ``top`` documents of each item: item_id, rank, doc_id, score."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, base = docs.sparkSession, texts(docs, id_col, text_col)
    kind, item_kind = base.schema["doc_id"].dataType, items.schema[item_col].dataType
    posting = T.StructType([T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])
    hit = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], T.StructType([T.StructField("item_id", item_kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())]))
    for block in blocks(items, item_col, query_col):
        number = {w: i for i, w in enumerate(sorted({w for _, words in block for w in words}))}
        postings = written(base.mapInArrow(partial(_postings, shared=spark.sparkContext.broadcast(number)), posting), "postings")
        documents, terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(number), np.int64)
        for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of the block
            weights[r["t"]] = weight(documents, r["count"])
        queries = [np.array([number[w] for w in words]) for _, words in block]
        shared = spark.sparkContext.broadcast((queries, weights, documents, terms))  # of the block's size
        hits = postings.mapInArrow(partial(_search, shared=shared, top=top, id_type=to_arrow_type(kind)), hit)
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = hits.withColumn("rank", place).filter(F.col("rank") <= top)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item_id", item_kind)]))
        out = out.unionByName(ranked.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"))
    return out
