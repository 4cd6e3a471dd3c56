"""Exact de-duplication by content sort.

Sampled splitters range-partition the normalised texts (white space deleted), Spark's external sort places
equal ones next to each other, and a streaming scan compares each text in full with its neighbour. The sort
key holds the first ``LEAD_BYTES`` bytes of a text, its SHA-256, the original length (longest first) and the id: among
texts that begin alike the order is the digest's, so a splitter is small however long texts are, and a text that fills
a third of the table is cut over many partitions by id. Of the runs that touch a partition's border (two a partition
at most) one text each is kept, and those texts are compared in full to join what a border has cut.

Null and empty texts are equal to each other. Rows repeated with the same id and text form one group in
which one row stays. An empty table gives an empty result. A null id sorts after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITESPACE, written

LEAD_BYTES = 32


def normalised(text: Column) -> Column:
    return F.translate(text, WHITESPACE, "")


def _sorted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _points, _norm and _sha of each row, range-partitioned and sorted by content; nothing else of a row travels."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.length(text).cast("long").alias("_points"), normalised(text).alias("_norm"))
    rows = rows.withColumns({
        "_lead": F.substring(F.encode("_norm", "utf-8"), 1, LEAD_BYTES),
        "_sha": F.unhex(F.sha2("_norm", 256)),
    })
    key = ["_lead", "_sha", F.desc("_points"), F.asc_nulls_last("_id")]
    return rows.repartitionByRange(*key).sortWithinPartitions(*key).drop("_lead")


def _new_runs(norm: pa.Array, before: str | None) -> np.ndarray:
    """Whether each text differs from the one before it, compared in full."""
    new = np.empty(len(norm), bool)
    new[0] = before is None or norm[0].as_py() != before
    if len(norm) > 1:
        new[1:] = pc.not_equal(norm.slice(1), norm.slice(0, len(norm) - 1)).to_numpy(zero_copy_only=False)
    return new


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per row: its run's first id and size, and for the partition's first and last runs 0 or 1 as ``edge`` with, in one row, the text."""
    held: list[pa.Array] = []  # ids of the run still open; nothing else of it is kept but its first row
    first, norm_before, head = True, None, None

    def out(ids, keep, size, kept, sha, points, edge=None, text=None):
        n = len(ids)
        border = pa.array([text, *[None] * (n - 1)], pa.string())
        return pa.RecordBatch.from_arrays(
            [ids, keep, pa.array(size, pa.int64()), pa.array(kept), sha, pa.array(points, pa.int64()), pa.array([edge] * n, pa.int8()), border],
            names=["doc_id", "keep_id", "group_size", "kept", "sha", "points", "edge", "border"],
        )

    def closed(edge=None):
        ids = pa.concat_arrays(held)
        n = len(ids)
        kept = np.zeros(n, bool)
        kept[0] = True
        text = head[3] if edge is not None else None
        return out(ids, pa.repeat(head[0], n), np.full(n, n), kept, pa.repeat(head[1], n), np.full(n, head[2]), edge, text)

    for b in batches:
        if not b.num_rows:
            continue
        norm, ids, sha, points = b.column("_norm"), b.column("_id"), b.column("_sha"), b.column("_points")
        starts = np.flatnonzero(_new_runs(norm, norm_before))
        norm_before = norm[len(norm) - 1].as_py()
        if not len(starts):
            held.append(ids)
            continue
        if starts[0]:
            held.append(ids.slice(0, int(starts[0])))
        if held:
            yield closed(0 if first else None)
            first, held = False, []
        a, z = int(starts[0]), int(starts[-1])
        if z > a:
            if first:  # the partition's first run ends in this batch
                a = int(starts[1])
                held, head = [ids.slice(0, a)], (ids[0], sha[0], points[0].as_py(), norm[0].as_py())
                yield closed(0)
                first, held = False, []
            whole = starts[(starts >= a) & (starts < z)]
            sizes = np.diff(np.append(whole, z))
            at = pa.array(np.repeat(whole, sizes))
            if len(at):
                yield out(ids.slice(a, z - a), ids.take(at), np.repeat(sizes, sizes), np.isin(np.arange(a, z), whole), sha.slice(a, z - a), points.take(at).to_numpy())
        held, head = [ids.slice(z)], (ids[z], sha[z], points[z].as_py(), norm[z].as_py())
    if held:
        yield closed(0 if first else 1)


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``_members``, with runs that borders have cut put together again."""
    ordered = _sorted(docs, id_col, text_col)
    kind = ordered.schema["_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("keep_id", kind), T.StructField("group_size", T.LongType()), T.StructField("kept", T.BooleanType()),
        T.StructField("sha", T.BinaryType()), T.StructField("points", T.LongType()), T.StructField("edge", T.ByteType()), T.StructField("border", T.StringType()),
    ])
    runs = written(ordered.mapInArrow(_members, schema).withColumn("part", F.spark_partition_id()), "exact")
    edges = runs.filter("border IS NOT NULL").select("border", "part", "edge", "group_size", F.struct((-F.col("points")).alias("p"), F.col("keep_id").isNull().alias("n"), F.col("keep_id").alias("id"), "part", "edge").alias("of"))
    whole = edges.groupBy("border").agg(F.min("of").alias("best"), F.sum("group_size").alias("size"))
    joined = edges.join(whole, "border").select("part", "edge", "best", "size")  # two rows a partition, without their texts
    return runs.drop("border").join(joined, ["part", "edge"], "left")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    mine = F.col("best").isNull() | ((F.col("best.part") == F.col("part")) & (F.col("best.edge") == F.col("edge")))
    return _judged(docs, id_col, text_col).select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("keep_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("size", "group_size").alias("group_size"),
        (F.col("kept") & mine).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _firsts(at: int):
    """The first row of each run; ``at`` is the text's place in the row. The partition's first and last carry an edge number and their text's normal form."""
    names = ["_row", "_id", "_points", "_sha", "_edge", "_border"]

    def plain(rows: pa.StructArray, k: int) -> bytes:
        return (rows.field(at)[k].as_py() or "").encode("utf-8", "surrogatepass").translate(None, WHITESPACE.encode())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last, n_runs = None, None, 0

        def out(rows: pa.RecordBatch, edge=None):
            border = None if edge is None else plain(rows.column("_row"), 0).decode("utf-8", "surrogatepass")
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array([edge] * len(rows), pa.int8()), pa.array([border] * len(rows), pa.string())], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            rows, sha = b.column("_row"), b.column("_sha")
            new = np.ones(b.num_rows, bool)
            if b.num_rows > 1:
                new[1:] = pc.not_equal(sha.slice(1), sha.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            text = None
            for k in np.flatnonzero(~new):  # one digest: the texts are compared in full
                text = text if text is not None and k and not new[k - 1] else plain(rows, int(k) - 1)
                other, text = text, plain(rows, int(k))
                new[k] = text != other
            if before is not None and before[0] == sha[0].as_py():
                new[0] = before[1] != plain(rows, 0)
            before = sha[b.num_rows - 1].as_py(), plain(rows, b.num_rows - 1)
            starts = np.flatnonzero(new)
            if len(starts):
                got = b.take(pa.array(starts))
                if last is not None:
                    yield out(last, 0 if n_runs == 1 else None)
                if len(starts) > 1:
                    if not n_runs:
                        yield out(got.slice(0, 1), 0)
                    if len(middle := got.slice(0 if n_runs else 1, len(starts) - (1 if n_runs else 2))):
                        yield out(middle)
                n_runs += len(starts)
                last = got.slice(len(starts) - 1)  # undecided until a later run begins
        if last is not None:
            yield out(last, 0 if n_runs == 1 else 1)

    return scan


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all columns of ``docs``. The sort carries each row once; its digest stands for the normal form until two are equal."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = normalised(text)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("_row"), F.col(id_col).alias("_id"), F.length(text).cast("long").alias("_points"), F.unhex(F.sha2(norm, 256)).alias("_sha"), F.substring(F.encode(norm, "utf-8"), 1, LEAD_BYTES).alias("_lead"))
    key = ["_lead", "_sha", F.desc("_points"), F.asc_nulls_last("_id")]
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key).drop("_lead")
    schema = T.StructType([*ordered.schema.fields, T.StructField("_edge", T.ByteType()), T.StructField("_border", T.StringType())])
    firsts = written(ordered.mapInArrow(_firsts(docs.columns.index(text_col)), schema).withColumn("_part", F.spark_partition_id()), "distinct")
    edges = firsts.filter("_edge IS NOT NULL").select("_border", "_part", "_edge", F.struct((-F.col("_points")).alias("p"), F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), "_part", "_edge").alias("_of"))
    best = edges.groupBy("_border").agg(F.min("_of").alias("_best"))
    gone = edges.join(best, "_border").filter("_of != _best").select("_part", "_edge")  # two rows a partition at most
    return firsts.join(gone, ["_part", "_edge"], "left_anti").select("_row.*")
