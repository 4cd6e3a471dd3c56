"""Best-fit packing planned on the histogram of piece lengths.

Tokens are counted once per document; only piece lengths travel. Best fit runs over the histogram (at most one
row per length, whatever the corpus), giving intervals: "pieces of length L with rank a..b go to sequences
s.. at this offset". Pieces find their interval by joining on their rank within their length. Ranks come
from per-bucket counts and a running sum over them, so a length that holds most pieces is dealt over many
tasks; pieces and plan meet in a merge join on length and bucket.

A null text counts as empty (the end id alone). Ties in rank are broken by id and piece; repeated rows are
separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, shuffle_partitions, texts, written
from .tokens import Encoder, public_path

def piece_starts(n: int, limit: int) -> list[int]:
    """Starts of a document's pieces: ``limit`` ids each, the first one may be shorter."""
    first = n - (max(1, -(-n // limit)) - 1) * limit
    return [0, *range(first, n, limit)]


def _pieces(path: str, end_id: int, limit: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            i = 0
            for part in chunks(b.column("text").to_pylist()):
                for raw in encoder.ids(part):
                    raw += end
                    cuts = [*piece_starts(len(raw) // 4, limit), len(raw) // 4]
                    for k in range(len(cuts) - 1):
                        at.append(i)
                        piece.append(k)
                        start.append(cuts[k])
                        length.append(cuts[k + 1] - cuts[k])
                        crc.append(zlib.crc32(raw[4 * cuts[k] : 4 * cuts[k + 1]]))
                    i += 1
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def plan(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, rank_from, rank_to, first sequence, offset).

    Open sequences are kept as blocks of equally filled neighbours, by room left. A block that is only partly
    used is split, so blocks grow with the number of lengths, not of pieces.
    """
    rooms: list[int] = []  # room sizes that have blocks, ascending
    blocks: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
    out, sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room not in blocks:
            bisect.insort(rooms, room)
            blocks[room] = []
        blocks[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if (k := bisect.bisect_left(rooms, length)) < len(rooms):
                room = rooms[k]
                first, n = blocks[room].pop()
                if not blocks[room]:
                    del blocks[room], rooms[k]
                used, each = min(n, left), 1
                if used < n:
                    put(room, first + used, n - used)
            else:  # new sequences take as many pieces of this length as fit; the last one may take fewer
                room, first, each = limit, sequences, min(limit // length, left)
                used = left // each
                sequences += used
            for nth in range(each):
                out.append((length, rank, rank + used, first, limit - room + nth * length))
                rank += used
            if room > each * length:
                put(room - each * length, first, used)
            left -= used * each
    return out


def pack(
    docs: DataFrame, limit: int = 2048, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    base = texts(docs, id_col, text_col)
    schema = T.StructType([
        T.StructField("doc_id", base.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])
    path = tokenizer or public_path("byte_bpe_50k.json")
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shuffle_partitions(spark))).cast("int")
    pieces = written(base.mapInArrow(_pieces(path, end_id, limit), schema).withColumn("bucket", bucket), "pieces")
    per_bucket = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("bucket")
    per_bucket = written(per_bucket.withColumn("before", F.sum("n").over(upto) - F.col("n")), "histogram")
    counts = {r["length"]: r["n"] for r in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` rows
    slots = spark.createDataFrame(plan(counts, limit), "length long, rank_from long, rank_to long, first long, offset long")
    # The plan's intervals of ranks, cut where buckets meet: what of a bucket's own numbers goes where.
    end = F.col("before") + F.col("n")
    cells = (
        per_bucket.join(slots, "length")
        .filter((F.col("rank_from") < end) & (F.col("before") < F.col("rank_to")))
        .select("length", "bucket", (F.col("rank_from") - F.col("before")).alias("from"), (F.col("rank_to") - F.col("before")).alias("to"), "first", "offset")
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    placed = (
        pieces.withColumn("nth", F.row_number().over(within) - 1)
        .join(cells.hint("merge"), ["length", "bucket"])  # both sides grow with the corpus: never broadcast
        .filter((F.col("nth") >= F.col("from")) & (F.col("nth") < F.col("to")))
    )
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth") - F.col("from")).alias("sequence_id"), "offset")
