"""Token ids in files: one zstandard frame per document, all with one trained dictionary.

Layout of a shard: a JSON header line (dictionary hash, width of an id, documents), the index (frame
offsets as unsigned 64-bit, ids per document as unsigned 32-bit), the frames. The dictionary lies beside
the shards under its hash. ``read_document`` reads a document's frame by ranged reads of the head, its index entry and the
frame, without its neighbours.

Documents are range-partitioned by id, so a partition is a run of ids, and written in ascending order in
shards of bounded size. A retried task writes files of new names; only names in the manifest are read.
A null text counts as empty (the end id alone); null ids come last; repeated rows stay separate.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, scratch, shuffle_partitions, texts, written
from .tokens import Encoder, public_path

#: Bounds of the dictionary's training sample (documents; bytes of their id arrays), of the dictionary and of a shard before compression.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES, SHARD_BYTES = 1000, 4_000_000, 65_536, 16_000_000


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    where, path = _fs(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    with where.open_output_stream(path) as f:
        f.write(data)


def get_file(uri: str) -> bytes:
    where, path = _fs(uri)
    with where.open_input_file(path) as f:
        return f.read()


def read_range(uri: str, start: int, n: int) -> bytes:
    where, path = _fs(uri)
    with where.open_input_file(path) as f:
        f.seek(start)
        return f.read(n)


def read_document(uri: str, k: int) -> np.ndarray:
    """The ids of a shard's document ``k``: its head line, two offsets and a count, and its frame are all that is read (and the dictionary)."""
    head = read_range(uri, 0, 256)
    body = head.index(b"\n") + 1
    head = json.loads(head[:body])
    n = head["documents"]
    if not 0 <= k < n:
        raise IndexError(k)
    a, z = map(int, np.frombuffer(read_range(uri, body + 8 * k, 16), "<u8"))
    count = int(np.frombuffer(read_range(uri, body + 8 * (n + 1) + 4 * k, 4), "<u4")[0])
    frame = read_range(uri, body + 8 * (n + 1) + 4 * n + a, z - a)
    reader = _codec(get_file(f"{uri.rpartition('/')[0]}/{head['dictionary']}.dict"))[1]
    return np.frombuffer(reader.decompress(frame, max_output_size=max(1, count * head["width"])), f"<u{head['width']}").astype("<u4")


def train_dictionary(arrays: list[bytes]) -> bytes:
    """A dictionary of serialized id arrays; empty where the sample is too small to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _codec(dictionary: bytes):
    import zstandard

    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=known), zstandard.ZstdDecompressor(dict_data=known)


def write_shard(frames: list[bytes], counts: list[int], dict_hash: str, width: int) -> bytes:
    offsets = np.cumsum([0, *map(len, frames)], dtype="<u8")
    head = json.dumps({"format": "token-store/1", "dictionary": dict_hash, "width": width, "documents": len(frames)}).encode() + b"\n"
    return b"".join([head, offsets.tobytes(), np.array(counts, "<u4").tobytes(), *frames])


class Shard:
    """Reads documents of a shard by position."""

    def __init__(self, data: bytes, dictionaries: dict[str, bytes]):
        end = data.index(b"\n") + 1
        self.head = json.loads(data[:end])
        n = self.head["documents"]
        self.offsets = np.frombuffer(data, "<u8", n + 1, end)
        self.counts = np.frombuffer(data, "<u4", n, end + 8 * (n + 1))
        self.body, self.data = end + 8 * (n + 1) + 4 * n, data
        self.reader = _codec(dictionaries[self.head["dictionary"]])[1]

    def ids(self, k: int) -> np.ndarray:
        a, z = (self.body + int(x) for x in self.offsets[k : k + 2])
        raw = self.reader.decompress(self.data[a:z], max_output_size=max(1, int(self.counts[k]) * self.head["width"]))
        return np.frombuffer(raw, f"<u{self.head['width']}").astype("<u4")


def _arrays(tokenizer: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for b in batches:
            made = [np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() for x in encoder.ids(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.binary())], names=["doc_id", "ids"])

    return run


def _writer(path: str, tokenizer: str, dictionary: bytes, dict_hash: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack = Encoder.of(tokenizer), _codec(dictionary)[0]
        part = TaskContext.get().partitionId()
        frames, counts, ids, size, seq = [], [], [], 0, 0

        def flush():
            nonlocal frames, counts, ids, size, seq
            name = f"{path}/shard-{part:08d}-{seq:05d}-{uuid.uuid4().hex[:8]}.tok"
            put_file(name, write_shard(frames, counts, dict_hash, width))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([name]), pa.array([sum(counts)], pa.int64()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type))],
                names=["part", "seq", "file", "n_ids", "doc_ids"],
            )
            frames, counts, ids, size, seq = [], [], [], 0, seq + 1
            return row

        for b in batches:
            i = 0
            for some in chunks(b.column("text").to_pylist()):
                for raw in encoder.ids(some):
                    got = np.append(np.frombuffer(raw, "<u4"), end_id).astype(f"<u{width}")
                    frames.append(pack.compress(got.tobytes()))
                    counts.append(len(got))
                    size += got.nbytes
                ids.append(b.column("doc_id").slice(i, len(some)))
                i += len(some)
                if size >= SHARD_BYTES:
                    yield flush()
        if frames:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the store under ``path`` (a shared folder); the manifest: part, seq, file, n_ids, doc_ids, start (ids before the shard)."""
    tokenizer = tokenizer or public_path("byte_bpe_50k.json")
    base = texts(docs, id_col, text_col)
    encoder = Encoder.of(tokenizer)
    width = 2 if encoder.library.get_vocab_size() <= 65_536 else 4
    # For the dictionary only: the ids of least hash, their whole texts encoded on executors, arrays in that order up to the bytes.
    chosen = base.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct()
    sample = base.join(chosen, "doc_id", "left_semi").mapInArrow(_arrays(tokenizer, width), T.StructType([T.StructField("doc_id", base.schema["doc_id"].dataType), T.StructField("ids", T.BinaryType())]))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("ids"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("ids")).limit(SAMPLE_DOCS)
    sample = sample.withColumn("upto", F.sum(F.length("ids")).over(order)).filter(F.col("upto") <= SAMPLE_BYTES).select("ids")
    dictionary = train_dictionary([bytes(r["ids"]) for r in sample.collect()])  # SAMPLE_BYTES at most
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    put_file(f"{path}/{dict_hash}.dict", dictionary)
    key = [F.asc_nulls_last("doc_id"), F.xxhash64("text")]
    schema = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("file", T.StringType()), T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(base.schema["doc_id"].dataType)),
    ])
    shards = base.repartitionByRange(*key[:1]).sortWithinPartitions(*key).mapInArrow(_writer(path, tokenizer, dictionary, dict_hash, end_id, width), schema)
    manifest = written(shards, "manifest")
    # Starts in two steps: parts after parts, then the shards of a part.
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("of_part"))
    parts = parts.withColumn("before", F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part"))  # a row a partition
    upto = Window.partitionBy("part").orderBy("seq")
    return manifest.join(parts.select("part", "before"), "part").withColumn("start", F.col("before") + F.sum("n_ids").over(upto) - F.col("n_ids")).drop("before")


def _reader(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionaries: dict[str, bytes] = {}
        for b in batches:
            for k in range(b.num_rows):
                data = get_file(b.column("file")[k].as_py())
                name = json.loads(data[: data.index(b"\n")])["dictionary"]
                if name not in dictionaries:
                    dictionaries[name] = get_file(f"{path}/{name}.dict")
                shard, ids = Shard(data, dictionaries), b.column("doc_ids")[k].values
                crc = [zlib.crc32(shard.ids(i).tobytes()) for i in range(len(ids))]
                counts = shard.counts.astype("i8")
                starts = b.column("start")[k].as_py() + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(manifest: DataFrame, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    kind = manifest.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]])
    n = max(shuffle_partitions(manifest.sparkSession), manifest.count())  # about a shard a task: a given number is not coalesced
    return manifest.repartitionByRange(n, "part", "seq").mapInArrow(_reader(path), schema)


def token_store(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = scratch(spark, "tokens")
    return read_tokens(write_tokens(docs, path), path)
