"""Language identification by bit-sliced Bloom filters of character trigrams.

Every slot of the filter holds one bit per language, so one look-up in each of three hashed slots and an AND return
all languages containing a trigram. A document's hits per language are popcounts of those masks, less
the false positives that the filter's fill predicts; the language with most corrected hits wins.

A trigram belongs to a language when it is at least ``SHARE`` times as frequent there as where it is most
frequent. The filters are fitted on a bounded sample: at most ``per_language`` labelled documents of least
hash for each language, whole texts, outside the held-out fifth. Executors build the filters' bits, block by block of
slots; they have 8 bits for each trigram of the language with the most (``SLOTS`` at least), so a filter is filled to a third at most, and the sample bounds them, whatever the corpus. Texts that are null or have no letter give ``und``
with score 0; so does a model without any labelled document. Ties go to the language first in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, written

SLOTS, BLOCK, SHARE, PER_LANGUAGE, SAMPLE_IDS = 1 << 18, 1 << 13, 0.3, 1500, 500_000
#: Odd multipliers of the trigram hash, and of its three slots.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
SLOT_MIX = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D], np.uint64)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the trigrams of lower-cased letters and word borders; each text's borders in them; whether a text has letters."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer(("  " + "  ".join(lower) + "  ").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letters()[points]
    c = np.where(letter, points, 32).astype(np.uint64)
    ends = np.cumsum([len(t) + 2 for t in lower])
    used = letter[1:-1] & (letter[:-2] | letter[2:])  # the middle one, and a neighbour
    h = (c[:-2] * MIX[0] + c[1:-1] * MIX[1] + c[2:] * MIX[2])[used]
    h ^= h >> np.uint64(29)
    before = np.concatenate([[0], np.cumsum(used)])
    borders = before[np.minimum(np.concatenate([[0], ends]), len(before) - 1)]
    seen = np.concatenate([[0], np.cumsum(letter)])
    has = np.diff(seen[np.concatenate([[0], ends])]) > 0
    return h, borders, has


def slots(h: np.ndarray, size: int) -> list[np.ndarray]:
    """The three slots of each trigram; ``size`` is a power of two."""
    shift = np.uint64(64 - size.bit_length() + 1)
    return [((h * m) >> shift).astype(np.int64) for m in SLOT_MIX]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs, values = b.column("lang").to_pylist(), b.column("text").to_pylist()
        for lang in sorted(set(langs)):
            h, _, _ = trigrams([t for t, x in zip(values, langs, strict=True) if x == lang])
            grams, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


class Filters:
    """The filters of all languages (bits[word of 64 languages, slot]), with their false-positive rates."""

    def __init__(self, names: list[str], bits: np.ndarray):
        self.names, self.bits = names, bits
        fill = [np.mean(self.bits[k >> 6] >> np.uint64(k & 63) & np.uint64(1)) for k in range(len(names))]
        self.fill, self.false = fill, np.array(fill) ** 3

    def decide(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.names or not texts:
            return ["und"] * len(texts), [0.0] * len(texts)
        h, borders, has = trigrams(texts)
        where, n = slots(h, self.bits.shape[1]), np.diff(borders)
        hits = np.zeros((len(self.names), len(texts)))
        for w, bits in enumerate(self.bits):
            mask = bits[where[0]] & bits[where[1]] & bits[where[2]]
            for k in range(64 * w, min(64 * w + 64, len(self.names))):
                sums = np.concatenate([[0], np.cumsum(mask >> np.uint64(k & 63) & np.uint64(1), dtype=np.int64)])
                hits[k] = np.diff(sums[borders])
        corrected = np.maximum(0, (hits - n * self.false[:, None]) / (1 - self.false[:, None]))
        best = corrected.argmax(axis=0)
        score = np.clip(corrected.max(axis=0) / np.maximum(n, 1), 0, 1)
        return [self.names[k] if ok else "und" for k, ok in zip(best, has, strict=True)], [float(s) if ok else 0.0 for s, ok in zip(score, has, strict=True)]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from at most ``per_language`` labelled documents of each language, held-out ones left out."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # Of large languages only hashes under a bound are ranked, about four times as many as wanted: no task sees a whole language.
    sizes = written(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    spread = F.shiftrightunsigned(F.xxhash64("id"), 11) / float(1 << 53)
    few = known.select("id", "lang").join(sizes, "lang").filter(spread <= 4.0 * per_language / F.col("n"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = few.withColumn("nth", nth).filter(F.col("nth") <= per_language).select("id", "lang").distinct()
    # per_language ids a language: broadcast while that is under SAMPLE_IDS, else the texts are shuffled to them.
    small = F.broadcast(chosen) if sizes.count() * per_language <= SAMPLE_IDS else chosen
    sample = known.join(small, ["id", "lang"], "left_semi").select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "trigrams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    own = rate.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).filter(F.col("rate") >= SHARE * F.col("top"))
    names = sorted(r["lang"] for r in totals.select("lang").collect())
    place = {name: k for k, name in enumerate(names)}
    words = max(1, len(names) + 63 >> 6)

    most = own.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    size = max(SLOTS, 1 << (8 * most - 1).bit_length()) if most else SLOTS

    def to_slots(batches):
        for b in batches:
            h = b.column("gram").to_numpy().view(np.uint64)
            k = np.array([place[x] for x in b.column("lang").to_pylist()], np.int64)
            at = np.concatenate(slots(h, size))
            yield pa.RecordBatch.from_arrays([pa.array(at // BLOCK), pa.array(at % BLOCK), pa.array(np.tile(k, 3))], names=["block", "slot", "k"])

    def to_bits(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((words, BLOCK), np.uint64)
        for b in batches:
            k = b.column("k").to_numpy()
            np.bitwise_or.at(bits, (k >> 6, b.column("slot").to_numpy()), np.uint64(1) << (k & 63).astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([bits.tobytes()], pa.binary())], names=["block", "bits"])

    marks = own.select("lang", "gram").mapInArrow(to_slots, "block long, slot long, k long").distinct()
    bits = np.zeros((words, size // BLOCK, BLOCK), np.uint64)
    for r in marks.groupBy("block").applyInArrow(to_bits, "block long, bits binary").collect():  # size / BLOCK rows: size bits a language
        bits[:, r["block"]] = np.frombuffer(r["bits"], np.uint64).reshape(words, BLOCK)
    return Filters(names, bits.reshape(words, size))


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two columns more, the language and its score (named by ``names``; columns of these names in ``docs`` give way); every whole text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # its size x languages bits: bounded by the sample
    kept = [c for c in docs.columns if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, scores = [], []
            for part in chunks([t or "" for t in b.column(text_col).to_pylist()]):
                got = shared.value.decide(part)
                found, scores = found + got[0], scores + got[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, *names])

    extra = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    base = docs.select(*[F.col(f"`{c}`") for c in kept])
    return base.mapInArrow(run, T.StructType([*base.schema.fields, *extra]))


def predict_languages(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row: doc_id, held_out, lang_pred, score."""
    filters = fit(docs, per_language, id_col, text_col, lang_col)
    base = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return identify(base, filters).select("doc_id", "held_out", "lang_pred", "score")
