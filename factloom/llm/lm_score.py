"""Masked pseudo-likelihood by a small bidirectional window network, trained in numpy on all documents.

Tokens are lower-cased words. The network masks each in turn and predicts it from ``SIDE`` neighbours on each side: their
embeddings, scaled by a gain for each place, are summed and squashed. The prediction is a walk down a Huffman tree of
the corpus's words, one logistic decision at each fork, so frequent words have short walks and a token's log-probability
is the sum of its decisions. Leaves are the corpus's most frequent words (at most ``WORDS``, each at least ``LEAST``
times) and ``ENDINGS`` classes of all other words by their last bytes; a word of a class has the class's
probability times its own share of the class's occurrences, from the full table of words, which grows with the corpus
and is joined in Spark. So every token has a probability of its own, and those of all the corpus's words sum to one.
A document's score is the sum of its tokens' conditional log-probabilities.

Word counts cover all documents. Documents are dealt to steps of about ``BATCH`` tokens by a hash of id and text, and
steps to replicas of ``DEPTH`` to twice as many steps. Replicas train ``ROUNDS`` times from common weights; after each
round what they changed is averaged by their tokens in Spark, block by block, so what is gathered grows with the input
and each block of the result has a fixed size. Every document is trained on ``passes`` times, once unless the caller asks for more,
whatever the size of the corpus: rounds are equal parts of all passes. As in masked training, a pass over a step masks one in ``MASKED`` of its places, by turns, with all words around as context; scoring masks every place. Averages and scores are sums of
integers, and a token's arithmetic is its own row's alone: neither files, partitions nor the order of tasks bear on the
result, and equal texts get equal scores, whatever their ids.

Null, empty and blank texts have no tokens: score 0, mean null. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import texts, written

SIDE, DIMS, ENDINGS = 3, 20, 256
#: Words with a leaf of their own: how many at most, and how often they occur at least.
WORDS, LEAST = 12_000, 8
BATCH, RATE, BLOCKS, MASKED = 8192, 0.5, 16, 4
#: Steps of a pass that a replica takes at least where there are as many, and rounds.
DEPTH, ROUNDS = 512, 4
#: Changes of weights are averaged in units of 2^-24, and logs summed in units of 2^-24, as integers.
UNIT, LOG_UNIT = float(1 << 24), float(1 << 24)
#: Distinct words a task counts before it passes its counts on.
COUNTER_WORDS = 200_000
Weights = dict[str, np.ndarray]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    counter: Counter = Counter()
    for b in batches:
        for text in b.column("text").to_pylist():
            counter.update(words_of(text))
            if len(counter) > COUNTER_WORDS:
                yield out(counter)
                counter.clear()
    if counter:
        yield out(counter)


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


class Vocabulary(dict):
    """word -> leaf; words without a leaf of their own get their ending's class. Leaves 0 to ENDINGS - 1 are the classes."""

    def __missing__(self, word: bytes) -> int:
        return ending(word)


class Tree:
    """A Huffman tree of leaves: for each the forks from the root and the sides taken, longest walks padded."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        heap = [(int(c) + 1, k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        parent, side, weight = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.float32), np.zeros(2 * n)
        weight[:n] = counts + 1
        top = n
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = top
            side[i], side[j], weight[top] = 1, -1, a + b
            heapq.heappush(heap, (a + b, top))
            top += 1
        walks = []
        for k in range(n):
            walk, at = [], k
            while at != top - 1:
                walk.append((parent[at] - n, side[at]))
                at = parent[at]
            walks.append(walk[::-1])
        self.depth = np.array(list(map(len, walks)), np.int16)
        self.forks = np.zeros((n, max(self.depth, default=0)), np.int16)
        self.sides = np.zeros(self.forks.shape, np.float32)
        for k, walk in enumerate(walks):
            for d, (fork, s) in enumerate(walk):
                self.forks[k, d], self.sides[k, d] = fork, s
        # Biases start at the frequencies: the walk's probabilities are the unigram model's.
        left, right = np.ones(max(n - 1, 1)), np.ones(max(n - 1, 1))
        for k in range(top - 1):
            (left if side[k] > 0 else right)[parent[k] - n] = weight[k]
        self.bias = np.log(left / right).astype(np.float32)

    @cached_property
    def levels(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each depth the forks and the sides of all leaves; made where it is used, not sent."""
        return [(self.forks[:, d].astype(np.int64), self.sides[:, d].copy()) for d in range(self.forks.shape[1])]


def first_weights(tree: Tree) -> Weights:
    """Small fixed embeddings (the last row is a text's border: zero), gains of one, forks that know only frequencies."""
    rng = np.random.default_rng(7)
    n = len(tree.depth)
    w = {"embed": rng.normal(0, 0.3, (n + 1, DIMS)), "gain": np.ones((2 * SIDE, DIMS)), "fork": np.zeros((len(tree.bias), DIMS)), "bias": tree.bias}
    w["embed"][n] = 0
    return {k: v.astype(np.float32) for k, v in w.items()}


def summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, the sums of their rows and how many there are."""
    by = np.argsort(keys, kind="stable")  # two-byte keys take the radix sort
    found = keys[by]
    starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return found[starts].astype(np.int64), np.add.reduceat(np.take(rows, by, axis=0), starts, axis=0), np.diff(np.append(starts, len(keys)))


def squashed(x: np.ndarray) -> np.ndarray:
    """tanh in place, by the exponential: numpy has a fast one for it."""
    x *= -2
    np.exp(np.minimum(x, 80, out=x), out=x)
    x += 1
    np.divide(2, x, out=x)
    x -= 1
    return x


def scaled_rows(w: Weights) -> list[np.ndarray]:
    """The embeddings times the gain of each place."""
    return [w["embed"] * gain for gain in w["gain"]]


def forward(w: Weights, tree: Tree, target: np.ndarray, context: np.ndarray, train: bool = False) -> np.ndarray | None:
    """Log-probability of each target from both sides, each row by itself; with ``train`` one gradient step is taken on ``w`` instead."""
    order = np.argsort(-tree.depth[target], kind="stable")  # longest walks first: those still walking are a prefix
    target, context = target[order], np.take(context, order, axis=1)
    depth = tree.depth[target]
    scaled = None if train else w.get("scaled") or scaled_rows(w)
    hidden, near = np.zeros((len(target), DIMS), np.float32), []
    for k in range(2 * SIDE):
        if train:
            near.append(np.take(w["embed"], context[k], axis=0))
            hidden += near[k] * w["gain"][k]
        else:
            hidden += np.take(scaled[k], context[k], axis=0)
    hidden = squashed(hidden)
    walking = [m for m in len(depth) - np.searchsorted(depth[::-1], np.arange(len(tree.levels)), "right") if m]  # those with walks longer than d
    if train:
        ends = np.cumsum([0, *walking])
        forks, pushed, back = np.empty(ends[-1], np.int16), np.empty((ends[-1], DIMS + 1), np.float32), np.zeros_like(hidden)
    else:
        least, odds = np.zeros(len(target), np.float32), np.ones(len(target), np.float32)
    for d, m in enumerate(walking):
        fork, side = (np.take(x, target[:m]) for x in tree.levels[d])
        vectors = np.take(w["fork"], fork, axis=0)
        x = (np.einsum("nd,nd->n", hidden[:m], vectors) + np.take(w["bias"], fork)) * side
        e = np.exp(-np.abs(x))
        if train:
            g = np.where(x > 0, e, 1) / (1 + e) * side  # 1 - probability, towards the side taken
            vectors *= g[:, None]
            back[:m] += vectors
            at = slice(ends[d], ends[d + 1])
            forks[at], pushed[at, DIMS] = fork, g
            np.multiply(hidden[:m], g[:, None], out=pushed[at, :DIMS])
        else:  # one logarithm for the whole walk: a walk of d forks multiplies to 2^d at most
            least[:m] += np.minimum(x, 0)
            odds[:m] *= 1 + e
    if not train:
        out = np.empty_like(least)
        out[order] = least - np.log(odds)
        return out
    ids, total, count = summed(forks, pushed)
    total *= np.float32(RATE) / np.maximum(count, 16).astype(np.float32)[:, None]
    w["fork"][ids] += total[:, :DIMS]
    w["bias"][ids] += total[:, DIMS]
    back *= 1 - hidden**2
    gains = np.stack([np.einsum("nd,nd->d", back, near[k]) for k in range(2 * SIDE)]) / len(target)
    ids, total, count = summed(context.astype(np.int16).ravel(), np.concatenate([back * w["gain"][k] for k in range(2 * SIDE)]))
    w["embed"][ids] += np.float32(RATE) / np.maximum(count, 16).astype(np.float32)[:, None] * total
    w["embed"][-1] = 0
    w["gain"] += np.float32(RATE) * gains
    return None


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([v.ravel() for v in w.values()])


def shaped(values: np.ndarray, like: Weights) -> Weights:
    cuts = np.cumsum([v.size for v in like.values()])[:-1]
    return {k: part.reshape(v.shape).astype(np.float32) for (k, v), part in zip(like.items(), np.split(values, cuts), strict=True)}


def _encode(shared):
    """Rows sorted by step -> a row per step: the texts' leaves with borders between them, whose they are, and the words of classes with their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, border = shared.value
        pad = [border] * SIDE
        step, last, kind = None, None, None

        def out() -> pa.RecordBatch:
            columns = [
                pa.array([step], pa.int64()), pa.array([np.array(ids, "<i2").tobytes()]), pa.array([owners], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int32())), pa.array([firsts], pa.list_(pa.int32())),
                pa.array([rare], pa.list_(pa.binary())), pa.array([rare_at], pa.list_(pa.int32())), pa.array([rare_n], pa.list_(pa.int32())),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["step", "ids", "doc_ids", "sizes", "firsts", "rare", "rare_at", "rare_n"])

        for b in batches:
            kind = b.column("doc_id").type
            for at, i, text in zip(b.column("step").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if at != step:
                    if step is not None:
                        yield out()
                    step, last = at, None
                    ids, owners, sizes, firsts, rare, rare_at, rare_n = [*pad], [], [], [], [], [], []
                copy = last == (i, text)
                firsts.append(firsts[-1] if copy else len(firsts))  # equal rows are neighbours
                if not copy:
                    words = words_of(text)
                    got = list(map(vocabulary.get, words))
                    of_class = Counter([w for w, leaf in zip(words, got, strict=True) if leaf is None])
                    classes = {w: ending(w) for w in of_class}
                    got = [classes[w] if leaf is None else leaf for w, leaf in zip(words, got, strict=True)]
                    rare += of_class
                    rare_n += of_class.values()
                    rare_at += [len(sizes)] * len(of_class)
                last = i, text
                ids += got + pad
                owners.append(i)
                sizes.append(len(got))
        if step is not None:
            yield out()

    return run


def unpacked(raw: bytes, border: int, turn: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """targets and their contexts of a step; with ``turn``, of the places masked in that turn."""
    row = np.frombuffer(raw, "<i2").astype(np.int64)
    at = np.flatnonzero(row != border)
    if turn is not None:
        at = at[(at + turn) % MASKED == 0]
    return row[at], np.stack([row[at + k] for k in (*range(-SIDE, 0), *range(1, SIDE + 1))])


def _train(shared):
    """Rows sorted by replica, pass and step -> the changes of a replica's weights, in blocks. Steps are taken as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, tree = shared.value

        def out() -> Iterator[pa.RecordBatch]:
            if tokens:
                parts = np.array_split((flat(w) - flat(first)).astype("<f2"), BLOCKS)
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([tokens] * BLOCKS, pa.int64()), pa.array([p.tobytes() for p in parts])], names=["block", "tokens", "changes"])

        replica, w, tokens = None, None, 0
        for b in batches:
            for r, turn, at, raw in zip(b.column("replica").to_pylist(), b.column("pass").to_pylist(), b.column("step").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if r != replica:
                    yield from out()
                    replica, w, tokens = r, {k: v.copy() for k, v in first.items()}, 0
                target, context = unpacked(raw, len(tree.depth), at + turn)
                n = max(1, round(len(target) / BATCH))  # a very long text takes several steps
                for part, around in zip(np.array_split(target, n), np.array_split(context, n, axis=1), strict=True):
                    if len(part):
                        forward(w, tree, part, around, train=True)
                tokens += len(target)
        yield from out()

    return run


def _average(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, weight = 0, 0
    for b in batches:
        for n, raw in zip(b.column("tokens").to_pylist(), b.column("changes"), strict=True):
            total = total + n * np.rint(np.frombuffer(raw.as_py(), "<f2").astype(np.float64) * UNIT).astype(np.int64)
            weight += n
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([(total / UNIT / weight).astype("<f4").tobytes()])], names=["block", "changes"])


def _model(base: DataFrame, passes: int):
    """The vocabulary, tree, averaged weights and leaves' counts, all of bounded size; the encoded documents, a row per step; the counts of all words."""
    spark = base.sparkSession
    counts = base.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "words")
    top = counts.filter(F.col("n") >= LEAST).orderBy(F.desc("n"), "word").limit(WORDS).collect()  # WORDS rows
    vocabulary = Vocabulary({bytes(r["word"]): ENDINGS + k for k, r in enumerate(top)})
    frequency = np.zeros(ENDINGS + len(top))
    frequency[ENDINGS:] = [r["n"] for r in top]
    by_class = counts.groupBy((F.crc32(F.substring("word", -3, 3)) % ENDINGS).cast("int").alias("class")).agg(F.sum("n").alias("n")).collect()  # ENDINGS rows
    all_words = sum(r["n"] for r in by_class)
    for r in by_class:
        frequency[r["class"]] = r["n"]
    for r in top:
        frequency[ending(bytes(r["word"]))] -= r["n"]
    tree = Tree(frequency)

    n_steps = max(1, -(-all_words // BATCH))
    replicas = max(1, n_steps // DEPTH)
    rows = base.withColumn("h", F.xxhash64("doc_id", "text")).withColumn("step", F.pmod("h", F.lit(n_steps)))
    encoded = T.StructType([
        T.StructField("step", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_ids", T.ArrayType(base.schema["doc_id"].dataType)),
        T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("firsts", T.ArrayType(T.IntegerType())),
        T.StructField("rare", T.ArrayType(T.BinaryType())), T.StructField("rare_at", T.ArrayType(T.IntegerType())), T.StructField("rare_n", T.ArrayType(T.IntegerType())),
    ])
    known = spark.sparkContext.broadcast((vocabulary, len(frequency)))  # WORDS words
    steps = written(rows.repartition("step").sortWithinPartitions("step", "h", "text", "doc_id").mapInArrow(_encode(known), encoded), "steps")

    weights = first_weights(tree)
    turns = -(-n_steps // replicas)
    turn = F.col("pass") * turns + F.floor(F.col("step") / replicas)
    taken = steps.select("step", "ids", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((weights, tree))  # the network: about 3 MB at most
        part = taken.filter(F.floor(turn * ROUNDS / (turns * passes)) == k)
        dealt = part.select(F.pmod("step", F.lit(replicas)).alias("replica"), "pass", "step", "ids").repartition("replica").sortWithinPartitions("replica", "pass", "step")
        trained = dealt.mapInArrow(_train(shared), "block int, tokens long, changes binary")
        parts = trained.groupBy("block").applyInArrow(_average, "block int, changes binary").collect()  # BLOCKS rows
        if parts:
            weights = shaped(flat(weights) + np.concatenate([np.frombuffer(r["changes"], "<f4") for r in sorted(parts, key=lambda r: r["block"])]), weights)
    return vocabulary, tree, weights, frequency, steps, counts


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", passes: int = 1):
    """The vocabulary, the tree and the averaged weights, all of bounded size."""
    return _model(texts(docs, id_col, text_col), passes)[:3]


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, tree, class_logs = shared.value
        w = w | {"scaled": scaled_rows(w)}
        for b in batches:
            for k in range(b.num_rows):
                sizes, firsts, rare_at = (b.column(c)[k].values.to_numpy() for c in ("sizes", "firsts", "rare_at"))
                target, context = unpacked(b.column("ids")[k].as_py(), len(tree.depth))
                ends = np.cumsum(sizes)
                units = np.zeros(len(target) + 1, np.int64)
                for j in range(0, len(target), BATCH):
                    logs = forward(w, tree, target[j : j + BATCH], context[:, j : j + BATCH]).astype(np.float64) - class_logs[target[j : j + BATCH]]
                    units[j + 1 : j + 1 + len(logs)] = np.rint(logs * LOG_UNIT)
                upto = np.cumsum(units)
                total = upto[ends] - upto[ends - sizes]
                n_rare = np.bincount(rare_at, minlength=len(sizes))[firsts]  # distinct words of classes
                step = pa.array(np.full(len(sizes), b.column("step")[k].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([step, pa.array(firsts), b.column("doc_ids")[k].values, pa.array(sizes.astype(np.int64)), pa.array(total), pa.array(n_rare)], names=["step", "at", "doc_id", "n_tokens", "total", "n_rare"])

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passes: int = 1) -> DataFrame:
    """One row per row: doc_id, n_tokens, log_likelihood (sum), mean_log_likelihood, n_own_words (distinct words that no other document has)."""
    base = texts(docs, id_col, text_col)
    _, tree, weights, frequency, steps, counts = _model(base, passes)
    schema = T.StructType([
        T.StructField("step", T.LongType()), T.StructField("at", T.IntegerType()),
        T.StructField("doc_id", base.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("total", T.LongType()), T.StructField("n_rare", T.LongType()),
    ])
    class_logs = np.where(np.arange(len(frequency)) >= ENDINGS, 0, np.log(np.maximum(frequency, 1)))
    shared = docs.sparkSession.sparkContext.broadcast((weights, tree, class_logs))
    scored = steps.select("step", "ids", "doc_ids", "sizes", "firsts", "rare_at").mapInArrow(_score(shared), schema)
    # A word of a class adds its log count, less the class's (above). Words that occur once add none. One join strategy at every size.
    rare = steps.select("step", F.explode(F.arrays_zip("rare", "rare_at", "rare_n")).alias("r")).select("step", F.col("r.rare_at").alias("at"), F.col("r.rare").alias("word"), F.col("r.rare_n").alias("k"))
    known = counts.filter("n > 1").select("word", "n", F.round(F.ln("n") * LOG_UNIT).cast("long").alias("log"))
    shares = rare.join(known.hint("shuffle_hash"), "word").groupBy("step", "at").agg(F.sum(F.col("log") * F.col("k")).alias("share"), F.count_if(F.col("n") > F.col("k")).alias("elsewhere"))
    likelihood = (F.col("total") + F.coalesce("share", F.lit(0))) / LOG_UNIT
    own = F.col("n_rare") - F.coalesce("elsewhere", F.lit(0))
    joined = scored.join(shares.hint("shuffle_hash"), ["step", "at"], "left")
    return joined.select("doc_id", "n_tokens", likelihood.alias("log_likelihood"), F.try_divide(likelihood, F.col("n_tokens")).alias("mean_log_likelihood"), own.alias("n_own_words"))
