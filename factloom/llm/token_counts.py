"""Exact token counts by prefix dynamic programming, without encoding.

For a piece of bytes, the DP keeps for every prefix the last token of its encoding and its count: the last
token is the one vocabulary entry ending there whose predecessor's last token may stand before it. A pair may
stand together when merging its joined bytes gives the pair back. The counts of all prefixes of a piece are stored,
and those of a text's pieces add up: ``token_counts`` sums them and cuts a text at its limit by looking them up, and
``prefix_table`` stores the count at every prefix of every document, from which ``within_budget`` answers questions of
budget and truncation by DataFrame functions alone, without text or tokenizer.

Null and empty texts have no tokens. Repeated rows are counted alone. A special token's string inside
a text is one token, as the library treats it by default; a prefix that ends inside it is plain text.
"""

from __future__ import annotations

import itertools
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, texts
from .tokens import PIECES, UNSURE, public_path

#: Bounds of a worker's stored pieces (bytes, by a rough count) and of its answers about pairs; both are emptied when full.
STORED_BYTES, PAIRS = 80_000_000, 600_000


def _byte_alphabet() -> dict[str, int]:
    """The vocabulary file's printable stand-ins for bytes: printable Latin-1 is itself, the rest counts up from U+0100."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Stored(dict):
    """piece -> the counts of its prefixes, made when first asked for; emptied between texts once it is large."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter, self.held = counter, 0

    def __missing__(self, piece: str) -> bytes | list[int]:
        counts = self.counter.prefixes(piece.encode("utf-8", "surrogatepass"))
        if not piece.isascii():
            counts = [0, *[counts[k] for k in itertools.accumulate(len(c.encode("utf-8", "surrogatepass")) for c in piece)]]
        self[piece] = counts = bytes(counts) if max(counts) < 256 else counts
        self.held += 150 + (1 if isinstance(counts, bytes) else 8) * len(counts) + len(piece)
        return counts

    def trim(self) -> None:
        if self.held > STORED_BYTES:
            self.clear()
            self.held = 0


class PrefixCounter:
    """Counts of all prefixes of a text, by the vocabulary and merges of a byte-level BPE file."""

    _held: dict[str, PrefixCounter] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = _byte_alphabet(), spec["model"]
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.vocabulary = {raw(s): i for s, i in model["vocab"].items() if s not in self.special}
        self.bytes_of = {i: b for b, i in self.vocabulary.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(self.vocabulary[raw(a)], self.vocabulary[raw(b)]): (k, self.vocabulary[raw(a) + raw(b)]) for k, (a, b) in enumerate(pairs)}
        self.entries = ahocorasick.Automaton()
        for b, i in self.vocabulary.items():
            self.entries.add_word(b.decode("latin-1"), (i, len(b)))
        self.entries.make_automaton()
        # Only token strings that merging really yields can end a prefix.
        self.pairs: dict[tuple[int, int], bool] = {}
        self.stored = Stored(self)
        # The same pattern with the full Unicode classes, for texts outside the simple code points.
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    @classmethod
    def of(cls, path: str) -> PrefixCounter:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first; only for pairs of tokens, whose answers are kept."""
        ids = [self.vocabulary[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            k, at = min(((self.rank.get(p, (1 << 30, 0))[0], i) for i, p in enumerate(itertools.pairwise(ids))))
            if k == 1 << 30:
                break
            ids[at : at + 2] = [self.rank[ids[at], ids[at + 1]][1]]
        return ids

    def stands(self, a: int, b: int) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            known = self.pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def prefixes(self, data: bytes) -> list[int]:
        """counts[i]: tokens of ``data[:i]`` as a piece of its own."""
        pairs = self.pairs
        last, counts = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        for end, (t, size) in self.entries.iter(data.decode("latin-1")):  # the vocabulary's entries that end at each byte
            if counts[end + 1]:
                continue
            if size == end + 1:
                if self.alone(t):
                    last[end + 1], counts[end + 1] = t, 1
            elif (ok := pairs.get((last[end + 1 - size], t))) or (ok is None and self.stands(last[end + 1 - size], t)):
                last[end + 1], counts[end + 1] = t, counts[end + 1 - size] + 1
        return counts

    def alone(self, token: int) -> bool:
        """Whether merging the token's bytes yields the token."""
        if (known := self.pairs.get((token, -1))) is None:
            known = self.pairs[token, -1] = self.merged(self.bytes_of[token]) == [token]
        return known

    def split(self, text: str) -> list[str]:
        simple = text.isascii() or UNSURE.search(text) is None
        return PIECES.findall(text) if simple else self.pieces.findall(text)

    def parts(self, text: str) -> list[str]:
        return [p for p in self.cut.split(text) if p] if self.cut and any(s in text for s in self.special) else [text]

    def of_piece(self, piece: str) -> bytes | list[int]:
        """counts[k]: tokens of the piece's first k code points; stored for the pieces to come."""
        return self.stored[piece]

    def count(self, text: str) -> int:
        self.stored.trim()
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        return sum(1 if p in self.special else sum(self.totals(self.split(p))) for p in self.parts(text))

    def totals(self, pieces: list[str]) -> list[int]:
        return [counts[-1] for counts in map(self.stored.__getitem__, pieces)]

    def _within(self, pieces: list[str], at: int, base: int) -> Iterator[int]:
        """Tokens of the text up to each code point of pieces[at], given the tokens before the piece."""
        piece = pieces[at]
        counts = self.of_piece(piece)
        before = pieces[at - 1] if at and pieces[at - 1].isspace() else ""
        for k in range(1, len(counts)):
            if piece[0] == "'" and len(piece) > 1 and piece[1:2].isalpha() and 1 < k < len(counts) - 1:
                yield base + counts[1] + self.of_piece(piece[1:k])[-1]  # a contraction cut short falls apart
            elif before and k == 1 and piece[0].isspace():
                run = before + piece[0]  # a cut after white space leaves the run whole
                yield base - self.of_piece(before)[-1] + self.of_piece(run)[-1]
            else:
                yield base + counts[k]

    def _plain_prefixes(self, text: str) -> list[int]:
        out, base, pieces = [0], 0, self.split(text)
        for at, piece in enumerate(pieces):
            out += self._within(pieces, at, base)
            base += self.of_piece(piece)[-1]
        return out

    def prefix_counts(self, text: str) -> list[int]:
        """counts[i]: tokens of ``text[:i]`` for every code point."""
        out, base, plain = [0], 0, ""
        for part in self.parts(text):
            if part in self.special:  # until it is whole, it goes on with the plain text before it
                out += [base + n for n in self._plain_prefixes(plain + part[:-1])[len(plain) + 1 :]]
                base += sum(self.totals(self.split(plain))) + 1
                out.append(base)
                plain = ""
            else:
                out += [base + n for n in self._plain_prefixes(part)[1:]]
                plain = part
        return out

    def longest_prefix(self, text: str, limit: int) -> int:
        """Code points of the longest prefix of at most ``limit`` tokens, from stored counts."""
        parts = self.parts(text)
        if len(parts) > 1 or text in self.special:
            return max(k for k, n in enumerate(self.prefix_counts(text)) if n <= limit)
        pieces = self.split(text)
        sums = [0, *itertools.accumulate(self.totals(pieces))]
        k = bisect_right(sums, limit) - 1  # whole pieces that fit; the answer lies near their end
        best = sum(map(len, pieces[:k]))
        for at in range(max(0, k - 1), min(len(pieces), k + 3)):
            start = sum(map(len, pieces[:at]))
            best = max([best, *(start + n for n, c in enumerate(self._within(pieces, at, sums[at]), 1) if c <= limit)])
        return best


def _counts(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter.of(path)
        for b in batches:
            n_tokens, cut = [], []
            for some in chunks(b.column("text").to_pylist()):
                for text in some:
                    n_tokens.append(n := counter.count(text))
                    cut.append(len(text) if n <= limit else counter.longest_prefix(text, limit))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(cut, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"],
            )

    return run


def token_counts(docs: DataFrame, limit: int = 1024, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes, n_tokens, over_limit, fits_chars (code points of the longest prefix within the limit)."""
    base = texts(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    schema = T.StructType([
        T.StructField("doc_id", base.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()), T.StructField("fits_chars", T.LongType()),
    ])
    return base.mapInArrow(_counts(tokenizer or public_path("byte_bpe_50k.json"), limit), schema)


def prefix_table(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, prefix_tokens: the token count of each prefix, from none to all code points."""
    path, base = tokenizer or public_path("byte_bpe_50k.json"), texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter.of(path)
        for b in batches:
            for i, text in enumerate(b.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 1), pa.array([counter.prefix_counts(text)], pa.list_(pa.int32()))], names=["doc_id", "prefix_tokens"])

    return base.mapInArrow(run, T.StructType([T.StructField("doc_id", base.schema["doc_id"].dataType), T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))]))


def within_budget(table: DataFrame, budget: int | Column, prefixes: str = "prefix_tokens") -> DataFrame:
    """``table`` with n_tokens, fits (whole text within the budget) and fits_chars (the longest prefix within it)."""
    counts = F.col(prefixes)
    fitting = F.transform(counts, lambda n, k: F.when(n <= budget, k).otherwise(F.lit(0)))
    n_tokens = F.element_at(counts, -1)
    return table.withColumns({"n_tokens": n_tokens.cast("long"), "fits": n_tokens <= budget, "fits_chars": F.array_max(fitting).cast("long")})
