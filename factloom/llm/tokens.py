"""Token ids of whole texts by the tokenizers library, with a bounded cache of pre-tokens.

A byte-level BPE never merges across the pieces its pattern cuts, so a text's ids are those of its pieces
in order. The library encodes each new piece once per worker, as lines of one text; texts with characters whose class
could differ between Unicode versions, or with a special token's string, go through the library whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array

#: Code points below this one, and general punctuation, have the same class in all Unicode versions in use.
SIMPLE_END = 0x250
#: Bytes a worker's cache may take between batches of texts, by a rough count.
CACHE_BYTES = 80_000_000


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(SIMPLE_END) if unicodedata.category(chr(c))[0] == kind)


LETTERS, NUMBERS, BLANKS = _class("L"), _class("N"), "\t\n\x0b\x0c\r \x85\xa0"
#: The published pattern of the vocabulary, over the simple code points only.
PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
)
UNSURE = re.compile("[^\x00-ɏ‐-‧]")


class Cache(dict):
    """piece -> ids; a new piece gets an empty array, filled when all new ones of some texts are encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> bytearray:
        self.new.append(piece)
        self[piece] = ids = bytearray()
        return ids


class Encoder:
    """Encodes texts with a tokenizer file; one per Python worker."""

    _held: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cache = Cache()
        self.cached = 0
        self.line_end = self.library.encode("\n", add_special_tokens=False).ids

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def simple(self, text: str) -> bool:
        return (text.isascii() or UNSURE.search(text) is None) and not any(s in text for s in self.special)

    def whole(self, text: str) -> bytes:
        """The library's ids of a text, as little-endian unsigned 32-bit integers."""
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _lines(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces without white space inside, a hundred at a time: lines of one text, split again at the line ends."""
        some = [pieces[k : k + 100] for k in range(0, len(pieces), 100)]
        end, out = self.line_end[0], {}
        for part, e in zip(some, self.library.encode_batch_fast(["\n".join(x) for x in some], add_special_tokens=False), strict=True):
            ids, at = array("I", e.ids), 0
            for p in part[:-1]:
                k = ids.index(end, at)
                out[p] = ids[at:k].tobytes()
                at = k + 1
            out[part[-1]] = ids[at:].tobytes()
        return out

    def learn(self) -> None:
        """Encodes the pieces that were met for the first time."""
        new, self.cache.new = self.cache.new, []
        made = self._lines([p for p in new if not p[-1].isspace()]) if len(self.line_end) == 1 else {}
        for p in new:
            self.cache[p].extend(made[p] if p in made else self.whole(p))
        self.cached += 200 * len(new) + sum(map(len, new)) + sum(map(len, made.values()))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if self.cached > CACHE_BYTES:
            self.cache.clear()
            self.cached = 0
        get = self.cache.__getitem__
        parts = [list(map(get, PIECES.findall(t))) if self.simple(t) else None for t in texts]
        self.learn()
        return [b"".join(p) if p is not None else self.whole(t) for p, t in zip(parts, texts, strict=True)]
