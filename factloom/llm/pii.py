"""Personal data by anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, plus signs, digits, URL schemes and
identifier and secret cues. At each anchor a deterministic local parser expands to the boundaries and validates
(Luhn, ISO 7064 mod 97, part ranges, digit counts). Base kinds (email, ip, card, phone) give the leftmost
non-overlapping matches of their published expressions; a failing match is dropped and not retried. The
other kinds (url, key, secret, account, ip6) only add spans, each with a column of its own: keys by the published forms of
their issuers, private key blocks and signed tokens; secrets by the name before them (a password's value may be anything,
that of a token, key or bearer must have eight characters and a digit); account numbers and IBANs by cue and checksum.

Offsets are code points, end exclusive. Null and empty texts have no spans. Each row is judged alone, so
repeated rows give equal results.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import texts

#: The kinds in their order, and the base expressions' character sets.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "key", "secret", "account", "ip6")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SCHEME_REST = re.compile(r"[^\s<>\"']+")
#: Published forms of keys and tokens, by the text they begin with.
KEY_FORMS = {
    "AKIA": re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    "ASIA": re.compile(r"ASIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    "AIza": re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    "ghp_": re.compile(r"ghp_[0-9A-Za-z]{30,}"),
    "gho_": re.compile(r"gho_[0-9A-Za-z]{30,}"),
    "ghs_": re.compile(r"ghs_[0-9A-Za-z]{30,}"),
    "github_pat_": re.compile(r"github_pat_[0-9A-Za-z_]{40,}"),
    "glpat-": re.compile(r"glpat-[0-9A-Za-z_-]{20,}"),
    "sk_live_": re.compile(r"sk_live_[0-9A-Za-z]{16,}"),
    "sk_test_": re.compile(r"sk_test_[0-9A-Za-z]{16,}"),
    "rk_live_": re.compile(r"rk_live_[0-9A-Za-z]{16,}"),
    "xoxb-": re.compile(r"xoxb-[0-9A-Za-z-]{16,}"),
    "xoxp-": re.compile(r"xoxp-[0-9A-Za-z-]{16,}"),
    "eyJ": re.compile(r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]+"),
    "-----BEGIN ": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[0-9A-Za-z+/=:,\s-]*?-----END [A-Z ]*PRIVATE KEY-----)?"),
}
#: Names before a secret's value: those of passwords, and those whose value must look like a key.
PASSWORD_NAMES = ("password", "passwd", "passphrase", "pwd")
TOKEN_NAMES = ("token", "secret", "api_key", "api-key", "apikey", "access_key", "auth_key", "client_secret", "private_key", "authorization", "bearer")
PASSWORD = re.compile(r"[\"']?\s?[=:]\s?[\"']?([^\s,;\"']+)")
TOKEN = re.compile(r"[\"']?\s?(?:[=:]\s?|\s)(?:[Bb]earer |[Bb]asic )?[\"']?((?=[^\s,;\"']*[0-9])[0-9A-Za-z._~+/=-]{8,})")
IBAN = re.compile(r"[ :#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
ACCOUNT = re.compile(r"(?:[ :#.]|no|number){0,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.IGNORECASE)
CUES = {"://": "url", ":": "colon", "iban": "iban", "account": "account", "acct": "account"} | dict.fromkeys(PASSWORD_NAMES, "password") | dict.fromkeys(TOKEN_NAMES, "token")
SIX = re.compile(r"[0-9A-Fa-f:]+(?:[0-9]+(?:\.[0-9]+){3})?")
HEX = frozenset("0123456789abcdefABCDEF")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for cue, kind in CUES.items():
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, (kind, len(form)))
    for form in KEY_FORMS:
        a.add_word(form, ("key", len(form)))
    a.make_automaton()
    return a


def six(text: str) -> bool:
    try:
        return text.count(":") > 1 and any(c in HEX for c in text) and bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    end = dict.fromkeys(KINDS, 0)  # where the next match of a kind may start
    for last, (cue, n) in automaton.iter(text):
        at = last - n + 1
        if cue == "digit":
            if at >= end["ip"] and not (at and text[at - 1].isascii() and text[at - 1].isdigit()) and (m := IP.match(text, at)):
                end["ip"] = m.end()
                if all(map(small_part, m[0].split("."))):
                    found["ip"].append(m.span())
            if at >= end["card"] and (m := CARD.match(text, at)):
                end["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        elif cue == "at":
            start = at
            while start > end["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                end["email"] = m.end()
                found["email"].append((start, m.end()))
        elif cue == "plus":
            if at >= end["phone"] and (m := PHONE.match(text, at)):
                end["phone"] = m.end()
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    found["phone"].append(m.span())
        elif cue == "url":
            start = at
            while start > end["url"] and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if start < at and (m := SCHEME_REST.match(text, last + 1)):
                end["url"] = m.end()
                found["url"].append((start, m.end()))
        elif cue == "key":
            if at >= end["key"] and (m := KEY_FORMS[text[at : last + 1]].match(text, at)):
                end["key"] = m.end()
                found["key"].append(m.span())
        elif cue == "colon":
            start = at
            while start > end["ip6"] and text[start - 1] in HEX:
                start -= 1
            if at >= end["ip6"] and (start == at or start == 0 or not text[start - 1].isalnum()) and (m := SIX.match(text, start)):
                end["ip6"] = m.end()
                if (m.end() == len(text) or not text[m.end()].isalnum()) and six(m[0]):
                    found["ip6"].append(m.span())
        elif cue in ("password", "token"):
            if at >= end["secret"] and (m := (PASSWORD if cue == "password" else TOKEN).match(text, last + 1)):
                end["secret"] = m.end()
                found["secret"].append(m.span(1))
        elif at >= end["account"] and (m := (IBAN if cue == "iban" else ACCOUNT).match(text, last + 1)):
            if cue == "account" or iban(m[1]):
                end["account"] = m.end()
                found["account"].append(m.span(1))
    return [(k, a, z) for k in KINDS for a, z in sorted(found[k])]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


#: Kinds that are added to the base ones, and all kinds that count as private (an address of a page does not).
ADDED = KINDS[len(BASE_KINDS) :]
PRIVATE = frozenset(KINDS) - {"url"}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for b in batches:
        counts: dict[str, list[int]] = {k: [] for k in (*KINDS, "private")}
        base_sha, every = [], []
        for text in b.column("text").to_pylist():
            spans = find_spans(text, automaton)
            n = Counter(s[0] for s in spans)
            for kind in KINDS:
                counts[kind].append(n[kind])
            counts["private"].append(sum(n[k] for k in PRIVATE))
            base_sha.append(hashlib.sha256(joined([s for s in spans if s[0] in BASE_KINDS]).encode()).hexdigest())
            every.append(joined(spans))
        numbers = {f"n_{k}": pa.array(counts[k], pa.int64()) for k in counts}
        base = {c: numbers.pop(c) for c in [f"n_{k}" for k in BASE_KINDS]}
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), **base, "base_sha256": pa.array(base_sha, pa.string()), "spans": pa.array(every, pa.string()), **numbers})


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; then counts of the added kinds, and n_private of all kinds but url."""
    base = texts(docs, id_col, text_col)
    schema = T.StructType([
        T.StructField("doc_id", base.schema["doc_id"].dataType), *[T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS],
        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), *[T.StructField(f"n_{k}", T.LongType()) for k in (*ADDED, "private")],
    ])
    return base.mapInArrow(_scan, schema)


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for b in batches:
        out = []
        for text in b.column("text").to_pylist():
            done, parts = 0, []
            for kind, a, z in sorted(find_spans(text, automaton), key=lambda s: (s[1], -s[2])):
                if a >= done:
                    parts += [text[done:a], f"[{kind}]"]
                    done = z
            out.append("".join([*parts, text[done:]]))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text with each span replaced by its kind in brackets."""
    base = texts(docs, id_col, text_col)
    return base.mapInArrow(_mask, base.schema)
