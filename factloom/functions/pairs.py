"""Label and value pairs in a line, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .frames import once

#: Marks that open a list's item, one of an ordered list, a pair, a label's characters, where a value is prose.
LIST_MARK = r"^\s*(?:\(cid:\d+\)|[•·◦▪‣∙*\-–—]|\(?\d{1,2}[.)]|\(?[a-zA-Z][.)])\s*"
ORDERED = r"^\(?[\dA-Za-z][.)]"
PAIR = r"^\s*([^:\n]{1,45}?)\s*[:：]\s*(\S.*)$"
LABEL = r"^[A-Za-z#][A-Za-z0-9 \-/&.'’#]*$"
PROSE = r"[.!?]\s+[A-Z(]"
#: Words of a label and characters of a value at most; words that make a clause of a label.
LABEL_WORDS, VALUE_CHARS = 5, 120
CLAUSE = (
    "is are was were be been being am has have had do does did will would shall should can could may might must that which there this "
    "these those it they we you he she who whose when while because if"
).split()


def cells_of(line: Column) -> Column:
    """The parts of a line between bars; a part that begins with a colon belongs to the one before it."""
    parts = F.filter(F.transform(F.split(line, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    joined = lambda got, p: F.concat(F.slice(got, 1, F.size(got) - 1), F.array(F.concat_ws(" ", F.element_at(got, -1), p)))
    return F.aggregate(parts, F.array().cast("array<string>"), lambda got, p: F.when(p.startswith(":") & (F.size(got) > 0), joined(got, p)).otherwise(F.concat(got, F.array(p))))


def pairs(line: Column) -> Column:
    """Structs (key, value) of a line's label-value pairs, in order: the label a short noun phrase, the value no prose. Of a label in two languages
    with a slash between, the part in Latin letters counts."""
    raw = F.transform(cells_of(line), lambda c: F.struct(F.trim(F.regexp_extract(c, PAIR, 1)).alias("label"), F.trim(F.regexp_replace(F.trim(F.regexp_extract(c, PAIR, 2)), "^[:：]+", "")).alias("value")))
    latin = lambda label: F.get(F.filter(F.transform(F.split(label, "/"), lambda p: F.trim(p)), lambda p: p.rlike(LABEL)), 0)
    named = F.transform(raw, lambda x: F.struct(F.when(x["label"].rlike(LABEL), x["label"]).when(F.contains(x["label"], F.lit("/")), latin(x["label"])).alias("key"), x["value"].alias("value")))

    def fine(x: Column) -> Column:
        words = F.split(x["key"], r"\s+")
        clause = F.arrays_overlap(F.transform(words, lambda w: F.lower(w)), F.array(*[F.lit(w) for w in CLAUSE]))
        return x["key"].isNotNull() & (x["value"] != "") & (F.size(words) <= LABEL_WORDS) & ~clause & ~x["value"].rlike(PROSE) & (F.length(x["value"]) <= VALUE_CHARS)

    none = F.array().cast("array<struct<key: string, value: string>>")
    return F.when(~line.rlike("[:：]"), none).otherwise(F.filter(named, fine))  # most lines have no colon, and are not cut up


def first_of_each(found: Column) -> Column:
    """Of pairs with one key the first. Neither the pairs nor their keys are made again for each pair."""
    firsts = lambda f, keys: F.filter(f, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    return once(found, lambda f: once(F.transform(f, lambda p: p["key"]), lambda keys: firsts(f, keys)))


def pairs_in_prose(text: Column) -> Column:
    """The first pair of every sentence, its value without a closing point or semicolon."""
    sentences = F.split(text, r"(?<=[.!?;])\s+")
    found = F.filter(F.transform(sentences, lambda s: F.get(pairs(s), 0)), lambda p: p.isNotNull())
    return first_of_each(F.transform(found, lambda p: F.struct(p["key"].alias("key"), F.regexp_replace(p["value"], "[.;]+$", "").alias("value"))))


def line_kind(line: Column, found: Column) -> Column:
    """list, key_values or paragraph; ``found``: the line's pairs."""
    return F.when(line.rlike(LIST_MARK), "list").when(F.size(found) > 0, "key_values").otherwise("paragraph")


def unwrapped(parts: Column) -> Column:
    """Lines of a paragraph as one text: a hyphen at a line's end that follows a letter goes, and nothing comes between."""
    broken = lambda out: out.endswith("-") & ~out.endswith(" -") & ~out.endswith("--")
    return F.aggregate(parts, F.lit(""), lambda out, p: F.when(out == "", p).when(broken(out), F.concat(F.left(out, F.length(out) - 1), p)).otherwise(F.concat(out, F.lit(" "), p)))
