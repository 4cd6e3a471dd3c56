"""Text expressions: cleaning, canonical labels and shape tests. Java's ``\\w`` needs ``(?U)`` to know accents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import strip

#: HTML entities that are undone, and short forms of legal words.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " "}
FORMS = {
    "corporation": "corp",
    "corporated": "corp",
    "incorporated": "inc",
    "limited": "ltd",
    "company": "co",
    "private": "pvt",
    "brothers": "bros",
    "international": "intl",
    "associates": "assoc",
    "manufacturing": "mfg",
    "department": "dept",
    "industries": "ind",
    "enterprises": "ent",
}
TRUE_WORDS, FALSE_WORDS = ("yes", "y", "true", "t", "1"), ("no", "n", "false", "f", "0")
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def fix_syntax(c: Column) -> Column:
    """Undoes entities, drops control characters, makes every run of white space one blank, strips."""
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"(?U)\s+", " "))


def canonical(c: Column) -> Column:
    """Lower case without punctuation, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]+", ""), r"(?U)\s+", " "))


def entity_key(c: Column) -> Column:
    """The canonical label with company forms spelled one way."""
    forms = F.create_map(*[F.lit(x) for pair in FORMS.items() for x in pair])
    return F.array_join(F.transform(F.split(canonical(c), " "), lambda w: F.coalesce(F.element_at(forms, w), w)), " ")


def digits(c: Column) -> Column:
    """Labels with different digits are never one."""
    return F.array_join(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), ",")


def number(c: Column) -> Column:
    """A number in text: thousands' commas and currency signs off, unreadable as null, NaN as null."""
    value = F.regexp_replace(strip(c), r"[,$₹]", "").try_cast("double")
    return F.when(~F.isnan(value), value)


def year(c: Column) -> Column:
    """The first 19xx or 20xx."""
    return F.regexp_extract(c, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1).try_cast("int")


def boolean(c: Column) -> Column:
    w = F.lower(strip(c))
    return F.when(w.isin(*TRUE_WORDS), True).when(w.isin(*FALSE_WORDS), False)


def full_match(c: Column, pattern: str) -> Column:
    return strip(c).rlike(f"^(?:{pattern})$")


def first_number(c: Column) -> Column:
    return F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0).try_cast("double")
