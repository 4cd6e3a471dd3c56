"""Where things stand on a page: the words of a quote, captions over their values, entities with claimed spans, fields resolved.

Input is ``words(doc_id, page, line, segment, word_idx, text, left, top, width, height, size, conf)`` as ``segments`` leaves them. Boxes are
shares of the page's width and height. What is folded in arrays is a line, a segment, or the fields of one page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pairs as P
from ..functions.frames import once
from .documents import ENTITIES, SIGNS, normalise_quote

#: How sure each rule is; kinds whose matches need a label to be sure.
CONFIDENCE = {"pattern": 0.95, "labelled": 0.90, "stacked": 0.70, "heading": 0.75, "loose": 0.62}
LOOSE = ("date", "amount")
#: Furthest value below a caption in line heights, drift of left edges as a share of the page, words and characters of a caption, its font against the value's.
STACK_GAP, STACK_OVERLAP, STACK_DRIFT, CAPTION_WORDS, CAPTION_CHARS, SMALLER = 4.0, 0.2, 0.06, 5, 40, 0.92
#: Fixed value: what a caption is made of.
CAPTION = r"^[A-Za-z][A-Za-z0-9 &/().'’#-]*$"
#: Kinds of documents, in order of preference.
DOCUMENT_TYPES = [
    "tax invoice", "proforma invoice", "commercial invoice", "invoice", "purchase order", "delivery challan", "credit note", "debit note",
    "receipt", "quotation", "statement of account", "bank statement", "salary slip", "payslip", "agreement", "contract", "certificate",
]
#: Fixed value: how much larger than the page's (upper) median the largest text is when it is a title.
TITLE_SIZE, TITLE_SHARE = 1.6, 0.98


def snake_case(c: Column) -> Column:
    """A label as a field's name."""
    made = F.lower(F.regexp_replace(F.regexp_replace(c, "[^0-9A-Za-z]+", "_"), "^_+|_+$", ""))
    return F.when(made == "", "field").otherwise(made)


def offsets(words: Column, text: str, between: int) -> Column:
    """Begin and end of each word's ``text`` where all are written one after the other with ``between`` characters in between."""
    def add(got: Column, w: Column) -> Column:
        begin = F.when(F.size(got) == 0, F.lit(0)).otherwise(F.element_at(got, -1)["e"] + between)
        return F.concat(got, F.array(F.struct(begin.alias("b"), (begin + F.length(w[text])).alias("e"))))

    return F.aggregate(words, F.array().cast("array<struct<b: int, e: int>>"), add)


def box_of(words: Column, page_width: Column, page_height: Column) -> Column:
    """xmin, ymin, xmax, ymax around some words."""
    end = lambda begin, size: F.array_max(F.transform(words, lambda w: w[begin] + w[size]))
    return shares(F.array_min(words["left"]), F.array_min(words["top"]), end("left", "width"), end("top", "height"), page_width, page_height)


def shares(left: Column, top: Column, right: Column, bottom: Column, page_width: Column, page_height: Column) -> Column:
    side = lambda edge, by: F.round(edge / by, 6)
    return F.struct(side(left, page_width).alias("xmin"), side(top, page_height).alias("ymin"), side(right, page_width).alias("xmax"), side(bottom, page_height).alias("ymax"))


def mean_conf(words: Column) -> Column:
    return F.aggregate(words, F.lit(0.0), lambda s, w: s + F.coalesce(w["conf"], F.lit(1.0)), lambda s: s / F.size(words))


def quote_box(words: DataFrame, quotes: DataFrame, span: int = 1, page_width: float = 1.0, page_height: float = 1.0) -> DataFrame:
    """quotes(quote_id, doc_id, page, line, quote) found in words: quote_id, n_words, text and box of the shortest run of neighbouring words that
    holds the quote, from the cited line on over at most ``span`` lines; of equally short ones the first.

    Commas, bars, white space and case do not count. Words' begins and ends in the joined text are running sums of their lengths; a place of the quote
    there names its first and last word. A quote that is nowhere, or says nothing, has no row.
    """
    word = F.struct("left", "word_idx", "text", "top", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), normalise_quote(F.col("text")).alias("n"))
    line = ["doc_id", "page", "line"]
    lines = words.groupBy(*line).agg(F.array_sort(F.collect_list(word)).alias("_w"))
    q = quotes.select("quote_id", *line, normalise_quote(F.col("quote")).alias("_q")).filter("_q <> ''")
    q = q.dropna(subset=line).groupBy(*line).agg(F.collect_list(F.struct("quote_id", "_q")).alias("_asked"))
    # A line and what cites it meet in a group, not a join: where both are dealt by page or document already, neither is dealt again.
    rows = lines.unionByName(q, allowMissingColumns=True).groupBy(*line).agg(F.first("_w", ignorenulls=True).alias("_w"), F.first("_asked", ignorenulls=True).alias("_asked"))
    if span > 1:
        ahead = Window.partitionBy("doc_id", "page").orderBy("line").rowsBetween(0, span - 1)
        rows = rows.filter("_w IS NOT NULL").withColumn("_w", F.flatten(F.collect_list("_w").over(ahead)))
    rows = rows.filter("_w IS NOT NULL AND _asked IS NOT NULL").withColumn("_s", F.array_join(F.transform("_w", lambda w: w["n"]), ""))
    rows = rows.select("_w", "_s", F.explode("_asked").alias("_a")).select("_w", "_s", "_a.*").filter(F.contains("_s", F.col("_q"))).withColumn("_o", offsets(F.col("_w"), "n", 0))
    size = F.length("_q")
    # Of the places that begin in one word the first ends soonest, so one place from each word's begin on is enough.
    places = F.filter(F.array_distinct(F.transform("_o", lambda o: F.call_function("locate", F.col("_q"), F.col("_s"), o["b"] + 1))), lambda p: p > 0)
    held = lambda at: F.size(F.filter("_o", lambda o: o["e"] < at))  # noqa: E731  (words that end before a character)
    runs = F.transform(F.transform(places, lambda p: F.struct(held(p).alias("first"), held(p + size - 1).alias("last"))), lambda x: F.struct((x["last"] - x["first"]).alias("more"), x["first"].alias("first")))
    rows = rows.withColumn("_r", F.array_min(runs)).withColumn("_w", F.slice("_w", F.col("_r.first") + 1, F.col("_r.more") + 1))
    return rows.select("quote_id", F.size("_w").alias("n_words"), F.array_join(F.transform("_w", lambda w: w["text"]), " ").alias("text"), box_of(F.col("_w"), F.lit(page_width), F.lit(page_height)).alias("box"))


def bare_caption(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), r"[:\s]+$", ""))


def is_caption(bare: Column) -> Column:
    """Could a segment (its ``bare_caption``) be a caption: a few words without sentence marks, in capitals or each with one."""
    upper = (bare == F.upper(bare)) | ~bare.rlike(r"(?:^|\s)(?!\p{Lu})\p{L}")
    return (bare != "") & (F.size(F.split(bare, r"\s+")) <= CAPTION_WORDS) & bare.rlike(CAPTION) & (F.length(bare) <= CAPTION_CHARS) & upper


def in_capitals(text: Column) -> Column:
    return (text == F.upper(text)) & (text != F.lower(text))


def stacked_captions(segs: DataFrame, page_width: float, carry: list[str] | None = None) -> DataFrame:
    """doc_id, page, caption_line, caption_segment, caption, line, segment, value, gap: each caption with the nearest segment below it.

    ``segs(doc_id, page, line, segment, text, left, top, bottom, height, size)``. Below is: left edges within 6 % of the page's width, and from a fifth of the
    caption's line height above its bottom to four heights under it; of equally near ones the first in reading order. The nearest must
    also look like a value: not in capitals under a caption in capitals, or set larger. Left edges are joined by buckets as wide as the drift; the captions,
    fewer than the segments, go to their own and both next to it. Columns to ``carry`` come along from the value's segment. The join is a merge join at
    every size: estimates made before segments are exploded out of rows are too small by far to broadcast a side by.
    """
    drift = STACK_DRIFT * page_width
    carry = carry or []
    bucket = F.floor(F.col("left") / drift)
    near = segs.select("doc_id", "page", *[F.col(c).alias(f"v_{c}") for c in ("line", "segment", "text", "left", "top", "size", *carry)], bucket.alias("_bucket"))
    # A filter by the text would go below the steps that make the text, and make it wherever it is named there.
    buckets = F.when(is_caption(F.col("_bare")), F.array(*[bucket + k for k in (-1, 0, 1)]))
    heads = segs.withColumn("_bare", bare_caption(F.col("text"))).select("doc_id", "page", "line", "segment", "text", "left", "bottom", "height", "size", F.explode_outer(buckets).alias("_bucket")).filter("_bucket IS NOT NULL")
    gap = F.col("v_top") - F.col("bottom")
    below = (gap >= -STACK_OVERLAP * F.col("height")) & (gap <= STACK_GAP * F.col("height")) & (F.abs(F.col("v_left") - F.col("left")) <= drift)
    other = (F.col("line") != F.col("v_line")) | (F.col("segment") != F.col("v_segment"))
    pairs = heads.hint("merge").join(near, ["doc_id", "page", "_bucket"]).filter(below & other)
    best = pairs.groupBy("doc_id", "page", "line", "segment").agg(F.min(F.struct(gap.alias("gap"), "v_line", "v_segment", "v_text", "v_size", "text", "size", *[f"v_{c}" for c in carry])).alias("b"))
    marked = (in_capitals(F.col("b.text")) & ~in_capitals(F.col("b.v_text"))) | (F.col("b.size") < SMALLER * F.col("b.v_size"))
    return best.filter(marked & (F.trim("b.v_text") != "")).select(
        "doc_id", "page", F.col("line").alias("caption_line"), F.col("segment").alias("caption_segment"), F.col("b.text").alias("caption"),
        F.col("b.v_line").alias("line"), F.col("b.v_segment").alias("segment"), F.col("b.v_text").alias("value"), F.col("b.gap").alias("gap"), *[F.col(f"b.v_{c}").alias(c) for c in carry],
    )


def clean_text(text: Column) -> Column:
    """A text without the character that marks matches."""
    return F.translate(text, "\x01\x02", "  ")


def entity_matches(clean: Column, kinds: list[str] | None = None) -> Column:
    """Structs (prio, b, e, kind, value) of the typed patterns' matches in a clean text.

    Matches of a pattern are marked in the text and the text is cut at the marks (one character: no pattern is compiled for a row); positions are sums
    of the pieces' lengths. A text is marked and cut only for kinds it has.
    """
    none = F.array().cast("array<struct<prio: int, b: int, e: int, kind: string, value: string>>")

    def matches(prio: int, kind: str) -> Column:
        def add(got: Column, piece: Column) -> Column:
            end = got["at"] + F.length(piece)
            match = F.struct(F.lit(prio).alias("prio"), got["at"].alias("b"), end.alias("e"), F.lit(kind).alias("kind"), piece.alias("value"))
            return F.struct((got["n"] + 1).alias("n"), end.alias("at"), F.when(got["n"] % 2 == 1, F.concat(got["found"], F.array(match))).otherwise(got["found"]).alias("found"))

        pieces = F.split(F.regexp_replace(clean, ENTITIES[kind], "\x01$0\x01"), "\x01")
        return F.aggregate(pieces, F.struct(F.lit(0).alias("n"), F.lit(0).alias("at"), none.alias("found")), add, lambda got: got["found"])

    every = F.flatten(F.array(*[F.when(clean.rlike(ENTITIES[k]), matches(i, k)).otherwise(none) for i, k in enumerate(kinds or ENTITIES)]))
    return F.when(~clean.rlike(SIGNS), none).when(clean.isNotNull(), every)


def claimed(found: Column) -> Column:
    """Matches without those inside a match of a kind before theirs. A match inside another that is itself inside a third is inside the third, so nothing
    depends on which have been taken out before."""
    outer = lambda m, o: (o["prio"] < m["prio"]) & (o["b"] <= m["b"]) & (m["e"] <= o["e"])
    return F.when(F.size(found) < 2, found).otherwise(F.filter(found, lambda m: ~F.exists(found, lambda o: outer(m, o))))


def entity_spans(text: Column, kinds: list[str] | None = None) -> Column:
    """Structs (prio, b, e, kind, value) of the typed patterns' matches, each character claimed once. In steps of their own (``clean_text``,
    ``entity_matches``, ``claimed``) patterns run in compiled code."""
    return once(clean_text(text), lambda clean: once(entity_matches(clean, kinds), claimed))


def segment_fields(words: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """doc_id, page, name, value, rule, confidence, box of what a page's segments say: typed patterns (each character claimed once), label-value
    pairs, the document's kind, captions over values, and the title. Confidence is the rule's times the mean of the words'."""
    w, h = F.lit(float(page_width)), F.lit(float(page_height))
    width, height = F.col("width").cast("double"), F.col("height").cast("double")
    word = F.struct("left", "word_idx", "text", "top", width.alias("width"), height.alias("height"), "conf")
    sides = {"left": F.min("left"), "top": F.min("top"), "right": F.max(F.col("left") + width), "bottom": F.max(F.col("top") + height), "height": F.max(height), "size": F.max("size")}
    segs = words.groupBy("doc_id", "page", "line", "segment").agg(F.sort_array(F.collect_list(word)).alias("ws"), *[c.alias(k) for k, c in sides.items()])
    segs = segs.withColumn("text", F.array_join("ws.text", " "))
    # Most segments say nothing that is looked for: where they do not, nothing is placed among their words.
    low = F.lower("text")
    kinds = F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.array(F.struct(F.locate(k, low).alias("b"), F.lit(len(k)).alias("n")))) for k in DOCUMENT_TYPES])
    kind = F.when(low.rlike("|".join(DOCUMENT_TYPES)), kinds).otherwise(F.array().cast("array<struct<b: int, n: int>>"))
    said = segs.withColumn("_clean", clean_text(F.col("text"))).withColumns({"_found": entity_matches(F.col("_clean")), "_pair": F.get(P.pairs(F.col("text")), 0), "_kind": kind})
    said = said.withColumn("_spans", claimed(F.col("_found")))
    said = said.withColumn("_o", F.when((F.size("_spans") > 0) | (F.size("_kind") > 0), offsets(F.col("ws"), "text", 1)))
    touched = lambda b, e: F.filter("ws", lambda _, i: (F.get("_o.b", i) < e) & (F.get("_o.e", i) > b))
    field = lambda name, value, rule, ws: F.struct(name.alias("name"), value.alias("value"), rule.alias("rule"), ws.alias("ws"))
    typed = F.transform("_spans", lambda m: field(m["kind"], m["value"], F.when(m["kind"].isin(*LOOSE), "loose").otherwise("pattern"), touched(m["b"], m["e"])))
    # The words of a value: those after the one with the colon, and that one if something follows its colon.
    colon = F.array_position(F.transform("ws", lambda x: F.contains(x["text"], F.lit(":"))), F.lit(True))
    follows = lambda c: F.trim(F.substring_index(F.element_at("ws", F.greatest(c, F.lit(1)).cast("int"))["text"], ":", -1)) != ""
    after = once(colon, lambda c: F.when(c > 0, F.slice("ws", F.when(follows(c), c).otherwise(c + 1).cast("int"), F.size("ws"))))
    labelled = lambda ws: field(snake_case(F.col("_pair.key")), F.array_join(ws["text"], " "), F.lit("labelled"), ws)
    pair = F.when(F.col("_pair").isNotNull(), F.transform(F.filter(F.array(after), lambda ws: F.size(ws) > 0), labelled))
    kind = F.transform("_kind", lambda k: field(F.lit("document_type"), F.substring(F.col("text"), k["b"], k["n"]), F.lit("heading"), touched(k["b"] - 1, k["b"] - 1 + k["n"])))
    none = F.array().cast("array<struct<name: string, value: string, rule: string, ws: array<struct<left: double, word_idx: int, text: string, top: double, width: double, height: double, conf: double>>>>")
    # (Spark filters empty arrays out before it explodes them, and for that makes them twice, unless the explode is an outer one.)
    rows = said.select("doc_id", "page", F.explode_outer(F.concat(typed, F.coalesce(pair, none), kind)).alias("f")).select("doc_id", "page", "f.*")
    # The title: of one page's words, the large ones of the first line that has any.
    large = words.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in ("line", "size")], word.alias("w")))).alias("_w"), F.sort_array(F.collect_list("size")).alias("_z"))
    large = large.withColumns({"_most": F.element_at("_z", -1), "_mid": F.get("_z", F.floor(F.size("_z") / 2).cast("int"))}).filter(F.col("_most") >= TITLE_SIZE * F.col("_mid"))
    large = large.withColumn("_w", F.filter("_w", lambda x: x["size"] >= TITLE_SHARE * F.col("_most")))
    title = large.select("doc_id", "page", F.sort_array(F.transform(F.filter("_w", lambda x: x["line"] == F.array_min("_w.line")), lambda x: x["w"])).alias("ws"))
    rows = rows.unionByName(title.select("doc_id", "page", F.lit("document_title").alias("name"), F.array_join("ws.text", " ").alias("value"), F.lit("heading").alias("rule"), "ws"))
    rows = rows.filter(F.size("ws") > 0).select("doc_id", "page", "name", "value", "rule", mean_conf(F.col("ws")).alias("conf"), box_of(F.col("ws"), w, h).alias("box"))
    flat = segs.withColumns({"conf": mean_conf(F.col("ws")), "box": shares(F.col("left"), F.col("top"), F.col("right"), F.col("bottom"), w, h)})
    stacked = stacked_captions(flat, page_width, ["conf", "box"])
    rows = rows.unionByName(stacked.select("doc_id", "page", snake_case(F.col("caption")).alias("name"), "value", F.lit("stacked").alias("rule"), "conf", "box"))
    sure = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])[F.col("rule")]
    value = F.trim(F.regexp_replace("value", r"(?U)\s+", " "))
    rows = rows.filter(F.col("value").rlike(r"(?U)\S"))
    return rows.select("doc_id", "page", "name", value.alias("value"), "rule", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("conf") * sure)).alias("confidence"), "box")


def resolve_fields(fields: DataFrame) -> DataFrame:
    """One row for each fact: doc_id, page, name, value, rule, confidence, box.

    In order: of rows with one name and value (case aside) the surest; of one name, values that hold or are held by a surer one go; of one
    value the surest name; a date or amount without a label that lies in the box and the text of another field goes. Names that are left more than once on
    a page are numbered from the top. Ties go to what stands first.
    """
    page = ["doc_id", "page"]
    # The fields of one page, the surest first, then by place: whatever follows is within this array.
    v, doubt = F.lower("value"), F.struct(F.col("confidence").isNull(), ~F.isnan("confidence"), -F.col("confidence"))
    item = F.struct(doubt.alias("doubt"), F.col("box.ymin").alias("y"), F.col("box.xmin").alias("x"), "name", v.alias("v"), "value", "rule", "confidence", "box")
    rows = fields.filter(v.isNotNull()).groupBy(*page).agg(F.sort_array(F.collect_list(item)).alias("_f"))
    # Of one name: each is taken unless it holds, or is held by, one that is taken. (What has the same value holds it.)
    clash = lambda got, f: F.exists(got, lambda k: k["name"].eqNullSafe(f["name"]) & (F.contains(k["v"], f["v"]) | F.contains(f["v"], k["v"])))
    none = F.filter("_f", lambda f: F.lit(False))
    rows = rows.withColumn("_f", F.aggregate("_f", none, lambda got, f: F.when(clash(got, f), got).otherwise(F.concat(got, F.array(f)))))
    rows = rows.withColumn("_f", F.filter("_f", lambda f, i: F.array_position("_f.v", f["v"]) == i + 1))
    inside = lambda f, o: (o["box"]["xmin"] <= f["box"]["xmin"]) & (f["box"]["xmax"] <= o["box"]["xmax"]) & (o["box"]["ymin"] <= f["box"]["ymin"]) & (f["box"]["ymax"] <= o["box"]["ymax"])
    holds = lambda f, o: (F.struct(o["name"], o["v"]) != F.struct(f["name"], f["v"])) & F.contains(o["v"], f["v"]) & inside(f, o)
    rows = rows.withColumn("_f", F.filter("_f", lambda f: ~(f["name"].isin(*LOOSE) & F.exists("_f", lambda o: holds(f, o)))))
    # By name and from the top, a field's number is how far it stands behind the first of its name.
    rows = rows.withColumn("_f", F.sort_array(F.transform("_f", lambda f: F.struct(f["name"].alias("name"), f["y"].alias("y"), f["x"].alias("x"), f["value"].alias("value"), f["rule"].alias("rule"), f["confidence"].alias("confidence"), f["box"].alias("box")))))
    rows = rows.select(*page, F.col("_f.name").alias("_names"), F.posexplode_outer("_f").alias("_i", "_f")).filter("_i IS NOT NULL").select(*page, "_names", "_i", "_f.*")  # outer: as above
    nth = F.col("_i") + 2 - F.array_position("_names", F.col("name"))
    numbered = F.when((nth > 1) | (F.get("_names", F.col("_i") + 1) == F.col("name")), F.concat("name", F.lit("_"), nth)).otherwise(F.col("name"))
    return rows.select(*page, numbered.alias("name"), "value", "rule", "confidence", "box")
