"""Words of quotes, captions over values, claimed entities and resolved fields on pages laid out from orders and their lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import spans as S
from . import query
from .grids import ONCE, order_lines


def quoted_words(li):
    """A line of words for each order line."""
    said = F.array(F.col("l_linenumber").cast("string"), F.lit("part"), F.col("l_partkey").cast("string"), F.lit("flag"), F.col("l_linestatus"))
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("nth").alias("line"), F.posexplode(said).alias("word_idx", "text"))
    return rows.select("*", (F.col("word_idx") * 50.0).alias("left"), (F.col("line") * 20.0).alias("top"), F.lit(40.0).alias("width"), F.lit(10.0).alias("height"))


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nth, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS after FROM ({ONCE}))
    SELECT l_orderkey * 20 + l_linenumber AS quote_id, CAST(2 AS INTEGER) AS n_words, 'part ' || l_partkey AS text, round(50 / 500, 6)::DOUBLE AS xmin, round(nth * 20 / 200, 6)::DOUBLE AS ymin, round(140 / 500, 6)::DOUBLE AS xmax, round((nth * 20 + 10) / 200, 6)::DOUBLE AS ymax FROM l
    UNION ALL SELECT l_orderkey * 20 + l_linenumber + 10, 3, 'flag ' || l_linestatus || ' ' || after, 0, round(nth * 20 / 200, 6), round(240 / 500, 6), round((nth * 20 + 30) / 200, 6) FROM l WHERE after IS NOT NULL""")
def quote_box(t):
    """Each line's part with a thousands comma, two words of it, and a quote that runs over the break into the next line."""
    all_lines = order_lines(t)
    words = quoted_words(all_lines)
    after = F.lead("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    li = all_lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("nth").alias("line"), "l_linenumber", "l_partkey", "l_linestatus", after.alias("after"))
    key = F.col("doc_id") * 20 + F.col("l_linenumber")
    one = li.select(key.alias("quote_id"), "doc_id", "page", "line", F.concat(F.lit("Part|"), F.format_number("l_partkey", 0)).alias("quote"))
    two = li.filter("after IS NOT NULL").select((key + 10).alias("quote_id"), "doc_id", "page", "line", F.concat(F.lit("FLAG | "), "l_linestatus", F.lit("\n"), "after").alias("quote"))
    found = S.quote_box(words, one, 1, 500.0, 200.0).unionByName(S.quote_box(words, two, 2, 500.0, 200.0))
    return found.select("quote_id", "n_words", "text", "box.*")


def stacked_page(t):
    """For each order: a caption in capitals, one set smaller, each over two values of which the nearer counts, and a list of items that are nobody's captions."""
    seg = lambda line, segment, text, left, top, size: F.struct(F.lit(line).alias("line"), F.lit(segment).alias("segment"), text.alias("text"), F.lit(left).alias("left"), F.lit(top).alias("top"), F.lit(top + 10.0).alias("bottom"), F.lit(10.0).alias("height"), F.lit(size).alias("size"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    made = [
        seg(0, 0, F.lit("ORDER DATE"), 10.0, 10.0, 10.0), seg(0, 1, F.lit("Alpha Item"), 110.0, 10.0, 10.0), seg(0, 2, F.lit("Urgency Level:"), 210.0, 10.0, 8.0),
        seg(1, 0, F.lit("Beta Item"), 110.0, 24.0, 10.0), seg(2, 0, day, 16.0, 30.0, 10.0), seg(2, 1, F.lower("o_orderpriority"), 190.0, 32.0, 10.0),
        seg(3, 0, F.lit("a later value"), 10.0, 44.0, 10.0), seg(3, 1, F.lit("another one"), 210.0, 44.0, 10.0), seg(4, 0, F.lit("TOO FAR"), 310.0, 60.0, 10.0), seg(5, 0, F.lit("to be its value"), 310.0, 120.0, 10.0),
    ]
    return t("orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.explode(F.array(*made)).alias("s")).select("doc_id", "page", "s.*")


@query("""SELECT o_orderkey AS doc_id, 'ORDER DATE' AS caption, strftime(o_orderdate, '%Y-%m-%d') AS value, 10.0::DOUBLE AS gap FROM orders
    UNION ALL SELECT o_orderkey, 'Urgency Level:', lower(o_orderpriority), 12.0 FROM orders""")
def stacked_captions(t):
    return S.stacked_captions(stacked_page(t), 400.0).select("doc_id", "caption", "value", "gap")


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS c, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
    SELECT id, 'website' AS kind, 'www.x' || c || '.com/' || d AS value, CAST(4 AS INTEGER) AS b FROM o UNION ALL SELECT id, 'invoice_number', 'INV/' || d, 24 + length(c::VARCHAR) + 5 FROM o UNION ALL SELECT id, 'date', d, 48 + length(c::VARCHAR) FROM o""")
def entity_claims(t):
    """Dates inside an address and inside a number are theirs; the one that stands alone is a date."""
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.concat(F.lit("See www.x"), "o_custkey", F.lit(".com/"), d, F.lit(" and INV/"), d, F.lit(" due "), d, F.lit("."))
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate").repartition("o_orderkey")  # patterns are dear and the file is small: all cores get rows
    found = orders.select(F.col("o_orderkey").alias("id"), S.clean_text(text).alias("t")).select("id", S.entity_matches(F.col("t")).alias("f"))
    rows = found.select("id", F.explode_outer(S.claimed(F.col("f"))).alias("m")).filter("m IS NOT NULL")  # outer: or all is made twice, once to filter empty ones out
    return rows.select("id", "m.kind", "m.value", "m.b")


#: Forms in a part: a form is one row until its words are laid out and sorted in one task.
PART_FORMS = 50_000


def form(t):
    """A form for each order: a title, a number that is labelled and typed, a caption over a name, and two dates without labels."""
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = max(orders.sparkSession.sparkContext.defaultParallelism, -(-orders.count() // PART_FORMS))  # counted from the files' footers
    orders = orders.repartition(parts, "o_orderkey")  # dealt by page once, while rows are narrow and before patterns, which are dear
    d = lambda days: F.date_format(F.date_add("o_orderdate", days), "yyyy-MM-dd")
    said = [
        (0, 0, "Invoice", 20.0, 5.0, 20.0), (0, 0, "Summary", 120.0, 5.0, 20.0), (1, 0, "Invoice", 20.0, 150.0, 10.0), (1, 0, "No.:", 70.0, 150.0, 10.0), (1, 0, F.concat(F.lit("INV-"), "o_orderkey"), 110.0, 150.0, 10.0),
        (2, 0, "TEAM", 20.0, 300.0, 10.0), (2, 0, "CAPTAIN", 70.0, 300.0, 10.0), (3, 0, "sam", 20.0, 320.0, 10.0), (3, 0, F.concat(F.lit("person"), "o_custkey"), 70.0, 320.0, 10.0),
        (4, 0, "from", 20.0, 500.0, 10.0), (4, 0, d(0), 70.0, 500.0, 10.0), (4, 0, "until", 150.0, 500.0, 10.0), (4, 0, d(30), 200.0, 500.0, 10.0),
    ]
    word = lambda i, x: F.struct(F.lit(x[0]).alias("line"), F.lit(x[1]).alias("segment"), F.lit(i).alias("word_idx"), (F.lit(x[2]) if isinstance(x[2], str) else x[2]).alias("text"), F.lit(x[3]).alias("left"), F.lit(x[4]).alias("top"), F.lit(x[5]).alias("size"))
    rows = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.explode(F.array(*[word(i, x) for i, x in enumerate(said)])).alias("w")).select("doc_id", "page", "w.*")
    return rows.select("*", F.lit(40.0).alias("width"), F.col("size").alias("height"), F.when(F.col("line") == 3, 0.5).otherwise(1.0).alias("conf"))


@query("""WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS e FROM orders)
    SELECT o_orderkey AS doc_id, unnest(['document_title', 'document_type', 'invoice_number', 'team_captain', 'date_1', 'date_2']) AS name, unnest(['Invoice Summary', 'Invoice', 'INV-' || o_orderkey, 'sam person' || o_custkey, d, e]) AS value,
        unnest(['heading', 'heading', 'pattern', 'stacked', 'loose', 'loose']) AS rule, unnest([0.75, 0.75, 0.95, 0.35, 0.62, 0.62])::DOUBLE AS confidence, unnest([20, 20, 110, 20, 70, 200])::DOUBLE / 1000 AS xmin FROM o""")
def page_fields(t):
    """Everything a form says, each fact once."""
    return S.resolve_fields(S.segment_fields(form(t), 1000.0, 1000.0)).select("doc_id", "name", "value", "rule", F.round("confidence", 6).alias("confidence"), F.col("box.xmin").alias("xmin"))
