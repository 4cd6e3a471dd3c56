"""Guards, closed forms and plans on small frames with expectations worked out by hand."""

import zipfile

import pytest
from pyspark.sql import functions as F

from factloom.functions import dates, statistics, text
from factloom.ledger import EvidenceLedger
from factloom.limits import Refusal
from factloom.operators import aggregate as A
from factloom.operators import claims
from factloom.operators import cleaning as C
from factloom.operators import documents as D
from factloom.operators import join as J
from factloom.operators import profile as P
from factloom.operators import statistics as S
from factloom.plans import cleaning as plan
from factloom.session import EngineSession
from factloom.sources import sheets, workbook


def test_p_values_against_tables(spark):
    assert statistics.t_two_sided(spark, 2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert statistics.chi2_upper(spark, 3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert statistics.f_upper(spark, 4.103, 2, 10) == pytest.approx(0.05, abs=1e-3)
    assert statistics.normal_two_sided(1.96) == pytest.approx(0.05, abs=1e-4)


@pytest.fixture
def pair(spark):
    orders = spark.createDataFrame([(1, 10, 500.0), (2, 10, 200.0), (3, 12, 100.0), (4, 13, 200.0)], "order_id int, customer_id int, revenue double")
    customers = spark.createDataFrame([(10, "a"), (10, "b"), (12, "c"), (99, "d"), (98, "e")], "customer_id int, city string")
    return orders, customers


def test_join_forecast_counts_fan_out_and_orphans(pair):
    keys = [("customer_id", "customer_id")]
    counts = {r["order_id"]: r["matches"] for r in J.match_counts(*pair, keys).collect()}
    assert counts == {1: 2, 2: 2, 3: 1, 4: 0}
    rows = J.forecast_rows(*pair, keys).first()
    assert (rows["inner_rows"], rows["left_rows"], rows["right_rows"], rows["outer_rows"]) == (5, 6, 7, 8)
    for how in J.HOWS:
        assert J.join_datasets(*pair, keys, how).count() == rows[f"{how}_rows"]
    card = J.forecast(*pair, keys, "inner")
    assert "fan-out" in card.flags and "measure lost" in card.flags and card.relationship == "n-n"


def test_join_refuses_without_overlap(pair):
    orders, customers = pair
    assert isinstance(J.forecast(orders, customers.withColumn("customer_id", F.col("customer_id") + 1000), [("customer_id", "customer_id")]), Refusal)
    assert isinstance(J.resolve_keys(orders, customers.toDF("x", "y")), Refusal)
    assert J.resolve_keys(orders, customers) == [("customer_id", "customer_id")]


def test_null_keys_meet_only_null_safely(spark):
    a = spark.createDataFrame([(None, 1), (1, 2)], "k int, v int")
    keys = [("k", "k")]
    assert J.join_datasets(a, a, keys, "inner").count() == 2
    assert J.join_datasets(a, a, keys, "inner", null_safe=False).count() == 1


def test_pivot_refuses_wide_axes(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 2)
    assert isinstance(A.pivot_dataset(df, ["g"], ["id"]), Refusal)


def test_codes_are_told_from_measures(spark):
    n = spark.range(400)
    http = n.select(F.element_at(F.array(*map(F.lit, (200, 301, 404, 500))), (F.col("id") % 4 + 1).cast("int")).alias("v"))
    assert P.coded_column(http, "v").first()["coded"]
    assert not P.coded_column(n.select((F.col("id") % 5 + 1).alias("likert")), "likert").first()["coded"]
    assert not P.coded_column(n.select((2000 + F.col("id") % 20).alias("y")), "y").first()["coded"]
    assert not P.coded_column(n.select((F.col("id") * 1.5).alias("price")), "price").first()["coded"]


def test_derived_formula_is_found_and_noise_is_not(spark):
    df = spark.range(100).select((F.col("id") + 1.0).alias("units"), (F.col("id") * 7 % 13 + 0.5).alias("unit_price"))
    rows = P.derived_formulas(df.withColumn("notional", F.col("units") * F.col("unit_price"))).collect()
    assert ("notional", "units", "*", "unit_price") in [tuple(r) for r in rows]
    assert P.derived_formulas(df.withColumn("x", F.rand(1))).count() == 0


@pytest.mark.parametrize(("values", "want"), [(["13/02/2023", "01/03/2023"], "2023-03-01"), (["02/13/2023", "01/03/2023"], "2023-01-03"), (["2023-01-03", "2023-01-03"], "2023-01-03")])
def test_one_date_convention_per_column(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "d string")
    assert C.uniform_dates(df, "d").collect()[1]["d"] == want


def test_clock_times_are_no_dates(spark):
    df = spark.createDataFrame([("23:48:13",)], "d string")
    assert df.select(dates.parse_date(F.col("d"), False)).first()[0] is None


def test_layouts_are_tried_on_texts_of_their_shape(spark):
    import re

    said = {"2024-1-02 3:4:5": 0, "2024-01-02t03:04:05": 1, "-2024-01-02 3:4": 2, "+12024-1-2": 3}
    for text, k in said.items():
        assert [bool(re.match(dates.shape(f), text)) for f in dates.ISO] == [i == k for i in range(4)]
        assert not any(re.match(dates.shape(f), text) for f in (*dates.DAY_FIRST, *dates.MONTH_FIRST))
    df = spark.createDataFrame([(" 2024/1/2 ",), ("13.12.2024 1:02",), ("12-13-2024",), ("2024-02-30",), ("1:02:03",), (None,)], "d string")
    got = df.select(dates.parse_date(F.col("d"), True).cast("string"), dates.parse_date(F.col("d"), False).cast("string")).collect()
    assert [tuple(r) for r in got] == [("2024-01-02 00:00:00",) * 2, ("2024-12-13 01:02:00", None), (None, "2024-12-13 00:00:00"), (None, None), (None, None), (None, None)]


def test_text_functions(spark):
    df = spark.createDataFrame([("  Café Ünï, Ltd.\t", "$1,234.50", "(2010–2022)", "nan")], "a string, b string, c string, d string")
    r = df.select(text.canonical(dates.strip(F.col("a"))).alias("a"), text.number(F.col("b")).alias("b"), text.year(F.col("c")).alias("c"), text.number(F.col("d")).alias("d")).first()
    assert tuple(r) == ("café ünï ltd", 1234.5, 2010, None)


def test_interpolation_and_caps_keep_nulls_apart(spark):
    df = spark.createDataFrame([(1, None), (2, 10.0), (3, None), (4, None), (5, 40.0), (6, None)], "i int, v double")
    assert [r["v"] for r in C.interpolate(df, "v", "i").orderBy("i").collect()] == [10, 10, 20, 30, 40, 40]
    capped = C.cap_outliers(df, "v", 15.0, 30.0).orderBy("i").collect()
    assert [r["v"] for r in capped] == [None, 15, None, None, 30, None] and [r["v_was_capped"] for r in capped] == [0, 1, 0, 0, 1, 0]


def test_fuzzy_merge_keeps_digits_apart(spark):
    df = spark.createDataFrame([("Acme Corporation",), ("Acme corp",), ("Acme corp",), ("Store 12",), ("Store 13",)], "n string")
    assert {r["n"] for r in C.fuzzy_merge(df, "n", 0.8).collect()} == {"Acme corp", "Store 12", "Store 13"}


def test_simpson_reversal_is_flagged(spark):
    rows = [("new", "easy", 1)] * 81 + [("new", "easy", 0)] * 9 + [("new", "hard", 1)] * 3 + [("new", "hard", 0)] * 7 + [("old", "easy", 1)] * 19 + [("old", "easy", 0)] + [("old", "hard", 1)] * 32 + [("old", "hard", 0)] * 48
    df = spark.createDataFrame(rows, "method string, difficulty string, success int")
    assert all(r["reversed"] for r in S.simpson_rates(df, F.col("success"), "method", "difficulty", "new", "old").collect())


def test_kruskal_ignores_groups_of_one(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0), ("c", 9.0)], "g string, v double")
    r = S.kruskal(df, "v", "g").first()
    assert (r["groups"], r["n"], round(r["h"], 4)) == (2, 4, 2.4)


def test_plan_is_diagnosed_approved_applied_and_replayed(spark):
    df = spark.createDataFrame([(" Paris", "1,000", 1.0), ("paris", "2", None), ("Paris ", "3", 3.0), ("Rome", "4", 4.0), ("Rome", "4", 4.0)], "city string, price string, v double")
    ops = plan.diagnose(df)
    assert {"trim_text", "cast_types", "impute", "deduplicate", "standardize_categories"} <= {o.action for o in ops}
    chosen = plan.approve("all", ops)
    assert all(o.recommended for o in chosen)
    out, log = plan.apply_plan(df, chosen)
    assert {s for _, s in log} == {"applied"} and out.count() == 4 and dict(out.dtypes)["price"] == "double"
    assert {r["city"] for r in out.collect()} == {"Paris", "Rome"} or {r["city"] for r in out.collect()} == {"paris", "Rome"}
    again, _ = plan.replay(df, plan.manifest(chosen))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, out.collect()), key=str)
    assert plan.approve("none", ops) == []
    _, log = plan.apply_plan(df.drop("city"), chosen)
    assert any(s.startswith("skipped") for _, s in log)


def test_claims_are_caught_and_quiet():
    led = EvidenceLedger()
    led.note_ranking("d", "region", "v", "sum", [("north", 50.0), ("south", 30.0), ("east", 10.0), ("west", 6.0), ("mid", 4.0)])
    led.note_correlation("d", "price", "volume", "pearson", 0.03)
    led.note("durations", dataset="d", unit="days", mean=10.0)
    assert claims.check_top_n("The top 2 are north and east.", led) == ["east ranks 3, not within 2"]
    assert claims.check_top_n("The top 2 are north and south.", led) == []
    assert claims.check_trend("price rises with volume", led) and not claims.check_trend("price does not rise with volume", led)
    assert claims.check_share("the top 20 % of regions make 90 %", led) and not claims.check_share("the top 20 % of regions make 52 %", led)
    assert claims.check_duration("it takes 14 days", led) and not claims.check_duration("it takes 10.5 days", led)


def test_session_records_and_refuses(spark, pair):
    s = EngineSession(spark)
    s.catalog.register("orders", pair[0], truncation={"rows_read": 4, "rows_total": 9, "strategy": "first rows"})
    s.catalog.register("customers", pair[1])
    refused = s.join("orders", "customers", "both", on=["customer_id"], how="inner")
    assert isinstance(refused, Refusal) and "inner_rows" in refused.reason and "both" not in s.catalog.meta  # nobody approved
    s.approver = lambda card: "how=sideways"
    assert isinstance(s.join("orders", "customers", "both", on=["customer_id"]), Refusal)
    s.approver = lambda card: "how=inner"
    out = s.join("orders", "customers", "both", on=["customer_id"], how="inner")
    assert out.count() == 5 and s.catalog.meta["both"].truncation["rows_total"] == 9
    assert s.ledger.joins[0]["lost"] == 1 and s.ledger.joins[0]["as_predicted"] and s.ledger.joins[0]["rows"] == 5
    assert s.sql("SELECT count(*) AS n FROM both").first()["n"] == 5
    assert isinstance(EngineSession.join(s, "orders", "customers", "x", on=["nope"]), Refusal)


def test_lines_and_segments(spark):
    words = spark.createDataFrame([("d", 1, i, w, float(x), float(y), 20.0, 10.0, 10.0, False) for i, (w, x, y) in enumerate([("Date:", 0, 0), ("2024", 100, 1), ("far", 300, 0), ("next", 0, 30)])], "doc_id string, page int, word_idx int, text string, left double, top double, width double, height double, size double, bold boolean")
    got = [r["text"] for r in D.segment_texts(D.segments(D.group_lines(words))).orderBy("line", "segment").collect()]
    assert got == ["Date: 2024", "far", "next"]


def test_workbook_is_read_with_formulas(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = lambda rows: f"<worksheet {ns}><sheetData>{''.join(f'<row>{r}</row>' for r in rows)}</sheetData></worksheet>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sales" r:id="a"/><sheet name="2024 Rates" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", sheet([cell("A1", "key") + cell("C1", "value"), cell("A2", "x") + '<c r="C2"><f>SUM(\'2024 Rates\'!A1:B2)</f><v>7</v></c>']))
        z.writestr("xl/worksheets/s2.xml", sheet([cell("A1", "Key "), cell("A2", "x")]))
    s = EngineSession(spark)
    assert sheets.load_workbook(s, path, "book") == (["book_sales", "book_s_2024_rates"], {})
    assert [tuple(r) for r in s.catalog["book_sales"].collect()] == [("x", None, 7)]
    assert s.catalog["book_sales"].columns == ["key", "col2", "value"]
    _, formulas, links = workbook.inspect(spark, path)
    assert [tuple(r) for r in links.collect()] == [("Sales", "2024 Rates")] and formulas.first()["functions"] == ["SUM"]
    assert workbook.shared_columns(path, spark).first()["header"] == "key"


def test_results_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    runs = [sorted(map(tuple, A.rank_by(df.repartition(n), "g", "v").collect())) for n in (1, 4, 16)]
    assert runs[0] == runs[1] == runs[2]


def test_fuzzy_merge_has_no_limit_of_labels(spark):
    names = [f"{chr(97 + k % 26)}{'qwertyuiop'[k % 10] * 3}{k}" for k in range(700)]
    df = spark.createDataFrame([(n,) for n in names] + [("Acme Widgets",)] * 3 + [("Acme Widgest",)], "n string")
    got = {r["n"] for r in C.fuzzy_merge(df, "n", 0.8).collect()}
    assert got == {*names, "Acme Widgets"}


def test_all_measures_and_columns_are_tested(spark):
    from factloom.operators.aggregate import measures

    cols = [f"m{k}" for k in range(45)]
    df = spark.range(12).select("id", *[F.rand(k).alias(c) for k, c in enumerate(cols[:-1])]).withColumn("m44", F.col("m42") * F.col("m43"))
    df = spark.createDataFrame(df.collect(), df.schema)
    assert measures(df, ["id"]) == cols
    assert [tuple(r) for r in P.derived_formulas(df, cols).collect()] == [("m44", "m42", "*", "m43")]


def test_quantiles_and_running_sums_are_exact(spark):
    import numpy as np

    from factloom.functions import ranks

    rng = np.random.default_rng(4)
    rows = [(int(g), float(round(v, 1)) if rng.random() > 0.1 else None) for g, v in zip(rng.integers(0, 4, 3000), rng.lognormal(3, 1, 3000), strict=True)]
    df = spark.createDataFrame(rows + [(9, None), (None, 5.0)], "g int, v double")
    got = {r["g"]: r["q"] for r in ranks.quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.9, 1.0], ["g"]).collect()}
    for g in range(4):
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], [0.0, 0.25, 0.5, 0.9, 1.0]))
    assert got[None] == [5.0] * 5 and 9 not in got
    counts = df.dropna().groupBy("v").agg(F.count("*").alias("c"))
    for r in ranks.running(counts, "v", ["c"]).collect():
        below = [v for k, v in rows if v is not None and v < r["v"]]
        assert r["c_before"] == len(below) and r["c_all"] == sum(v is not None for _, v in rows)
    plan = ranks.running(counts, "v", ["c"])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(v" not in plan  # no window over all values at once


def test_debug_depth_follows_parents(spark):
    from factloom.operators import records as R

    nodes = spark.createDataFrame([(1, "a", None, "draft"), (1, "b", "a", "debug"), (1, "c", "b", "debug"), (1, "d", "c", "improve"), (1, "e", "d", "debug"), (1, "f", "b", "debug"), (2, "a", None, "debug"), (2, "b", "a", "debug")], "run int, id string, parent_id string, stage string")
    assert {(r["run"], r["id"]): r["depth"] for r in R.debug_depth(nodes, "run").collect()} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 0, (1, "e"): 1, (1, "f"): 2, (2, "a"): 0, (2, "b"): 1}


def test_error_kinds_and_fixed_wordings(spark):
    from factloom.operators import text as T

    rows = [("TabError: x", True, "syntax"), ("all fine", False, "generic"), ("Traceback (most recent call last)\n[exit code 1]", True, "runtime"), ("x [exit 3]", True, "shell"), ("Error: odd", True, "generic"), ("Timed out after 3 s", True, "timeout"), ("PermissionError: p", True, "generic")]
    df = spark.createDataFrame(rows, "s string, e boolean, k string")
    assert df.filter((T.is_error(F.col("s")) != F.col("e")) | (T.error_class(F.col("s")) != F.col("k"))).count() == 0
    assert text.FORMS["industries"] == "ind" and "street" not in text.FORMS


def test_join_card_tells_key_problems(spark):
    left = spark.createDataFrame([("007", 1.0), ("008", 2.0), (" 9", 3.0), (None, 4.0)], "k string, v double")
    assert {n.split(":")[0] for n in J.key_notes(left, spark.createDataFrame([(7,)], "k int"), "k", "k")} == {"TYPE MISMATCH", "BLANK KEYS"}
    assert {n.split(":")[0] for n in J.key_notes(left, spark.createDataFrame([("7",), ("8",)], "k string"), "k", "k")} == {"ZERO PADDING", "WHITESPACE", "BLANK KEYS"}
    assert [n.split(":")[0] for n in J.key_notes(spark.createDataFrame([("AB",)], "k string"), spark.createDataFrame([("ab",)], "k string"), "k", "k")] == ["CASE"]
    assert isinstance(J.forecast(left, spark.createDataFrame([("x",)], "k string"), [("k", "k")]), Refusal)


def test_evidence_on_lines_across_lines_and_in_tables(spark):
    from factloom.operators import evidence as E

    lines = spark.createDataFrame([("d", 1, 1, 1, "Revenue rose to"), ("d", 1, 2, 1, "1,200 in spring"), ("d", 1, 3, 2, "other column")], "doc_id string, page int, nth int, column int, text string")
    grid = [(0, ["Event", "Level"]), (1, ["Cross-Functional Team Bonus (3+ departments)", "CC 5"]), (2, ["Lone Bonus", "CC 1"])]
    cells = spark.createDataFrame([("d", 2, "t", r, c, x) for r, row in grid for c, x in enumerate(row)], "doc_id string, page int, table_id string, row int, col int, text string")
    quotes = [(1, "d", 1, 1, "rose TO"), (2, "d", 1, 1, "rose to 1200"), (3, "d", 1, 2, "spring other"), (4, "d", 1, 1, "Cross-Functional Team Bonus Level CC 5"), (5, "d", 1, 1, "Cross-Functional Team Bonus CC 1"), (6, "d", 1, 1, "Event Level")]
    q = spark.createDataFrame(quotes, "quote_id int, doc_id string, page int, nth int, quote string")
    assert {r["quote_id"]: r["strategy"] for r in E.resolve_evidence(lines, cells, q).collect()} == {1: "line", 2: "multiline", 3: "none", 4: "table", 5: "none", 6: "none"}
    assert [tuple(r) for r in E.evidence_in_tables(cells, q).collect()] == [(4, "d", 2, "t", 1, [0, 1])]


def test_stored_lines_keep_rows_and_columns(spark):
    from factloom.operators import evidence as E

    segs = spark.createDataFrame([("d", 1, 1, 0, "TEAM", 0.0, 0.0, 100.0, 10.0), ("d", 1, 1, 1, "MENTOR", 700.0, 0.0, 800.0, 10.0), ("d", 1, 2, 0, "Ann", 0.0, 20.0, 50.0, 30.0), ("d", 1, 2, 1, "Bob", 700.0, 20.0, 760.0, 30.0), ("d", 2, 1, 0, "a", 0.0, 0.0, 50.0, 10.0), ("d", 2, 1, 1, "b", 600.0, 0.0, 650.0, 10.0)], "doc_id string, page int, line int, segment int, text string, left double, top double, right double, bottom double")
    tables = spark.createDataFrame([("d", 2, 0, 0.0, 0.0, 700.0, 20.0)], "doc_id string, page int, table int, x0 double, y0 double, x1 double, y1 double")
    got = [(r["page"], r["line_id"], r["text"]) for r in E.store_lines(segs, tables).orderBy("page", "nth").collect()]
    assert got == [(1, "p1:L1", "TEAM"), (1, "p1:L2", "Ann"), (1, "p1:L3", "MENTOR"), (1, "p1:L4", "Bob"), (2, "p2:L1", "a | b")]


def test_replies_and_labels(spark):
    from factloom.operators import fields as X

    assert X.parse_group_spec("region, month: sum(sales), Mean(unit price)") == (["region", "month"], {"sales": "sum", "unit price": "mean"})
    df = spark.createDataFrame([(1, '<think>{"a": 0}</think> {"a": 1}'), (2, "no"), (3, 'x ```json\n{"fields": [{"name": "n", "value": "v", "confidence": 0.5}, {"name": "N", "value": "V ", "confidence": 0.9}]}\n```')], "id int, s string")
    got = [(r["id"], r["name"], r["value"], r["confidence"]) for r in X.dedupe_fields(X.payload_fields(df, "id", "s")).orderBy("id").collect()]
    assert got == [(1, "a", "1", None), (3, "N", "V ", 0.9)]
    assert X.plot_sample(spark.range(100), "id", 10).agg(F.count("*").alias("n"), F.max("sampled_of").alias("m")).first() == (10, 100)


def test_models_are_stored_compared_and_explained(spark, tmp_path):
    import numpy as np

    from factloom.operators import models as M

    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(b), float(3 * a - b + 1), "yes" if a > b else "no") for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double, c string")
    made, board = M.train(df, "y", ["a", "b"], "regression", "id", ["linear"])
    assert board.first()["value"] < 1e-3
    store = M.ModelStore(spark, str(tmp_path / "models"))
    store.save("line", made["linear"], target="y", rows=300)
    again = store.load("line")
    assert [tuple(r) for r in store.listing().collect()] == [("line", '{"rows": 300, "target": "y"}')]
    out = M.predict(again, df).agg(F.max(F.abs(F.col("predicted") - F.col("y"))).alias("e")).first()
    assert out["e"] < 1e-3 and isinstance(M.predict(again, df.drop("a")), Refusal)
    assert [r["feature"] for r in M.feature_importance(again).collect()] == ["a", "b"]
    best, folds = M.cross_validate(df, "y", ["a", "b"], "regression", "linear", 3, {"regParam": [0.0, 1.0]})
    means = {r["params"]: r["mean"] for r in folds.collect()}
    assert means['{"regParam": 0.0}'] < 1e-3 < means['{"regParam": 1.0}']
    classes, board = M.train(df, "c", ["a", "b"], "binary", "id", ["logistic", "mlp"])
    assert min(r["value"] for r in board.collect()) > 0.9
    agree = M.predict(classes["logistic"], df).agg(F.avg((F.col("predicted") == F.col("c")).cast("double")).alias("s")).first()["s"]
    assert agree > 0.95 and M.compare({"one": board}).columns == ["artefact", "model", "metric", "value"]
    assert store.delete("line") and store.listing().count() == 0 and isinstance(store.load("line"), Refusal)


def test_fills_over_parts_equal_plain_ones(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    values = [float(v) if rng.random() > 0.6 else None for v in rng.normal(size=500)]
    df = spark.createDataFrame([(int(k), int(k) % 3, v) for k, v in enumerate(values)], "k int, g int, v double").repartition(5)

    def plain(vs, kind):
        known = [i for i, v in enumerate(vs) if v is not None]
        out = []
        for i in range(len(vs)):
            a, z = max((j for j in known if j <= i), default=None), min((j for j in known if j >= i), default=None)
            if kind == "interpolate":
                out.append(vs[z] if a is None else vs[a] if z is None or a == z else vs[a] + (vs[z] - vs[a]) * (i - a) / (z - a))
            else:
                j = a if kind == "ffill" else z
                out.append(None if j is None else vs[j])
        return out

    for kind in ("ffill", "bfill", "interpolate"):
        got = {r["k"]: r["v"] for r in getattr(C, kind)(df, "v", "k").collect()}
        assert [got[k] for k in range(500)] == pytest.approx(plain(values, kind))
        got = {r["k"]: r["v"] for r in getattr(C, kind)(df, "v", "k", ["g"]).collect()}
        for g in range(3):
            assert [got[k] for k in range(g, 500, 3)] == pytest.approx(plain(values[g::3], kind))


def test_first_rows_and_imputed_claims(spark, tmp_path):
    from factloom.sources import tables

    for k in range(3):
        (tmp_path / f"f{k}.csv").write_text("x\n" + "\n".join(str(10 * k + i) for i in range(10)) + "\n")
    assert [r["x"] for r in tables.load_csv(spark, str(tmp_path), row_cap=12).collect()] == list(range(12))
    s = EngineSession(spark)
    s.catalog.register("d", spark.createDataFrame([("north", 1), ("north", 1), ("south", 0)], "region string, v_was_missing int"))
    s.null_groups("d", "region", "v_was_missing")
    assert claims.review("North leads by far.", s.ledger) == ["all values of north were filled in (v_was_missing)"] and not claims.review("South leads.", s.ledger)
    top = A.rank_by(spark.createDataFrame([(f"g{k}", float(k)) for k in range(50)], "g string, v double"), "g", "v", top=3).collect()
    assert [(r["rank"], r["label"]) for r in top] == [(1, "g49"), (2, "g48"), (3, "g47")] and top[2]["cumulative_pct"] == pytest.approx(100 * 144 / 1225)


def test_parts_are_sketched_once(spark):
    """Two evaluations of a sketch may differ, so no plan names the parts of one twice; and no fill goes from each row to the end."""
    from factloom.functions.ranks import running

    df = spark.range(50).select(F.col("id").alias("v"), F.lit(1).alias("n"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("x"))
    for made in (running(df, "v", ["n"]), C.bfill(df, "x", "v")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("percentile_approx(") == 1
        assert "currentrow$(), unboundedfollowing$()" not in plan


def test_labels_are_read_once_for_all_their_rows(spark):
    """Shapes and spellings are found on distinct values with their numbers of rows; nulls count for nothing, an empty column is null."""
    df = spark.createDataFrame([("12", "A b", None), ("12", "a  b", None), ("x", "a b", None), (None, None, None)], "s string, t string, u string")
    assert sorted(map(tuple, P.value_counts(df, ["s", "t", "u"]).collect())) == [("s", "12", 2), ("s", "x", 1), ("t", "A b", 1), ("t", "a  b", 1), ("t", "a b", 1)]
    got = {r["column"]: r for r in P.text_shapes(df).collect()}
    assert list(got) == ["s", "t", "u"] and got["s"]["number"] == pytest.approx(2 / 3) and got["t"]["number"] == 0 and got["u"]["number"] is None
    ops = plan.diagnose(df.select("s", "t"))
    assert [(o.action, o.columns) for o in ops if o.action in ("trim_text", "standardize_categories")] == [("trim_text", ["t"]), ("standardize_categories", ["t"])]
    assert "2 spellings of t" in next(o.label for o in ops if o.action == "standardize_categories")
