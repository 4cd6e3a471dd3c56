"""Typed sheets: kinds, pruning, runs of rows, stated and counted sizes, failures told."""

import datetime
import zipfile

import pytest

from factloom.session import EngineSession
from factloom.sources import sheets

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(path, bodies, styles="", prefix="", extra=""):
    names = list(bodies)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f"<workbook {NS} {rel}>{extra}<sheets>" + "".join(f'<sheet name="{n}" r:id="r{k}"/>' for k, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(names))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>name</t></si><si><r><t>Ann </t></r><r><t>Lee</t></r></si></sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {NS}>{styles}</styleSheet>")
        for k, n in enumerate(names):
            if bodies[n] is not None:
                z.writestr(f"xl/worksheets/s{k}.xml", bodies[n])
    return str(path)


STYLES = '<numFmts><numFmt numFmtId="164" formatCode="[Red]&quot;day&quot; 0.0"/><numFmt numFmtId="165" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'


def people(n):
    heads = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>age</t></is></c><c r="C1" t="inlineStr"><is><t>born</t></is></c><c r="D1" t="inlineStr"><is><t>rate</t></is></c><c r="E1" t="inlineStr"><is><t>ok</t></is></c><c r="F1" t="inlineStr"><is><t>twice</t></is></c><c r="H1" t="inlineStr"><is><t>age</t></is></c></row>'
    rows = "".join(
        f'<row r="{i + 2}"><c r="A{i + 2}" t="s"><v>1</v></c><c r="B{i + 2}"><v>{i}</v></c><c r="C{i + 2}" s="{1 + 2 * (i % 2)}"><v>{36526 + i}.5</v></c><c r="D{i + 2}" s="2"><v>{i}{".5" if i % 2 else ""}</v></c>'
        f'<c r="E{i + 2}" t="b"><v>{i % 2}</v></c><c r="F{i + 2}"><f>B{i + 2}*2+SUM(Rates!A:A)+\'No such\'!A1</f></c><c r="G{i + 2}"/></row><row r="{i}"/>'
        for i in range(n)
    )
    return heads + rows


@pytest.mark.parametrize("run", [sheets.RUN_ROWS, 3])
def test_sheets_are_typed_pruned_and_read_in_runs(spark, tmp_path, run, monkeypatch):
    monkeypatch.setattr(sheets, "RUN_ROWS", run)
    monkeypatch.setattr(sheets, "CHUNK", 64)
    rates = f'<worksheet {NS}><dimension ref="A1:B3"/><sheetData><row r="1"><c r="A1" t="str"><v>k</v></c></row><row><c><v>1</v></c><c t="inlineStr"><is><t>x</t></is></c></row><row><c><v>2.5</v></c><c t="e"><v>#N/A</v></c></row></sheetData></worksheet>'
    path = book(tmp_path / "b.xlsx", {"People": f"<worksheet {NS}><sheetData>{people(9)}</sheetData></worksheet>", "Rates": rates, "Broken": None}, STYLES)
    listed = {r["sheet"]: r for r in sheets.list_sheets(spark, path).collect()}
    assert (listed["People"]["n_rows"], listed["People"]["n_columns"]) == (19, 8) and (listed["Rates"]["n_rows"], listed["Rates"]["n_columns"]) == (3, 2)
    assert listed["People"]["headers"] == ["name", "age", "born", "rate", "ok", "twice", "col7", "age"] and "KeyError" in listed["Broken"]["error"]
    kinds = {(r["sheet"], r["at"]): (r["kind"], r["n_formulas"]) for r in sheets.column_kinds(spark, path).collect()}
    assert [kinds["People", k] for k in range(8)] == [("text", 0), ("int", 0), ("date", 0), ("float", 0), ("bool", 0), ("formula", 9), ("empty", 0), ("empty", 0)]
    assert kinds["Rates", 0] == ("float", 0) and kinds["Rates", 1] == ("text", 0)
    df, known = sheets.load_sheet(spark, path)
    assert dict(df.dtypes) == {"name": "string", "age": "bigint", "born": "timestamp", "rate": "double", "ok": "boolean", "twice": "string", "col7": "string", "age_2": "string"} and known == {"rows": 18, "columns": 8, "truncated": False}
    rows = {r["age"]: r for r in df.collect()}
    assert len(rows) == 9 and rows[3]["born"] == datetime.datetime(2000, 1, 4, 12) and rows[3]["rate"] == 3.5 and rows[3]["ok"] is True and rows[3]["name"] == "Ann Lee" and rows[3]["twice"].startswith("=B5*2")
    some, known = sheets.load_sheet(spark, path, "People", columns=["ok", "age"], cap=5)
    assert some.columns == ["age", "ok"] and known["truncated"] and some.count() == 3  # rows between are blank
    links = {(r["what"], r["name"]): r["n"] for r in sheets.formula_links(spark, path).collect()}
    assert links == {("function", "SUM"): 9, ("reference", "Rates"): 9}


def test_workbook_reports_what_fails(spark, tmp_path):
    good = f'<worksheet {NS}><dimension ref="A1:A2"/><sheetData><row><c t="inlineStr"><is><t>v</t></is></c></row><row><c><v>1</v></c></row></sheetData></worksheet>'
    path = book(tmp_path / "c.xlsx", {"Good one": good, "Broken": "<worksheet", "Gone": None})
    s = EngineSession(spark)
    made, failed = sheets.load_workbook(s, path, "w")
    assert made == ["w_good_one", "w_broken"] or (made == ["w_good_one"] and "Broken" in failed)
    assert "Gone" in failed and s.catalog["w_good_one"].collect()[0]["v"] == 1
    with pytest.raises(ValueError):
        sheets.load_sheet(spark, path, "Nowhere")
    with pytest.raises(ValueError):
        sheets.load_sheet(spark, path, "Good one", columns=["w"])


def test_days_count_from_1904_and_prefixed_elements(spark, tmp_path):
    body = f'<x:worksheet xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><x:sheetData><x:row><x:c t="inlineStr"><x:is><x:t>d</x:t></x:is></x:c></x:row><x:row><x:c s="1"><x:v>1</x:v></x:c></x:row></x:sheetData></x:worksheet>'
    path = book(tmp_path / "d.xlsx", {"S": body}, STYLES, extra='<workbookPr date1904="1"/>')
    df, _ = sheets.load_sheet(spark, path)
    assert df.collect()[0]["d"] == datetime.datetime(1904, 1, 2)
