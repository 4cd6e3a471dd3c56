"""Report tables from the ledger and the catalog; the text layer over them is thin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ledger import EvidenceLedger
from . import claims
from .profile import profile


def kpi_rows(ledger: EvidenceLedger, spark: SparkSession) -> DataFrame:
    """dimension, leader, value and share of the total, one row per recorded ranking."""
    rows = []
    for x in ledger.rankings:
        if x["order"]:
            label, value = x["order"][0]
            total = x.get("total", sum(v for _, v in x["order"]))
            rows.append((x["group"], label, float(value), 100 * value / total if total and x["how"] in ("sum", "count") else None))
    return spark.createDataFrame(rows, "dimension string, leader string, value double, share_pct double")


def ancestors(session, name: str) -> list[str]:
    seen, todo = [], [name]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.append(n)
            todo += session.catalog.meta[n].parents if n in session.catalog.meta else ()
    return seen


def limitations(session, name: str) -> DataFrame:
    """kind and sentence for all that restricts conclusions about a dataset, inherited from its parents too."""
    rows: list[tuple[str, str]] = []
    for n in ancestors(session, name):
        meta = session.catalog.meta.get(n)
        if meta and meta.truncation:
            rows.append(("truncation", f"{n} holds {meta.truncation['rows_read']} of {meta.truncation['rows_total']} rows"))
        rows += [("grain", f"{n} repeats {', '.join(g['keys'])}: {g['extra_rows']} extra rows") for g in session.ledger.of("grains", n) if not g["passed"]]
        rows += [("effect", f"{e['value']} by {e['group']} differs, but hardly") for e in session.ledger.of("effects", n) if e["significant"] and e["size"] == "negligible"]
        rows += [("reconciliation", f"{x['label']} misses its expected value by {x['gap']:,.4g}") for x in session.ledger.of("reconciliations", n) if not x["matches"]]
        rows += [("join", f"{j['lost']} rows found no partner") for j in session.ledger.of("joins", n) if j["lost"]]
    df = session.catalog[name]
    marks = [c for c in df.columns if c.endswith(("_was_missing", "_was_capped"))]
    if marks:
        shares = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in marks]).first()
        rows += [("marker", f"{c} holds in {100 * shares[c]:.1f} % of rows") for c in marks if shares[c]]
    return session.spark.createDataFrame(rows, "kind string, sentence string")


def column_summary(df: DataFrame) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return profile(df).select("column", kinds[F.col("column")].alias("dtype"), F.col("non_null").alias("filled"), F.col("distinct").alias("n_distinct"))


def write_report(session, name: str, summary: str) -> str:
    """Markdown, or a ValueError with what contradicts the ledger."""
    if wrong := claims.review(summary, session.ledger):
        raise ValueError("the summary contradicts the evidence: " + "; ".join(wrong))

    def table(df: DataFrame) -> list[str]:
        return ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join("" if v is None else f"{v:,.4g}" if isinstance(v, float) else str(v) for v in row) + " |" for row in df.collect())]

    parts = [f"# {name}", "", summary, "", "## Key figures", *table(kpi_rows(session.ledger, session.spark)), "", "## How the table was built", *table(provenance(session, name)), "", "## Limitations", *table(limitations(session, name)), "", "## Columns", *table(column_summary(session.catalog[name])), "", "## Sources", *table(session.catalog.lineage())]
    return "\n".join(parts)


def provenance(session, name: str) -> DataFrame:
    """step and sentence: how the analysed table was built, from its sources on."""
    rows: list[tuple[str, str]] = []
    for n in reversed(ancestors(session, name)):
        meta = session.catalog.meta.get(n)
        if meta:
            rows.append(("source", f"{n} comes from {meta.source}, {len(session.catalog[n].columns)} columns"))
            if meta.truncation:
                rows.append(("truncation", f"{n} holds {meta.truncation['rows_read']} of {meta.truncation['rows_total']} rows of its source"))
        for j in session.ledger.of("joins", n):
            rows.append(("join", f"{n} is the {j['how']} join of {j['left']} and {j['right']}, {j.get('rows', j['predicted'])} rows; {j['lost']} rows of {j['left']} found no partner"))
    return session.spark.createDataFrame(rows, "step string, sentence string")


def intrinsic_limitations(df: DataFrame) -> DataFrame:
    """kind and sentence for what the table's own values restrict: columns mostly empty or of one value, rows that repeat, marks of cleaning."""
    from .profile import cleaning_warnings, duplicate_rows, profile
    from .statistics import missing_per_column

    part = lambda rows, kind, say: rows.select(F.lit(kind).alias("kind"), say.alias("sentence"))
    out = part(missing_per_column(df).filter("share >= 0.05"), "missing", F.format_string("%s is empty in %.1f %% of rows", "column", F.col("share") * 100))
    out = out.union(part(profile(df).filter("distinct <= 1"), "role", F.concat("column", F.lit(" holds one value"))))
    out = out.union(part(duplicate_rows(df).filter("n_duplicates > 0"), "duplicates", F.format_string("%d rows repeat others in full", "n_duplicates")))
    return out.union(part(cleaning_warnings(df), "cleaning", F.format_string("%.1f %% of %s is %s", F.col("share") * 100, "column", "kind")))


def html_report(session, name: str, summary: str) -> str:
    """The report as one page of HTML; everything from the data is escaped."""
    import html

    def table(title: str, df: DataFrame) -> str:
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else f'{v:,.4g}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in df.collect())
        return f"<h2>{title}</h2><table><tr>{head}</tr>{body}</table>"

    if wrong := claims.review(summary, session.ledger):
        raise ValueError("the summary contradicts the evidence: " + "; ".join(wrong))
    parts = [("Key figures", kpi_rows(session.ledger, session.spark)), ("How the table was built", provenance(session, name)), ("Limitations", limitations(session, name)), ("Columns", column_summary(session.catalog[name]))]
    return f"<html><head><meta charset='utf-8'><title>{html.escape(name)}</title></head><body><h1>{html.escape(name)}</h1><p>{html.escape(summary)}</p>" + "".join(table(t, d) for t, d in parts) + "</body></html>"
