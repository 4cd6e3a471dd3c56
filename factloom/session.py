"""A session: catalog, ledger and the operators that write to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .functions import frames
from .functions import statistics as P
from .ledger import EvidenceLedger
from .limits import Refusal
from .operators import aggregate, join, statistics
from .operators import time as periods
from .plans import cleaning
from .sources import sheets, tables


class EngineSession:
    """Operators by dataset name. ``approver`` gets a card and returns a reply; without one, plans are only reported."""

    def __init__(self, spark: SparkSession, approver: Callable[[str], str] | None = None):
        self.spark, self.catalog, self.ledger, self.approver = spark, Catalog(spark), EvidenceLedger(), approver

    def load_parquet(self, path: str, name: str) -> DataFrame:
        return self.catalog.register(name, tables.load_parquet(self.spark, path), f"parquet:{path}")

    def load_csv(self, path: str, name: str, row_cap: int | None = None) -> DataFrame:
        whole = tables.load_csv(self.spark, path)
        cut = tables.truncation_of(whole, row_cap) if row_cap else None
        if cut:
            self.ledger.note("truncations", dataset=name, **cut)
        return self.catalog.register(name, tables.first_rows(whole, row_cap) if cut else whole, f"csv:{path}", truncation=cut)

    def load_excel(self, path: str, name: str, sheet: str | None = None, columns: list[str] | None = None, row_cap: int | None = None) -> DataFrame:
        df, known = sheets.load_sheet(self.spark, path, sheet, columns, row_cap)
        cut = {"rows_read": row_cap, "rows_total": known["rows"], "strategy": "first rows"} if known["truncated"] else None
        if cut:
            self.ledger.note("truncations", dataset=name, **cut)
        return self.catalog.register(name, df, f"excel:{path}#{sheet or ''}", truncation=cut)

    def load_json(self, path: str, name: str) -> DataFrame:
        return self.catalog.register(name, tables.load_json(self.spark, path), f"json:{path}")

    def sql(self, query: str, name: str | None = None) -> DataFrame:
        df = self.spark.sql(query)
        return self.catalog.register(name, df, "sql") if name else df

    def register_function(self, name: str, function, returns: str = "string") -> None:
        self.spark.udf.register(name, function, returns)

    def save(self, name: str, path: str) -> str:
        self.catalog.meta[name].saved = tables.save(self.catalog[name], path)
        return path

    def rank_by(self, name: str, group: str, value: str | None = None, how: str = "sum") -> DataFrame:
        df = self.catalog[name]
        ranked = aggregate.rank_by(df, group, value, how)
        top = ranked.orderBy("rank").limit(1000).collect()  # the head; claims look others up in the table, and shares are of the total over all groups
        whole = ranked.agg(F.sum("value").alias("total"), F.count("*").alias("groups")).first()
        heads = sorted({max(1, round(whole["groups"] * x / 100)) for x in range(1, 101)})
        running = {r["rank"]: r["cumulative_pct"] for r in ranked.filter(F.col("rank").isin(heads)).collect()} if "cumulative_pct" in ranked.columns else {}  # 100 rows
        self.ledger.note_ranking(name, group, value, "count" if value is None else how, [(r["label"] or "(blank)", r["value"] or 0.0) for r in top], whole["total"] or 0.0, whole["groups"], running, ranked.select("label", "rank"))
        u = aggregate.uniformity(df, group).first()
        if u["groups"] >= 2 and u["n"] >= 5 * u["groups"]:
            self.ledger.rankings[-1]["p_counts"] = P.chi2_upper(self.spark, u["statistic"], u["dof"])
            if value is not None and value in frames.numeric_columns(df):  # whether the values of a row differ by group, whatever their spread
                k = statistics.kruskal(df, value, group).first()
                if k["groups"] >= 2 and k["h"] is not None:
                    self.ledger.rankings[-1]["p_values"] = P.chi2_upper(self.spark, k["h"], k["groups"] - 1)
        return ranked

    def join(self, left: str, right: str, output: str, on: list[str] | None = None, how: str = "left", **keys) -> DataFrame | Refusal:
        """Forecast, approval, join, and a note of what was lost. Without an approver nothing is joined: the refusal holds the card.

        A reply is ``yes``, ``how=<kind>`` for another kind of join, or anything else to leave it. Afterwards the rows are counted
        against the forecast.
        """
        a, b = self.catalog[left], self.catalog[right]
        pairs = join.resolve_keys(a, b, on, **keys)
        if isinstance(pairs, Refusal):
            return pairs
        card = join.forecast(a, b, pairs, how)
        if isinstance(card, Refusal):
            return card
        if self.approver is None:
            return Refusal(f"not approved; the forecast: {card}")
        reply = self.approver(str(card)).strip().lower()
        if reply.startswith("how="):
            how = reply[4:].strip()
            if how not in join.HOWS:
                return Refusal(f"how is one of {', '.join(join.HOWS)}, not {how!r}")
        elif reply not in ("yes", "y"):
            return Refusal("not approved")
        joined = join.join_datasets(a, b, pairs, how, (left, right))
        predicted, made = card.rows[f"{how}_rows"], joined.count()
        lost = card.rows["left_orphans"] if how in ("inner", "right") else 0
        self.ledger.note("joins", dataset=output, left=left, right=right, how=how, lost=lost, predicted=predicted, rows=made, as_predicted=predicted == made, flags=list(card.flags))
        return self.catalog.register(output, joined, f"join:{left}+{right}", (left, right))

    def clean(self, name: str, target: str | None = None, reply: str | None = None) -> tuple[list[cleaning.CleaningOp], list[tuple[str, str]]]:
        """Diagnoses; with a reply (or an approver) applies what is approved under the same name."""
        ops = cleaning.diagnose(self.catalog[name], target)
        reply = reply or (self.approver("\n".join(f"{o.id} {o.action} {o.label}" for o in ops)) if self.approver else "none")
        chosen = cleaning.approve(reply, ops)
        df, log = cleaning.apply_plan(self.catalog[name], chosen)
        if chosen:
            self.catalog.register(name, df, self.catalog.meta[name].source, self.catalog.meta[name].parents, self.catalog.meta[name].truncation)
        return ops, log

    def check_grain(self, name: str, keys: list[str]) -> DataFrame:
        out = aggregate.grain_violations(self.catalog[name], keys)
        x = out.first()
        self.ledger.note("grains", dataset=name, keys=keys, passed=x["repeated_keys"] == 0, extra_rows=x["extra_rows"])
        return out

    def reconcile(self, name: str, column: str, expected: float, label: str, how: str = "sum") -> DataFrame:
        out = aggregate.reconcile(self.catalog[name], column, expected, how)
        x = out.first()
        self.ledger.note("reconciliations", dataset=name, label=label, gap=x["gap"], matches=x["matches"])
        return out

    def correlations(self, name: str, columns: list[str] | None = None) -> DataFrame:
        out = statistics.correlations(self.catalog[name], columns)
        for x in out.collect():  # a row per pair of columns
            self.ledger.note_correlation(name, x["a"], x["b"], "pearson", x["r"])
        return out

    def compare_groups(self, name: str, value: str, group: str) -> dict:
        x = statistics.anova(self.catalog[name], value, group).first()
        p = P.f_upper(self.spark, x["f"], x["dof_between"], x["dof_within"])
        found = {"dataset": name, "value": value, "group": group, "p": p, "significant": p < 0.05, "size": P.eta_size(x["eta_squared"])}
        self.ledger.note("effects", **found)
        return found

    def measure_duration(self, name: str, start: str, end: str, unit: str = "days", by: str | None = None) -> DataFrame:
        x = periods.duration_stats(self.catalog[name], start, end, unit).first()
        self.ledger.note("durations", dataset=name, start=start, end=end, unit=unit, mean=x["mean"])
        return periods.duration_stats(self.catalog[name], start, end, unit, by)

    def null_groups(self, name: str, group: str, marker: str) -> DataFrame:
        out = aggregate.imputed_share(self.catalog[name], group, marker)
        self.ledger.note("imputed_groups", dataset=name, column=marker, groups=out.filter(F.col("imputed") == "fully").select(group))  # a table: there may be many
        return out
