"""Named DataFrames with where they came from."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class DatasetMeta:
    source: str
    parents: tuple[str, ...] = ()
    truncation: dict | None = None
    saved: str | None = None


@dataclass
class Catalog:
    spark: SparkSession
    frames: dict[str, DataFrame] = field(default_factory=dict)
    meta: dict[str, DatasetMeta] = field(default_factory=dict)

    def register(self, name: str, df: DataFrame, source: str = "derived", parents: tuple[str, ...] = (), truncation: dict | None = None) -> DataFrame:
        """A name loaded again in full loses an earlier truncation; one of a parent is inherited."""
        inherited = next((self.meta[p].truncation for p in parents if p in self.meta and self.meta[p].truncation), None)
        self.frames[name] = df
        self.meta[name] = DatasetMeta(source, parents, truncation or inherited)
        df.createOrReplaceTempView(name)
        return df

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise KeyError(f"no dataset {name!r}; known: {', '.join(sorted(self.frames)) or 'none'}")
        return self.frames[name]

    def listing(self) -> DataFrame:
        rows = [(n, self.meta[n].source, df.count(), len(df.columns)) for n, df in sorted(self.frames.items())]
        return self.spark.createDataFrame(rows, "name string, source string, n_rows long, n_columns int")

    def lineage(self) -> DataFrame:
        rows = [(n, m.source, list(m.parents), m.truncation is not None) for n, m in sorted(self.meta.items())]
        return self.spark.createDataFrame(rows, "name string, source string, parents array<string>, truncated boolean")
