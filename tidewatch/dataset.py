"""The data model: labelled series as one long DataFrame, with metadata and named results."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABEL, TIME = "label", "ts"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values are NULL: NaN becomes NULL in every floating column."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def along(*partition: str, order: str = TIME):
    """The window of one label in time order."""
    return Window.partitionBy(*(partition or (LABEL,))).orderBy(order)


def position(order: str = TIME) -> Column:
    """Dense 0-based position of a row within its label."""
    return F.row_number().over(along(order=order)).cast("long") - 1


@dataclass(frozen=True)
class Dataset:
    """An immutable set of labelled tables: df(label, ts, values, errors), meta(label, ...), results by name."""

    df: DataFrame
    value_cols: tuple[str, ...] = ()
    error_cols: tuple[str, ...] = ()
    meta: DataFrame | None = None
    results: dict[str, DataFrame] = field(default_factory=dict)
    run_id: int = 0

    @classmethod
    def of(cls, df: DataFrame, value_cols, error_cols=(), meta=None) -> Dataset:
        missing = [c for c in (LABEL, TIME, *value_cols, *error_cols) if c not in df.columns]
        if missing:
            raise KeyError(f"columns not in the data: {missing}")
        return cls(nan_to_null(df), tuple(value_cols), tuple(error_cols), meta)

    def with_df(self, df: DataFrame, **changes) -> Dataset:
        return replace(self, df=df, **changes)

    def with_result(self, name: str, result: DataFrame) -> Dataset:
        return replace(self, results=self.results | {name: result})

    def result(self, name: str) -> DataFrame:
        if name not in self.results:
            raise KeyError(f"no result named {name!r}; there are {sorted(self.results)}")
        return self.results[name]

    def columns(self, chosen=None) -> list[str]:
        return list(chosen) if chosen is not None else list(self.value_cols)

    def errors(self, chosen=None) -> list[str]:
        return list(chosen) if chosen is not None else list(self.error_cols)

    def labels(self) -> DataFrame:
        return self.df.select(LABEL).distinct()

    def n_labels(self) -> int:
        return self.df.agg(F.count_distinct(LABEL)).first()[0]

    def with_column(self, other: DataFrame, name: str) -> Dataset:
        """Attach a column by (label, ts); rows without a partner get NULL."""
        return self.with_df(self.df.join(other.select(LABEL, TIME, name), [LABEL, TIME], "left"))


def melt(df: DataFrame, columns: list[str], value: str = "value", name: str = "name") -> DataFrame:
    """Table to series: one row for each label, time and column."""
    return df.unpivot([LABEL, TIME], columns, name, value)


def widen(series: DataFrame, columns: list[str], value: str = "value", name: str = "name") -> DataFrame:
    """Series to table."""
    return series.groupBy(LABEL, TIME).pivot(name, columns).agg(F.first(value))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: like a checkpoint, but the plan that made it leaves no trace,
    so that a loop's plans don't grow from round to round."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
