"""Category encodings, column selection and row completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortflow.operators.scores import first_match

def map_values(column: Column, mapping: dict, default=None) -> Column:
    """Dictionary lookup; anything not listed gives ``default``."""
    return first_match([(column == k, F.lit(v)) for k, v in mapping.items()], default)


def map_contains(column: Column, needles: Sequence[tuple[Sequence[str], object]], default) -> Column:
    """Case-folded substring tests in order; the first that holds wins, null gives ``default``."""
    upper = F.upper(column)
    rules = [(F.greatest(*[upper.contains(w) for w in words], F.lit(False)), F.lit(v)) for words, v in needles]
    return first_match(rules, default)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The non-null values of a column, once each."""
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def category_names(df: DataFrame, column: str, most: int) -> list:
    """Sorted values of a column whose values are to become column names; refuses more than ``most``."""
    rows = distinct_values(df, column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} distinct values")
    return sorted(r[0] for r in rows)


def one_hot(df: DataFrame, columns: Sequence[str], most: int, categories: dict[str, list] | None = None) -> DataFrame:
    """Replace each column by 0/1 columns named ``column_value``, categories in sorted order, ``most`` per column."""
    categories = categories or {c: category_names(df, c, most) for c in columns}
    flags = {
        f"{c}_{v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c in columns for v in categories[c]
    }
    return df.withColumns(flags).drop(*columns)


def null_count(columns: Sequence[str]) -> Column:
    parts = [F.col(c).isNull().cast("int") for c in columns]
    return sum(parts[1:], parts[0])


def add_missing_count(df: DataFrame, name: str = "missing_count", columns: Sequence[str] | None = None) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"column {name!r} already exists")
    return df.withColumn(name, null_count(columns or df.columns))


def keep_complete(df: DataFrame, column_sets: Sequence[Sequence[str]], threshold: float = 0.8) -> DataFrame:
    """Rows with at least ``int(threshold * k)`` non-null values in every set of k columns."""
    for columns in column_sets:
        df = df.dropna(thresh=int(threshold * len(columns)), subset=list(columns))
    return df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def drop_matching(df: DataFrame, fragments: Sequence[str]) -> DataFrame:
    """Drop columns whose lower-cased name contains any fragment."""
    return df.drop(*[c for c in df.columns if any(f in c.lower() for f in fragments)])


def override(df: DataFrame, column: str, value) -> DataFrame:
    """Set a column to one value in every row, keeping its type."""
    return df.withColumn(column, F.lit(value).cast(df.schema[column].dataType))


def attach_by_key(df: DataFrame, other: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Add ``columns`` of ``other`` by key. Both sides must hold the same keys once each."""
    clash = [c for c in columns if c in df.columns]
    if clash:
        raise ValueError(f"columns already present: {clash}")
    return df.join(other.select(*key, *columns), list(key), "inner")


def unpivot_groups(df: DataFrame, keep: Sequence[str], group_columns: Sequence[str]) -> DataFrame:
    """One row per (input row, group column) with ``group_col`` and its value as text."""
    pairs = [F.struct(F.lit(c).alias("group_col"), F.col(c).cast("string").alias("group_value")) for c in group_columns]
    return df.select(*keep, F.inline(F.array(*pairs)))
