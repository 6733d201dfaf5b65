"""Choosing the rows of a cohort and counting what each rule removes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key by ``order``, which must be unique within the key.

    A minimum over structs combines before the shuffle, so a key with very many rows sends one
    row per task instead of its whole group to a sort.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = (F.max if last else F.min)(F.struct(*order, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)


def exclude(df: DataFrame, unwanted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``unwanted``."""
    return df.join(unwanted.select(*on).distinct(), list(on), "left_anti")


def within(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(column).between(low, high))


def attrition(df: DataFrame, subject: str, rules: Sequence[tuple[str, Column]], start: str = "Initial dataset") -> DataFrame:
    """Funnel table ``(step_num, step, subject_count, stay_count)``.

    ``rules`` are (name, condition that removes the row) in the order they apply. Each row gets the
    number of the first rule that removes it, each subject the latest step at which a row of theirs
    is still there; two aggregations without a join give all counts.
    """
    n = len(rules)
    gone = F.coalesce(*[F.when(cond, F.lit(i)) for i, (_, cond) in enumerate(rules, 1)], F.lit(n + 1))
    per_subject = (
        df.select(F.col(subject).alias("_s"), gone.alias("_gone"))
        .groupBy("_s")
        .agg(
            F.max("_gone").alias("_last"),
            *[F.count(F.when(F.col("_gone") > k, 1)).alias(f"_n{k}") for k in range(n + 1)],
        )
    )
    totals = per_subject.agg(
        *[F.coalesce(F.sum(f"_n{k}"), F.lit(0)).alias(f"r{k}") for k in range(n + 1)],
        *[F.count(F.when(F.col("_last") > k, 1)).alias(f"s{k}") for k in range(n + 1)],
    )
    rows = [_step(1, start, F.col("s0"), F.col("r0"))]
    for k, (name, _) in enumerate(rules, 1):
        rows.append(_step(2 * k, name, F.col(f"s{k - 1}") - F.col(f"s{k}"), F.col(f"r{k - 1}") - F.col(f"r{k}")))
        rows.append(_step(2 * k + 1, f"After: {name}", F.col(f"s{k}"), F.col(f"r{k}")))
    return totals.select(F.inline(F.array(*rows)))


def _step(num: int, name: str, subjects: Column, stays: Column) -> Column:
    return F.struct(
        F.lit(num).alias("step_num"),
        F.lit(name).alias("step"),
        subjects.cast("long").alias("subject_count"),
        stays.cast("long").alias("stay_count"),
    )
