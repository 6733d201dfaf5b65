"""Structure of missing values.

Rows are first reduced to their pattern of missing columns and counted per pattern; everything else
works on the pattern counts, so the data is read once and combined before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortflow.functions.distributions import chi2_sf
from cohortflow.operators import logit
from cohortflow.session import settle

CUTS = 256


def co_missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col_i, col_j, n)``: rows in which both are null; ``col_i = col_j`` gives the null count.

    Pairs that never occur together are absent.
    """
    absent = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    patterns = df.select(absent.alias("p")).where(F.size("p") > 0).groupBy("p").count()
    pairs = patterns.withColumn("col_i", F.explode("p")).withColumn("col_j", F.explode("p"))
    return pairs.groupBy("col_i", "col_j").agg(F.sum("count").alias("n"))


def missing_present_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col_i, col_j, n)``: rows in which i is null and j is not, over columns that have nulls."""
    both = co_missing_counts(df, columns)
    single = both.where(F.col("col_i") == F.col("col_j"))
    names = single.agg(F.collect_list("col_i").alias("names"))
    # at most one row per column of the table, so the pairing below stays at schema size
    nulls = {r["col_i"]: r["n"] for r in single.collect()}
    if not nulls:
        return names.sparkSession.createDataFrame([], "col_i string, col_j string, n long")
    listed = F.array(*[F.struct(F.lit(c).alias("col_i"), F.lit(n).cast("long").alias("n_i")) for c, n in sorted(nulls.items())])
    grid = df.sparkSession.range(1).select(F.inline(listed)).withColumn(
        "col_j", F.explode(F.array(*[F.lit(c) for c in sorted(nulls)]))
    )
    joined = grid.join(both, ["col_i", "col_j"], "left")
    return joined.select("col_i", "col_j", (F.col("n_i") - F.coalesce("n", F.lit(0))).cast("long").alias("n"))


def co_missing_chi2(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Chi-square test of the missing-by-present table, without correction.

    Raises ValueError when nothing is missing, or when the table is empty once rows and columns of
    zeros are dropped. The table has one cell per pair of columns.
    """
    cells = missing_present_table(df, columns).collect()
    return _chi2({(r["col_i"], r["col_j"]): r["n"] for r in cells})


def _chi2(cells: dict[tuple[str, str], int]) -> dict[str, float]:
    if not cells:
        raise ValueError("no missing values")
    names = sorted({i for i, _ in cells})
    table = np.array([[float(cells.get((i, j), 0)) for j in names] for i in names])
    table = table[~(table == 0).all(axis=1)][:, ~(table == 0).all(axis=0)]
    if table.size == 0:
        raise ValueError("the contingency table is empty")
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    stat = float(((table - expected) ** 2 / expected).sum())
    dof = (table.shape[0] - 1) * (table.shape[1] - 1)
    return {"statistic": stat, "dof": dof, "p_value": chi2_sf(stat, dof) if dof else 1.0}


def group_co_missing(df: DataFrame, columns: Sequence[str], groups: dict[str, Column]) -> DataFrame:
    """:func:`co_missing_counts` within each named row condition: ``(group, col_i, col_j, n)``.

    Patterns are counted by the groups they are in, in one scan; a row may be in several groups, and counts in each.
    """
    absent = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    inside = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in groups.items()]), lambda g: g.isNotNull())
    patterns = df.select(absent.alias("p"), inside.alias("g")).where((F.size("p") > 0) & (F.size("g") > 0)).groupBy("p", "g").count()
    pairs = patterns.withColumn("group", F.explode("g")).withColumn("col_i", F.explode("p")).withColumn("col_j", F.explode("p"))
    return pairs.groupBy("group", "col_i", "col_j").agg(F.sum("count").alias("n"))


def co_missing_by_group(df: DataFrame, columns: Sequence[str], groups: dict[str, Column]) -> DataFrame:
    """:func:`co_missing_chi2` within each named row condition, from one scan; ``note`` says why a group has no test."""
    both: dict[str, dict[tuple[str, str], int]] = {name: {} for name in groups}
    # at most one row per group and pair of columns
    for r in group_co_missing(df, columns, groups).collect():
        both[r["group"]][r["col_i"], r["col_j"]] = r["n"]
    rows = []
    for name, counts in both.items():
        nulls = {i: n for (i, j), n in counts.items() if i == j}
        try:
            found = _chi2({(i, j): n - counts.get((i, j), 0) for i, n in nulls.items() for j in nulls})
            rows.append((name, found["statistic"], found["dof"], found["p_value"], found["p_value"] >= 0.05, None))
        except ValueError as e:
            rows.append((name, None, None, None, None, str(e)))
    return df.sparkSession.createDataFrame(
        rows, "group string, statistic double, dof int, p_value double, at_random boolean, note string"
    )


def nullity_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of the null indicators of each pair of columns; constant indicators are left out."""
    both = co_missing_counts(df, columns)
    n = df.count()
    nulls = {r["col_i"]: r["n"] for r in both.where(F.col("col_i") == F.col("col_j")).collect()}
    names = sorted(c for c, k in nulls.items() if 0 < k < n)
    pairs = [(a, b, nulls[a], nulls[b]) for i, a in enumerate(names) for b in names[i + 1 :]]
    grid = df.sparkSession.createDataFrame(pairs, "col_i string, col_j string, a long, b long")
    k = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    a, b, size = F.col("a").cast("double"), F.col("b").cast("double"), F.lit(float(n))
    corr = (size * k - a * b) / F.sqrt(a * (size - a) * b * (size - b))
    return grid.join(both, ["col_i", "col_j"], "left").select("col_i", "col_j", corr.alias("corr"))


def missing_predictability(
    df: DataFrame, columns: Sequence[str], threshold: float = 0.6, groups: dict[str, Column] | None = None
) -> DataFrame:
    """How well the other columns predict where a column is missing.

    Per column, a logistic model of its null indicator on the other columns (nulls replaced by the
    mean, then standardised) and the area under its curve on the same rows. ``flagged`` marks areas
    below ``threshold``; columns that are always or never null have no area. ``groups`` maps names
    to row conditions, which may overlap, and repeats the test within each.

    The models of all columns and groups are fitted together, a pass over the rows per step, and all
    areas come from one ranking.
    """
    from cohortflow.operators.metrics import auc

    columns, groups = list(columns), groups or {"all": F.lit(True)}
    found, models, data = logit.fit_missing(settle(df.select(*columns, *_flags(groups))), columns, {g: F.col(f"_g{k}") for k, g in enumerate(groups)})
    # equal scores are combined on the way, and a model's ranking is cut at even probabilities
    borders = [-math.inf, *[k / CUTS for k in range(1, CUTS)], math.inf]
    areas = auc(logit.scores(data, len(columns), found, models), "y", "p", ["unit"], borders)
    # one row per group and column
    area = {r["unit"]: r["auc"] for r in areas.collect()}
    unit = {(m.group, m.target): k for k, m in enumerate(models)}
    rows = []
    for g, group in enumerate(found):
        for j, column in enumerate(columns):
            a = area.get(unit.get((g, j)))
            rows.append((group.name, column, a, None if a is None else a < threshold, "no variation in missingness" if (g, j) not in unit else "tested"))
    return df.sparkSession.createDataFrame(rows, "group string, column string, auc double, flagged boolean, note string")


def _flags(groups: dict[str, Column]) -> list[Column]:
    return [F.coalesce(condition, F.lit(False)).alias(f"_g{k}") for k, condition in enumerate(groups.values())]
