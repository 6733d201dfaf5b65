"""Many logistic models on the same columns, fitted together: one per group of rows and target.

A target is the null indicator of a column, predicted from all other columns (nulls replaced by the group's mean, then
standardised). In a step every task adds up, over its Arrow batches, loss, gradient and second derivatives of all
models; Spark adds the tasks' sums as a tree, and the driver solves one small system per model. So a step reads the
data once for all models, and what the driver holds depends on the columns, not on the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 100
# so many tasks' sums of a model are added at once
MEET = 32


@dataclass
class Group:
    """Rows of one condition: how many, and mean and deviation of every column among them."""

    name: str
    n: float
    present: np.ndarray
    mean: np.ndarray
    sd: np.ndarray

    @property
    def targets(self) -> list[int]:
        """Columns that are sometimes null and sometimes not."""
        return [int(j) for j in np.flatnonzero((self.present > 0) & (self.present < self.n))]

    def design(self, x: np.ndarray) -> np.ndarray:
        """Standardised columns, 0 where null, and a column of ones."""
        z = np.where(np.isnan(x) | (self.present == 0), 0.0, (x - self.mean) / self.sd)
        return np.hstack([z, np.ones((len(z), 1))])

    def used(self, target: int) -> np.ndarray:
        """Columns of the design that may speak for a target."""
        use = np.append(self.present > 0, True)
        use[target] = False
        return use


@dataclass
class Model:
    """Weights of one target, with the last accepted ones while a step is tried."""

    group: int
    target: int
    use: np.ndarray
    tried: np.ndarray
    kept: np.ndarray = field(init=False)
    loss: float = float("inf")
    step: np.ndarray | None = None
    done: bool = False

    def __post_init__(self):
        self.kept = self.tried

    def take(self, sums: np.ndarray, c: float) -> None:
        """Newton step from loss, gradient and second derivatives at ``tried``; half of the last one if that went too far."""
        size = len(self.tried)
        penalty = np.append(self.tried[:-1], 0.0)
        loss = c * sums[0] + 0.5 * float(penalty @ penalty)
        if loss > self.loss + 1e-12 * abs(self.loss):
            self.step = self.step / 2
            self.tried = self.kept + self.step
            self.done = bool(np.abs(self.step).max() < 1e-10)
            return
        self.loss, self.kept = loss, self.tried
        gradient = (c * sums[1 : 1 + size] + penalty)[self.use]
        hessian = c * sums[1 + size :].reshape(size, size)[np.ix_(self.use, self.use)]
        hessian[np.diag_indices(len(hessian) - 1)] += 1.0
        # a trace of curvature where a model is certain of all rows
        hessian[-1, -1] += 1e-12 * max(hessian[-1, -1], 1.0)
        self.step = np.zeros(size)
        self.step[self.use] = -np.linalg.solve(hessian, gradient)
        self.done = bool(np.abs(self.step).max() < 1e-9 * max(1.0, np.abs(self.kept).max()))
        self.tried = self.kept + self.step


def _arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Columns with NaN for null, and which rows are in each group."""
    x = np.column_stack([batch.column(j).to_numpy(zero_copy_only=False).astype(float) for j in range(width)])
    return x, [batch.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in range(width, batch.num_columns)]


def _prepared(df: DataFrame, columns: Sequence[str], groups: dict[str, Column]) -> DataFrame:
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"x{j}") for j, c in enumerate(columns)]
    return df.select(*values, *[F.coalesce(cond, F.lit(False)).alias(f"g{k}") for k, cond in enumerate(groups.values())])


def _add(rows: pa.Table) -> pa.Table:
    total = np.sum([np.asarray(v) for v in rows["v"].to_pylist()], axis=0)
    return pa.table({"unit": rows["unit"][:1], "part": rows["part"][:1], "v": pa.array([total], pa.list_(pa.float64()))})


def unit_sums(data: DataFrame, width: int, sums: Callable[[np.ndarray, list[np.ndarray]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sums over all rows of the vectors that ``sums(columns, groups)`` gives per unit for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if len(batch):
                for unit, v in sums(*_arrays(batch, width)).items():
                    total[unit] = total[unit] + v if unit in total else v
        for unit, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), pa.array([v], pa.list_(pa.float64()))], names=["unit", "v"])

    partial, tasks = data.mapInArrow(run, "unit int, v array<double>"), data.rdd.getNumPartitions()
    while tasks > MEET:
        # one vector per unit and task
        tasks = -(-tasks // MEET)
        partial = partial.withColumn("part", (F.spark_partition_id() % tasks).cast("int")).groupBy("unit", "part").applyInArrow(_add, "unit int, part int, v array<double>").select("unit", "v")
    total: dict[int, np.ndarray] = {}
    # at most MEET vectors per unit
    for batch in partial.toArrow().to_batches():
        for unit, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[unit] = total[unit] + np.asarray(v) if unit in total else np.asarray(v)
    return total


def describe(data: DataFrame, columns: Sequence[str], groups: dict[str, Column]) -> list[Group]:
    """Counts, means and deviations of every column in every group, from two passes."""
    width = len(columns)

    def first(x: np.ndarray, inside: list[np.ndarray]) -> dict[int, np.ndarray]:
        out = {}
        for k, rows in enumerate(inside):
            part = x[rows]
            out[k] = np.concatenate([[len(part)], (~np.isnan(part)).sum(axis=0), np.nansum(part, axis=0)])
        return out

    sums = unit_sums(data, width, first)
    empty = np.zeros(1 + 2 * width)
    totals = [sums.get(k, empty) for k in range(len(groups))]
    present = [t[1 : 1 + width] for t in totals]
    means = [np.where(p > 0, t[1 + width :] / np.maximum(p, 1), 0.0) for t, p in zip(totals, present, strict=True)]

    def second(x: np.ndarray, inside: list[np.ndarray]) -> dict[int, np.ndarray]:
        return {k: np.nansum((x[rows] - means[k]) ** 2, axis=0) for k, rows in enumerate(inside)}

    squares = unit_sums(data, width, second)
    out = []
    for k, name in enumerate(groups):
        n = totals[k][0]
        # filling with the mean shrinks the variance by the share of rows that were present
        sd = np.sqrt(squares.get(k, np.zeros(width)) / max(n, 1))
        out.append(Group(name, n, present[k], means[k], np.where(sd > 0, sd, 1.0)))
    return out


def fit_missing(df: DataFrame, columns: Sequence[str], groups: dict[str, Column], c: float = 1.0) -> tuple[list[Group], list[Model], DataFrame]:
    """Models of the null indicator of every column in every group, minimising ``|w|^2 / 2 + c * sum(loss)`` with a free
    intercept; the groups; and the prepared rows."""
    data, width = _prepared(df, columns, groups), len(columns)
    found = describe(data, columns, groups)
    models = [Model(g, j, group.used(j), np.zeros(width + 1)) for g, group in enumerate(found) for j in group.targets]
    for _ in range(STEPS):
        open_ = [m for m in models if not m.done]
        if not open_:
            return found, models, data
        weights = [(m.group, m.target, m.tried) for m in open_]

        def derivatives(x: np.ndarray, inside: list[np.ndarray], weights=weights) -> dict[int, np.ndarray]:
            out, designs = {}, {}
            for unit, (g, j, w) in enumerate(weights):
                if g not in designs:
                    rows = x[inside[g]]
                    designs[g] = (found[g].design(rows), np.isnan(rows))
                z, gone = designs[g]
                score, y = z @ w, gone[:, j].astype(float)
                p = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
                loss = (np.logaddexp(0.0, score) - y * score).sum()
                out[unit] = np.concatenate([[loss], z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])
            return out

        sums = unit_sums(data, width, derivatives)
        for unit, m in enumerate(open_):
            m.take(sums[unit], c)
    raise ArithmeticError(f"{sum(not m.done for m in models)} of {len(models)} models have not converged")


def scores(data: DataFrame, width: int, groups: Sequence[Group], models: Sequence[Model]) -> DataFrame:
    """``(unit, y, p)``: for every model and row of its group, the indicator and its probability, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, inside = _arrays(batch, width)
            for unit, m in enumerate(models):
                rows = x[inside[m.group]]
                if len(rows):
                    # equal rows get equal scores, whatever batch they are in
                    p = np.round(1 / (1 + np.exp(-np.clip(groups[m.group].design(rows) @ m.kept, -700, 700))), 12)
                    y = np.isnan(rows[:, m.target])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), unit), pa.int32()), pa.array(y.astype("int32")), pa.array(p)], names=["unit", "y", "p"])

    return data.mapInArrow(run, "unit int, y int, p double")
