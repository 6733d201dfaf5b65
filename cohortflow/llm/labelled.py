"""Labelled rows for the trained filters: bounded, the same on every run, never the held-out fifth."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortflow.llm.text import rows_with
from cohortflow.session import settle

FOLDS = 5
MOST_BYTES = 64 << 20


def held_out(key: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text is divisible by ``FOLDS``; rows without id are not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, bound: int, key: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES
) -> tuple[DataFrame, list[int]]:
    """``(doc_id, text, y)`` of at most ``bound`` labelled ids and ``most_bytes`` of text, half of each class at most, and
    all their labels' counts.

    Chosen by the hash of the id, so a larger table gives other rows but the same kind. Labels other than 0 and 1,
    null ids, ids that ``docs`` lacks and held-out rows are neither chosen nor counted; an id labelled twice counts with
    its smaller label. An id that several rows share gives one, that of the smallest hash of the text. Texts of more than
    a 64th of ``most_bytes`` are not learnt from, so the bound in bytes leaves room for many texts.
    """
    there = docs.select(F.col(key).cast("long").alias("doc_id")).distinct()
    usable = settle(
        labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .where(~held_out("doc_id"))
        .groupBy("doc_id").agg(F.min("y").alias("y"))
        .join(there, "doc_id", "left_semi")
    )
    counts = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    picked = [
        usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound // 2) for y in (0, 1)
    ]
    # at most ``bound`` rows of two numbers
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    rows = rows_with(docs, key, text).join(ids, "doc_id").select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where(F.octet_length("text") <= most_bytes // 64)
    # copies of an id are reduced before they meet
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    rows = settle(rows.select("doc_id", "t.text", "y"))
    # at most ``bound`` rows of two numbers
    in_turn = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")
    within = rows.select("doc_id", "y", F.sum(F.octet_length("text")).over(in_turn).alias("b")).where(F.col("b") <= most_bytes // 2)
    return rows.join(F.broadcast(within.select("doc_id")), "doc_id").select("doc_id", "text", "y"), [counts.get(0, 0), counts.get(1, 0)]


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def calibrate(z: np.ndarray, y: np.ndarray, counts: list[int], steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic curve from raw scores to probabilities.

    Classes weigh as in all labels, not as in the balanced sample. Labels are smoothed, so that separable scores
    give finite values; Newton's method.
    """
    if not len(z) or y.min() == y.max():
        return 1.0, 0.0
    spread = max(float(z.std()), 1e-9)
    x = np.stack([z / spread, np.ones(len(z))], 1)
    ones = max(int(y.sum()), 1)
    zeros = max(len(y) - ones, 1)
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    weight = np.where(y == 1, max(counts[1], 1) / ones, max(counts[0], 1) / zeros)
    weight = weight / weight.mean()
    beta = np.zeros(2)
    for _ in range(steps):
        p = logistic(x @ beta)
        gradient = x.T @ (weight * (p - target)) + 1e-4 * beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= step * min(1.0, 4.0 / max(float(np.abs(step).max()), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-6) / spread, float(beta[1])
