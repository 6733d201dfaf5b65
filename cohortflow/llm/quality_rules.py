"""Quality rules: counted base rules and a calibrated n-gram logistic regression.

Every text is described by four groups of hashed n-grams: pairs and quadruples of bytes, words and pairs of words.
A logistic regression on their relative frequencies is trained in numpy on a bounded sample of labelled rows
(``bound``), its scores are calibrated to probabilities on rows set aside, and all rows are scored in Arrow batches.
A row is kept when no base rule fails and its probability reaches a fixed threshold.

Rows: null and empty texts have no words, so they fail the base rules. Without labels of both classes the base
rules decide alone. Repeated rows are judged alike. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortflow.llm.labelled import calibrate, logistic, training_rows
from cohortflow.llm.text import SPACE, U64, chunks, kept_rows, mix, prefix_hash, row_of, rows_with, span_hash, words

TRAIN_ROWS = 3000
THRESHOLD = 0.5
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
BUCKETS = 1 << 16
GROUPS = 4

# Characters that count as symbols
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of a per-byte (or per-word) array over the rows."""
    total = np.zeros(len(flags) + 1, np.float64 if flags.dtype.kind == "f" else np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


class Parsed:
    """What rules and features need of a chunk, computed once."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        self.start, self.end, self.begin = words(buf, off)
        self.prefix = prefix_hash(buf)
        self.word = span_hash(self.prefix, self.start, self.end)
        self.n_words = np.diff(self.begin)
        self.row = row_of(self.n_words)


def base_counts(t: Parsed) -> dict[str, np.ndarray]:
    """Exact counts of the base rules for every row of a chunk."""
    buf, off = t.buf, t.off
    lead = (buf & 0xC0) != 0x80
    out = {"n_words": t.n_words, "word_chars": _per_row(~SPACE[buf] & lead, off), "n_symbols": _per_row(SYMBOL[buf], off)}

    breaks = np.flatnonzero(buf == 10)
    n = len(off) - 1
    line_start = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    line_row = np.sort(np.concatenate([np.arange(n), np.searchsorted(off, breaks, "right") - 1]), kind="stable")
    line_end = np.sort(np.concatenate([off[1:], breaks]), kind="stable")
    filled = np.searchsorted(t.start, line_end) > np.searchsorted(t.start, line_start)
    line_start, line_end, line_row = line_start[filled], line_end[filled], line_row[filled]
    key = mix(span_hash(t.prefix, line_start, line_end) + line_row.astype(U64))
    again = pd.Series(key).duplicated().to_numpy()
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=n)

    repeated = np.zeros(len(t.word) + 2, bool)
    if len(t.word) > 2:
        whole = t.row[2:] == t.row[:-2]
        window = mix(t.word[:-2] + mix(t.word[1:-1] + mix(t.word[2:] + t.row[2:].astype(U64))))
        at = np.flatnonzero(whole)
        at = at[pd.Series(window[at]).duplicated(keep=False).to_numpy()]
        for k in range(3):
            repeated[at + k] = True
    out["n_repeat_words"] = _per_row(repeated[: len(t.word)], t.begin)
    return out


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED_PERCENT * counts["n_words"])


def _ends(off: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's n-grams begin and end among ``total`` of them."""
    first = np.minimum(off[:-1], total)
    return first, np.clip(off[1:] - n + 1, first, total)


def _grams(t: Parsed) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Group by group: buckets of all positions, and where each row's positions begin and end."""
    wide = t.buf.astype(np.uint32)
    pair = wide[:-1] | wide[1:] << 8
    yield pair, *_ends(t.off, 2, len(pair))
    quad = ((pair[:-2] | pair[2:] << 16) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    yield quad, *_ends(t.off, 4, len(quad))
    yield (t.word >> U64(48)).astype(np.uint32), *_ends(t.begin, 1, len(t.word))
    both = (mix(t.word[:-1] * U64(3) + t.word[1:]) >> U64(48)).astype(np.uint32)
    yield both, *_ends(t.begin, 2, len(both))


def raw_scores(t: Parsed, weights: np.ndarray) -> np.ndarray:
    """Mean weight of each group's n-grams, summed over the groups; 0 without any."""
    total = np.zeros(len(t.off) - 1)
    for table, (bucket, a, b) in zip(weights, _grams(t), strict=True):
        sums = np.zeros(len(bucket) + 1)
        np.cumsum(table[bucket], out=sums[1:])
        total += (sums[b] - sums[a]) / np.maximum(b - a, 1)
    return total


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse relative frequencies of the training rows."""
    for batch in batches:
        for rows, buf, off in chunks(batch):
            cells, values = [[] for _ in rows.column(0)], [[] for _ in rows.column(0)]
            for g, (bucket, a, b) in enumerate(_grams(Parsed(buf, off))):
                for k in range(len(rows)):
                    at, n = np.unique(bucket[a[k] : b[k]], return_counts=True)
                    cells[k].append(at.astype(np.int32) + g * BUCKETS)
                    values[k].append((n / max(b[k] - a[k], 1)).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array([np.concatenate(c) for c in cells], pa.list_(pa.int32())), pa.array([np.concatenate(v) for v in values], pa.list_(pa.float32()))],
                names=["doc_id", "y", "cells", "values"],
            )


@dataclass
class QualityModel:
    weights: np.ndarray  # GROUPS x BUCKETS
    slope: float
    intercept: float

    def probability(self, t: Parsed) -> np.ndarray:
        return logistic(self.slope * raw_scores(t, self.weights) + self.intercept)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = TRAIN_ROWS, steps: int = 80, rate: float = 0.5,
    ridge: float = 1e-4, key: str = "doc_id", text: str = "text",
) -> QualityModel | None:
    """Train on at most ``bound`` labelled rows; None without rows of both classes.

    Buckets are scaled by their spread, the loss is minimised by gradient steps with per-weight rates. Every fifth
    row is left out and calibrates the probabilities.
    """
    rows, counts = training_rows(docs, labels, label, bound, key, text)
    got = rows.mapInArrow(_features, "doc_id long, y int, cells array<int>, values array<float>").toArrow()
    y = got["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    place = np.empty(len(y), np.int64)
    place[order] = np.arange(len(y))
    cells_, values_ = got["cells"].combine_chunks(), got["values"].combine_chunks()
    size = np.diff(cells_.offsets.to_numpy())
    row = place[np.repeat(np.arange(len(y)), size)]
    cell = cells_.values.to_numpy()
    value = values_.values.to_numpy().astype(np.float64)
    y = y[order].astype(float)
    n, width = len(y), GROUPS * BUCKETS
    scale = 1.0 / np.sqrt(np.bincount(cell, value * value, width) / n + 1e-7)
    value = value * scale[cell] / 100.0
    fitted = np.arange(n) % 5 != 0
    share = np.where(y == 1, 0.5 / max((y[fitted] == 1).sum(), 1), 0.5 / max((y[fitted] == 0).sum(), 1)) * fitted
    w, bias, seen, seen_bias = np.zeros(width), 0.0, np.full(width, 1e-8), 1e-8
    for _ in range(steps):
        residual = share * (logistic(np.bincount(row, value * w[cell], n) + bias) - y)
        gradient = np.bincount(cell, value * residual[row], width) + ridge * w
        seen += gradient * gradient
        w -= rate * gradient / np.sqrt(seen)
        seen_bias += residual.sum() ** 2
        bias -= rate * residual.sum() / np.sqrt(seen_bias)
    z = np.bincount(row, value * w[cell], n)
    slope, intercept = calibrate(z[~fitted], y[~fitted], counts)
    return QualityModel((w * scale / 100.0).reshape(GROUPS, BUCKETS).astype(np.float32), slope, intercept)


def judge(
    docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Counts, ``base_failed``, ``probability`` (1 without a model) and ``kept`` of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model and vars(model))  # GROUPS * BUCKETS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value and QualityModel(**shipped.value)
        for batch in batches:
            for rows, buf, off in chunks(batch):
                t = Parsed(buf, off)
                counts = base_counts(t)
                failed = base_failed(counts)
                p = model.probability(t) if model else np.ones(len(rows))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *(pa.array(c, pa.int64()) for c in counts.values()), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))],
                    names=["doc_id", *counts, "base_failed", "probability", "kept"],
                )

    return rows_with(docs, key, text).mapInArrow(run, f"{COUNTS}, base_failed boolean, probability double, kept boolean")


def keep(docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows that ``judge`` keeps, as they are and with all their columns."""

    def wanted(buf: np.ndarray, off: np.ndarray, model: dict | None) -> np.ndarray:
        t = Parsed(buf, off)
        p = QualityModel(**model).probability(t) if model else np.ones(len(off) - 1)
        return ~base_failed(base_counts(t)) & (p >= threshold)

    return kept_rows(docs, text, wanted, model and vars(model))
