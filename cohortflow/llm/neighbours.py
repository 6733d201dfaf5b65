"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts become weighted counts of hashed byte trigrams plus a few terms for their shape (how often words repeat, how
many signs and capitals they have, how long words are). A truncated singular value decomposition of a bounded sample
of labelled rows gives the latent space; the sample's vectors, a matrix of bounded size, are broadcast. Every document
is multiplied with all of them in blocks (exact cosines), and its nearest neighbours vote with their similarity.

Rows: null and empty texts have a zero vector, no neighbours, and score the share of label 1. Without labels every
score is 0.5. Ties in similarity fall to the smaller doc_id. Repeated rows score alike. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortflow.llm.labelled import calibrate, logistic, training_rows
from cohortflow.llm.quality_rules import SYMBOL, Parsed, _per_row
from cohortflow.llm.text import chunks, kept_rows, rows_with

TRAIN_ROWS = 4000
TERMS = 4096
SHAPES = 8
LEVELS = 16
WIDTH = TERMS + SHAPES * LEVELS
LATENT = 64
NEIGHBOURS = 15
BLOCK = 256
SHAPE_WEIGHT = 0.25
SHARPNESS = 4
THRESHOLD = 0.3

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True


def _shapes(t: Parsed) -> np.ndarray:
    """Levels 0 to LEVELS - 1 of each property, one column a property."""
    size = np.maximum(np.diff(t.off), 1)
    n = np.maximum(t.n_words, 1)
    keyed = t.word ^ (t.row.astype(np.uint64) << np.uint64(40))
    order = np.argsort(keyed, kind="stable")
    fresh = np.ones(len(keyed), bool)
    fresh[order[1:]] = keyed[order[1:]] != keyed[order[:-1]]
    distinct = np.bincount(t.row[fresh], minlength=len(size))
    shares = [
        distinct / n, np.sqrt(_per_row(SYMBOL[t.buf], t.off) / size), np.sqrt(_per_row(UPPER[t.buf], t.off) / size),
        np.sqrt(_per_row(DIGIT[t.buf], t.off) / size), np.clip(_per_row(t.end - t.start, t.begin) / n / 16, 0, 1),
        np.clip(np.log1p(t.n_words) / 12, 0, 1), np.sqrt(_per_row(t.buf == 33, t.off) / size), np.sqrt(_per_row(t.buf == 10, t.off) / size),
    ]
    return np.stack([np.minimum((np.nan_to_num(s) * LEVELS).astype(np.int64), LEVELS - 1) for s in shares], 1)


def term_matrix(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks of rows as dense float matrices: root counts of trigrams with unit length, and the shape terms."""
    t = Parsed(buf, off)
    wide = buf.astype(np.uint32)
    gram = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16 if len(buf) > 2 else wide[:0]
    bucket = (gram * np.uint32(0x9E3779B1)) >> np.uint32(20)
    shape = _shapes(t)
    for i in range(0, len(off) - 1, BLOCK):
        j = min(i + BLOCK, len(off) - 1)
        out = np.zeros((j - i, WIDTH), np.float32)
        for k in range(i, j):
            a, b = off[k], max(off[k + 1] - 2, off[k])
            if b > a:
                out[k - i, :TERMS] = np.bincount(bucket[a:b], minlength=TERMS)
        np.sqrt(out, out=out)
        has = t.n_words[i:j] > 0
        for s in range(SHAPES):
            out[np.flatnonzero(has), TERMS + s * LEVELS + shape[i:j, s][has]] = 1.0
        yield i, j, out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class NeighbourModel:
    idf: np.ndarray
    axes: np.ndarray  # WIDTH x LATENT
    vectors: np.ndarray  # labelled rows x LATENT, unit length
    labels: np.ndarray
    share: float
    slope: float = 1.0
    intercept: float = 0.0

    def weighted(self, terms: np.ndarray) -> np.ndarray:
        x = terms * self.idf
        x[:, :TERMS] = _unit(x[:, :TERMS])
        x[:, TERMS:] *= SHAPE_WEIGHT
        return x

    def vote(self, terms: np.ndarray, leave_out: np.ndarray | None = None) -> np.ndarray:
        """Share of label 1 among the nearest rows, weighted by similarity; the classes' sizes are evened out."""
        latent = _unit(self.weighted(terms) @ self.axes)
        cosine = latent @ self.vectors.T
        if leave_out is not None:
            cosine[np.arange(len(cosine)), leave_out] = -2.0
        k = min(NEIGHBOURS, cosine.shape[1] - (leave_out is not None))
        # equal similarities fall to the earlier row, that is to the smaller doc_id
        ranked = cosine.astype(np.float64) - np.arange(cosine.shape[1]) * 1e-12
        near = np.argpartition(-ranked, k - 1, axis=1)[:, :k] if k < cosine.shape[1] else np.argsort(-ranked, axis=1)
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0.0).astype(np.float64) ** SHARPNESS
        total = weight.sum(1)
        return np.where(total > 0, (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-300), self.labels.mean())

    def score(self, terms: np.ndarray) -> np.ndarray:
        p = logistic(self.slope * self.vote(terms) + self.intercept)
        return np.where(terms.any(1), p, self.share)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, off in chunks(batch):
            for i, j, block in term_matrix(buf, off):
                packed = [r.astype(np.float16).tobytes() for r in block]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).slice(i, j - i), rows.column(2).slice(i, j - i), pa.array(packed, pa.binary())], names=["doc_id", "y", "terms"]
                )


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = TRAIN_ROWS, seed: int = 7, key: str = "doc_id", text: str = "text",
) -> NeighbourModel | None:
    """Latent space and labelled vectors from at most ``bound`` rows; None without labels."""
    rows, counts = training_rows(docs, labels, label, bound, key, text)
    got = rows.mapInArrow(_terms, "doc_id long, y int, terms binary").toArrow().sort_by("doc_id")
    y = got["y"].to_numpy().astype(np.float64)
    if not len(y):
        return None
    terms = np.frombuffer(b"".join(got["terms"].to_pylist()), np.float16).reshape(len(y), WIDTH).astype(np.float32)
    present = (terms > 0).sum(0)
    model = NeighbourModel(np.log1p(len(y) / (1.0 + present)).astype(np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), y, counts[1] / max(sum(counts), 1))
    x = model.weighted(terms)
    rank = min(LATENT, len(y))
    # randomised range finder with two power steps
    basis = np.linalg.qr(x @ np.random.default_rng(seed).standard_normal((WIDTH, min(rank + 16, len(y)))).astype(np.float32))[0]
    for _ in range(2):
        basis = np.linalg.qr(x @ (x.T @ basis))[0]
    model.axes = np.linalg.svd(basis.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)
    model.vectors = _unit(x @ model.axes).astype(np.float32)
    if len(y) > 1:
        votes = np.concatenate([model.vote(terms[i : i + BLOCK], np.arange(i, min(i + BLOCK, len(y)))) for i in range(0, len(y), BLOCK)])
        model.slope, model.intercept = calibrate(votes, y, counts)
    return model


def score(docs: DataFrame, model: NeighbourModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row, higher where label 1 is likelier."""
    shipped = docs.sparkSession.sparkContext.broadcast(model and vars(model))  # TRAIN_ROWS x LATENT + WIDTH x LATENT floats at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value and NeighbourModel(**shipped.value)
        for batch in batches:
            for rows, buf, off in chunks(batch):
                for i, j, block in term_matrix(buf, off):
                    p = model.score(block) if model else np.full(j - i, 0.5)
                    yield pa.RecordBatch.from_arrays([rows.column(0).slice(i, j - i), pa.array(p.astype(np.float64))], names=["doc_id", "score"])

    return rows_with(docs, key, text).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: NeighbourModel | None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows whose score reaches ``threshold``, as they are and with all their columns; all without a model."""

    def wanted(buf: np.ndarray, off: np.ndarray, model: dict | None) -> np.ndarray:
        if not model:
            return np.ones(len(off) - 1, bool)
        own = NeighbourModel(**model)
        return np.concatenate([own.score(block) >= threshold for _, _, block in term_matrix(buf, off)])

    return kept_rows(docs, text, wanted, model and vars(model))
