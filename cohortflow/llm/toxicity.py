"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy.

A word's vector is the sum of rows of a hashed table, one for the word and one for each of its beginnings of some
lengths, so words never seen before are known by how they start. Filters of several widths run over the words, each
filter's largest response is kept, and a linear layer scores them. Rows of the table that no training word uses stay zero: unseen words say nothing. Thresholds are
calibrated for each language, told from the text's function words, such that 0.5 is the threshold everywhere.

Rows: null, empty and wordless texts get the score of no response at all. Without labels of both classes every score
is the labels' share (0 without labels). Repeated rows score alike. Extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortflow.llm.labelled import calibrate, logistic, training_rows
from cohortflow.llm.text import FOLDED, NOT_BARE, U64, chunks, mix, prefix_hash, rows_with, span_hash, words

TRAIN_ROWS = 5000
BITS = 19
WIDTH = 8
STARTS = (4, 6)  # bytes of the beginnings of a word that have rows of their own
LEAST_SEEN = 3
SPANS = (1, 2, 3)
FILTERS = 16
LEAST_POSITIVE = 20
BLOCK_WORDS = 1 << 15

# Frequent function words of each language
FUNCTION_WORDS = {
    "en": "the and of to is that it for with as was on be by are this not from have which",
    "de": "der die und das ist nicht ein eine zu den mit von auf für dem sich des im auch als",
    "fr": "le la les et des est une du que qui dans pour pas sur au avec ce il elle ne",
    "es": "el los las y del que en una por con para su al lo como más pero es se no",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def _language_table() -> np.ndarray:
    """Language of a word by its hash's first 16 bits; words of several languages count for none."""
    found: dict[int, set[int]] = {}
    for k, listed in enumerate(FUNCTION_WORDS.values()):
        for word in listed.split():
            buf = np.frombuffer(word.encode(), np.uint8)
            h = span_hash(prefix_hash(buf, FOLDED), np.array([0]), np.array([len(buf)]))[0]
            found.setdefault(int(h >> U64(48)), set()).add(k)
    table = np.full(1 << 16, len(FUNCTION_WORDS), np.int8)
    for h, which in found.items():
        if len(which) == 1:
            table[h] = which.pop()
    return table


def encode(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of the bare words (one column a kind), where texts begin among them, and each text's language."""
    start, end, begin = words(buf, off, NOT_BARE)
    prefix = prefix_hash(buf, FOLDED)
    h = span_hash(prefix, start, end)
    kinds = [h] + [mix(span_hash(prefix, start, np.minimum(start + n, end)) + U64(n)) for n in STARTS]
    slots = np.stack([(k >> U64(64 - BITS)).astype(np.int32) for k in kinds], 1)
    kind = _language_table()[(h >> U64(48)).astype(np.int64)]
    votes = np.zeros((len(off) - 1, len(LANGUAGES)), np.int64)
    for k in range(len(FUNCTION_WORDS)):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        votes[:, k] = total[begin[1:]] - total[begin[:-1]]
    return slots, begin, np.where(votes.any(1), votes.argmax(1), len(FUNCTION_WORDS))


def _embed(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    x = table[slots[:, 0]]
    for k in range(1, slots.shape[1]):
        x += table[slots[:, k]]
    return x


@dataclass
class ToxicModel:
    table: np.ndarray  # 2**BITS x WIDTH
    filters: list[np.ndarray]  # for each span: span x WIDTH x FILTERS
    biases: list[np.ndarray]
    out: np.ndarray
    slope: float
    intercepts: np.ndarray  # by language

    def pooled(self, slots: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each row; 0 in rows with fewer words than the filter spans."""
        n = len(begin) - 1
        out = np.zeros((n, len(SPANS) * FILTERS), np.float32)
        x = _embed(self.table, slots)
        row = np.repeat(np.arange(n), np.diff(begin))
        for g, span in enumerate(SPANS):
            if len(x) < span:
                continue
            top = np.zeros((n, FILTERS), np.float32)
            for i in range(0, len(x) - span + 1, BLOCK_WORDS):
                j = min(i + BLOCK_WORDS, len(x) - span + 1)
                response = self.biases[g] + x[i:j] @ self.filters[g][0]
                for k in range(1, span):
                    response += x[i + k : j + k] @ self.filters[g][k]
                whole = np.flatnonzero(row[i:j] == row[i + span - 1 : j + span - 1])
                if len(whole):
                    rows = row[i + whole]
                    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                    best = np.maximum.reduceat(response[whole], first, axis=0)
                    top[rows[first]] = np.maximum(top[rows[first]], best)
            out[:, g * FILTERS : (g + 1) * FILTERS] = top
        return out

    def score(self, slots: np.ndarray, begin: np.ndarray, language: np.ndarray) -> np.ndarray:
        z = self.pooled(slots, begin) @ self.out
        return logistic(self.slope * z + self.intercepts[language])


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, buf, off in chunks(batch):
            slots, begin, language = encode(buf, off)
            texts = [slots[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array(texts, pa.binary()), pa.array(language, pa.int32())], names=["doc_id", "y", "words", "language"]
            )


def _start(texts: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Table with small random rows for training words; the first number of a row says how much likelier its words
    are in texts of label 1, where enough texts have them."""
    size = 1 << BITS
    seen = np.zeros((2, size))
    for t, label in zip(texts, y, strict=True):
        seen[int(label), np.unique(t)] += 1
    used = seen.sum(0) > 0
    ones, zeros = max((y == 1).sum(), 1), max((y == 0).sum(), 1)
    odds = np.log((seen[1] + 0.5) / (ones + 1)) - np.log((seen[0] + 0.5) / (zeros + 1))
    trust = seen.sum(0) / (seen.sum(0) + 5.0)
    table = (rng.standard_normal((size, WIDTH)) * 0.02).astype(np.float32)
    table[:, 0] = np.where(seen.sum(0) >= LEAST_SEEN, np.clip(odds * trust, -4, 4) * 0.5, 0)
    table[~used] = 0
    return table


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = TRAIN_ROWS, epochs: int = 6, rate: float = 0.05, seed: int = 11,
    key: str = "doc_id", text: str = "text",
) -> ToxicModel | float:
    """Train on at most ``bound`` labelled rows; the share of label 1 when a class is missing.

    Adaptive gradient steps row by row; every fifth row is left out and calibrates scores and thresholds.
    """
    rows, counts = training_rows(docs, labels, label, bound, key, text)
    got = rows.mapInArrow(_encoded, "doc_id long, y int, words binary, language int").toArrow().sort_by("doc_id")
    y = got["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return counts[1] / max(sum(counts), 1)
    texts = [np.frombuffer(w, np.int32).reshape(-1, 1 + len(STARTS)) for w in got["words"].to_pylist()]
    language = got["language"].to_numpy()
    fitted = np.flatnonzero(np.arange(len(y)) % 5 != 0)
    rng = np.random.default_rng(seed)
    table = _start([texts[i] for i in fitted], y[fitted], rng)
    filters = [(rng.standard_normal((s, WIDTH, FILTERS)) * 0.1).astype(np.float32) for s in SPANS]
    for f in filters:  # every filter starts by listening to the odds, half of them to each sign
        f[:, 0, : FILTERS // 2] += 0.5
        f[:, 0, FILTERS // 2 :] -= 0.5
    biases = [np.zeros(FILTERS, np.float32) for _ in SPANS]
    out = (rng.standard_normal(len(SPANS) * FILTERS) * 0.1).astype(np.float32)
    offset = 0.0
    memory: dict[str, np.ndarray] = {"table": np.full(table.shape, 1e-6, np.float32), "out": np.full(out.shape, 1e-6, np.float32)}
    memory |= {f"f{g}": np.full(f.shape, 1e-6, np.float32) for g, f in enumerate(filters)}
    memory |= {f"b{g}": np.full(b.shape, 1e-6, np.float32) for g, b in enumerate(biases)}

    def step(name: str, value: np.ndarray, gradient: np.ndarray, at=...) -> None:
        memory[name][at] += gradient * gradient
        value[at] -= rate * gradient / np.sqrt(memory[name][at])

    share = {0: 0.5 / max((y[fitted] == 0).mean(), 1e-9), 1: 0.5 / max((y[fitted] == 1).mean(), 1e-9)}
    lanes = np.arange(FILTERS)
    for _ in range(epochs):
        for i in rng.permutation(fitted):
            if not len(texts[i]):
                continue
            x = _embed(table, texts[i])
            pooled, places = np.zeros(len(out), np.float32), []
            for g, span in enumerate(SPANS):
                places.append(None)
                if len(x) < span:
                    continue
                response = sum(x[k : len(x) - span + 1 + k] @ filters[g][k] for k in range(span)) + biases[g]
                place = response.argmax(0)
                top = response[place, lanes]
                pooled[g * FILTERS : (g + 1) * FILTERS] = np.maximum(top, 0)
                places[g] = (place, top > 0)
            error = np.float32(share[int(y[i])] * (logistic(np.array(pooled @ out + offset)) - y[i]))
            back = error * out
            for g, span in enumerate(SPANS):
                if places[g] is None:
                    continue
                place, alive = places[g]
                d = np.where(alive, back[g * FILTERS : (g + 1) * FILTERS], 0).astype(np.float32)
                if not d.any():
                    continue
                into = [x[place + k] for k in range(span)]  # FILTERS x WIDTH
                down = [filters[g][k].T * d[:, None] for k in range(span)]
                step(f"f{g}", filters[g], np.stack([(v * d[:, None]).T for v in into]))
                step(f"b{g}", biases[g], d)
                for k in range(span):
                    for slots in texts[i][place + k].T:
                        rows_, back_to = np.unique(slots, return_inverse=True)
                        total = np.zeros((len(rows_), WIDTH), np.float32)
                        np.add.at(total, back_to, down[k])
                        step("table", table, total, rows_)
            step("out", out, error * pooled)
            offset -= rate * float(error) * 0.1
    model = ToxicModel(table, filters, biases, out, 1.0, np.zeros(len(LANGUAGES)))
    left = np.setdiff1d(np.arange(len(y)), fitted)
    z = np.concatenate([model.pooled(texts[i], np.array([0, len(texts[i])])) @ out for i in left])
    model.slope, intercept = calibrate(z, y[left], counts)
    model.intercepts[:] = intercept
    for k in range(len(LANGUAGES)):
        own = language[left] == k
        if min((y[left][own] == 1).sum(), (y[left][own] == 0).sum()) >= LEAST_POSITIVE:
            model.intercepts[k] = -model.slope * _threshold(z[own], y[left][own], counts, -intercept / model.slope)
    return model


def _threshold(z: np.ndarray, y: np.ndarray, counts: list[int], usual: float) -> float:
    """The threshold with the fewest weighted errors; among equals the one nearest to ``usual``."""
    order = np.sort(z)
    cuts = np.concatenate([[usual], (order[1:] + order[:-1]) / 2])
    ones, zeros = counts[1] / max((y == 1).sum(), 1), counts[0] / max((y == 0).sum(), 1)
    errors = [ones * ((z < c) & (y == 1)).sum() + zeros * ((z >= c) & (y == 0)).sum() for c in cuts]
    best = np.flatnonzero(np.array(errors) <= min(errors) + 1e-9)
    return float(cuts[best[np.abs(cuts[best] - usual).argmin()]])


def score(docs: DataFrame, model: ToxicModel | float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(vars(model) if isinstance(model, ToxicModel) else model)  # 2**BITS x WIDTH floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicModel(**shipped.value) if isinstance(shipped.value, dict) else shipped.value
        for batch in batches:
            for rows, buf, off in chunks(batch):
                p = np.full(len(rows), float(model)) if isinstance(model, float) else model.score(*encode(buf, off))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p.astype(np.float64))], names=["doc_id", "score"])

    return rows_with(docs, key, text).mapInArrow(run, "doc_id long, score double")
