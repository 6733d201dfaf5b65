"""Trained filters: exact counts, held-out accuracy, odd rows."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortflow.llm import labelled, neighbours, quality_rules, toxicity
from cohortflow.llm.text import chunks

ROOT = "/root/testdata/sf0.01"


def batch_of(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])


def brute_counts(text):
    words = [w for w in __import__("re").split(r"[ \t-\r]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_base_counts():
    rng = random.Random(4)
    parts = ["a", "b", "é", "日本", "🙂", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\x0c", "\r", "#", "*|", "<>", "\x1c", " ", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(800)] + ["", "x y z x y z", "l\nl\n l\nl", "a " * 400]
    got = []
    for _, buf, off in chunks(batch_of(texts), size=500):
        got += list(zip(*(c.tolist() for c in quality_rules.base_counts(quality_rules.Parsed(buf, off)).values()), strict=True))
    assert got == [brute_counts(t) for t in texts]


def test_base_rules_and_columns(odd_docs):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.judge(odd_docs, None).collect()}
    assert got[(4, 0)].base_failed and not got[(4, 0)].kept and got[(1, 300)].kept and got[(10, 108)].base_failed
    kept = quality_rules.keep(odd_docs, None)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 8, 9, 11, 14, 15, None}


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(quality_rules.GROUPS, quality_rules.BUCKETS)).astype(np.float32)
    texts = ["one two", "", "three", "a", "aé🙂 longer text here", "x" * 50]
    whole = [quality_rules.raw_scores(quality_rules.Parsed(b, o), weights) for _, b, o in chunks(batch_of(texts))][0]
    alone = [quality_rules.raw_scores(quality_rules.Parsed(b, o), weights)[0] for t in texts for _, b, o in chunks(batch_of([t]))]
    assert np.allclose(whole, alone)


def test_training_rows(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("quality")).union(docs.select("doc_id", F.lit(None)).limit(5))
    rows, counts = labelled.training_rows(docs, labels, "quality", 100)
    got = rows.collect()
    held = {r.doc_id for r in docs.where(labelled.held_out()).collect()}
    assert 150 < len(held) < 250 and not held & {r.doc_id for r in got}
    assert Counter(r.y for r in got) == {0: 50, 1: 50} and sum(counts) == 1000 - len(held)
    assert {r.doc_id for r in got} == {r.doc_id for r in labelled.training_rows(docs.repartition(7), labels, "quality", 100)[0].collect()}


def test_calibration_gives_shares():
    rng = np.random.default_rng(1)
    z = rng.normal(size=20000)
    y = (rng.random(20000) < labelled.logistic(1.5 * z - 1)).astype(float)
    slope, intercept = labelled.calibrate(z, y, [int((y == 0).sum()), int(y.sum())])
    assert abs(slope - 1.5) < 0.1 and abs(intercept + 1) < 0.1
    assert labelled.calibrate(np.ones(3), np.ones(3), [0, 3]) == (1.0, 0.0)


needs_tables = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables are not here")


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{ROOT}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels


def held_out_rows(scores, labels, label, keep):
    return scores.join(labels, "doc_id").where(labelled.held_out()).select(label, keep).collect()


@needs_tables
def test_quality_rules_on_held_out_rows(tables):
    docs, labels = tables
    rows = held_out_rows(quality_rules.judge(docs, quality_rules.fit(docs, labels, bound=600)), labels, "quality", "kept")
    assert sum(r.kept == bool(r.quality) for r in rows) / len(rows) > 0.9
    assert not [r for r in rows if r.kept and not r.quality]


@needs_tables
def test_neighbour_votes_on_held_out_rows(tables):
    docs, labels = tables
    rows = held_out_rows(neighbours.score(docs, neighbours.fit(docs, labels, bound=600)), labels, "quality", "score")
    assert sum((r.score >= neighbours.THRESHOLD) == bool(r.quality) for r in rows) / len(rows) > 0.95


@needs_tables
def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels, bound=600, epochs=3)
    rows = held_out_rows(toxicity.score(docs, model), labels, "toxic", "score")
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in rows) / len(rows) > 0.9
    assert sum(r.score >= 0.5 and r.toxic for r in rows) > 0


def test_neighbours_equal_brute_force():
    rng = np.random.default_rng(3)
    model = neighbours.NeighbourModel(
        np.ones(neighbours.WIDTH, np.float32), rng.normal(size=(neighbours.WIDTH, 8)).astype(np.float32),
        neighbours._unit(rng.normal(size=(40, 8))).astype(np.float32), (rng.random(40) < 0.5).astype(float), 0.5)
    terms = (rng.random((10, neighbours.WIDTH)) < 0.01).astype(np.float32)
    latent = neighbours._unit(model.weighted(terms) @ model.axes)
    for row, got in zip(latent, model.vote(terms), strict=True):
        cosine = model.vectors @ row
        near = np.argsort(-cosine, kind="stable")[: neighbours.NEIGHBOURS]
        weight = np.maximum(cosine[near], 0) ** neighbours.SHARPNESS
        assert got == pytest.approx((weight * model.labels[near]).sum() / weight.sum(), rel=1e-5)


def test_largest_responses_equal_brute_force():
    rng = np.random.default_rng(5)
    slots = rng.integers(0, 30, (50, 1 + len(toxicity.STARTS))).astype(np.int32)
    table = np.zeros((1 << toxicity.BITS, toxicity.WIDTH), np.float32)
    table[:30] = rng.normal(size=(30, toxicity.WIDTH))
    filters = [rng.normal(size=(s, toxicity.WIDTH, toxicity.FILTERS)).astype(np.float32) for s in toxicity.SPANS]
    model = toxicity.ToxicModel(table, filters, [np.zeros(toxicity.FILTERS, np.float32) for _ in filters], np.zeros(0), 1.0, np.zeros(5))
    begin = np.array([0, 0, 1, 3, 50, 50])
    got = model.pooled(slots, begin)
    for r, (a, b) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
        x = table[slots[a:b]].sum(1)
        for g, span in enumerate(toxicity.SPANS):
            best = np.zeros(toxicity.FILTERS)
            for i in range(len(x) - span + 1):
                best = np.maximum(best, sum(x[i + k] @ filters[g][k] for k in range(span)))
            assert np.allclose(got[r, g * toxicity.FILTERS : (g + 1) * toxicity.FILTERS], best, atol=1e-4)


def test_language_of_a_text():
    texts = ["the cat and the dog", "der Hund und die Katze", "le chat et le chien", "el perro y los gatos", "日本", ""]
    _, _, language = next(toxicity.encode(b, o) for _, b, o in chunks(batch_of(texts)))
    assert [toxicity.LANGUAGES[k] for k in language] == ["en", "de", "fr", "es", "other", "other"]


@pytest.mark.parametrize("module", [quality_rules, neighbours, toxicity])
def test_odd_rows_and_few_labels(odd_docs, no_docs, few_labels, module):
    label = "toxic" if module is toxicity else "quality"
    apply = module.judge if module is quality_rules else module.score
    for labels in (few_labels, few_labels.limit(0), few_labels.where(f"{label} = 1")):
        out = apply(odd_docs, module.fit(odd_docs, labels, label=label))
        assert out.count() == odd_docs.count()
        if module is not quality_rules:
            assert all(0 <= r.score <= 1 for r in out.collect())
    assert apply(no_docs, module.fit(no_docs, few_labels, label=label)).count() == 0
