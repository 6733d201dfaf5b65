"""Token ids, packing and token files against the tokenizers library."""

import os
import random
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortflow.llm import packing, token_files
from cohortflow.llm.text import chunks
from cohortflow.llm.tokens import WordEncoder, read_spec
from cohortflow.session import shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def wanted(tokenizer, docs):
    return [(r.doc_id, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.select("doc_id", "text").collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("kept", [50, 100_000])
def test_ids_of_odd_strings(tokenizer, kept):
    rng = random.Random(5)
    signs = list("abcXYZ019'’.,;:!?<>|$%&*#()-_=+\t\n\x0b\x0c\r  \x1c\x1f\x00\x7f\x85\xa0\xad éÉüßİıſΣςσеЖ中文字🙂‍️ﬁ½²ªº×÷Ωŉǅ ̀")
    signs += ["<|startoftext|>", "<|endoftext|>", "<|EndOfText|>", "'s", "'re", "'LL", " ", "　"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["", None, "it's", "İ", "<|startoftext|>a<|endoftext|>"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    encoder, got = WordEncoder(read_spec(PATH), kept=kept), []
    for part, buf, off in chunks(batch, size=4096):
        ids, at = encoder.encode(buf, off)
        got += [ids[at[k] : at[k + 1]].tolist() for k in range(len(part))]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing_holds_every_id_once(tokenizer, odd_docs):
    docs = wanted(tokenizer, odd_docs)
    pieces = packing.pack(odd_docs.repartition(3), PATH, length=512, open_windows=3, fan_in=2).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    total = sum(len(ids) for _, ids in docs)
    assert sum(p.length for p in pieces) == total
    for doc, ids in docs:
        if sum(d == doc for d, _ in docs) > 1:
            continue  # pieces of documents that share an id can't be told apart here
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert (p.start, p.ids_crc32, p.doc_tokens) == (at, crc(ids[at : at + p.length]), len(ids))
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 512
    assert len(by_sequence) <= total / 512 * 1.05 + 2


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs, PATH).collect() == []


def test_many_partitions_merge_to_one(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text")).repartition(40, "doc_id")
    pieces = packing.pack(docs, PATH, length=64, open_windows=2, fan_in=3)
    assert pieces.agg(F.sum("length")).first()[0] == 400 * 4
    assert pieces.select("sequence_id").distinct().count() == 25


def test_files_hold_the_stream(spark, tokenizer, odd_docs):
    path = token_files.write_tokens(odd_docs, PATH, shared_dir(spark), partitions=4, page_rows=2)
    got = token_files.checksums(spark, path).collect()
    start, seen = 0, sorted(got, key=lambda r: r.start)
    for r in seen:
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in seen] == sorted((r.doc_id for r in seen), key=lambda d: (d is not None, d))
    key = lambda r: (r[0] is not None, *r)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(((d, len(i), crc(i)) for d, i in wanted(tokenizer, odd_docs)), key=key)


def test_selective_reads(spark, tokenizer, odd_docs):
    path = token_files.write_tokens(odd_docs, PATH, shared_dir(spark), partitions=2)
    ids = dict(wanted(tokenizer, odd_docs))
    assert {r.doc_id: r.tokens for r in token_files.read_tokens(spark, path, doc_ids=[3, 9]).collect()} == {d: ids[d] for d in (3, 9)}
    assert sorted(r.doc_id for r in token_files.read_tokens(spark, path, between=(13, 14)).collect()) == [13, 14]
    plan = token_files.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan
    filtered = token_files.read_tokens(spark, path, doc_ids=[3])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in filtered and "doc_id,3" in filtered.replace(" ", "")


def test_files_of_nothing(spark, no_docs):
    assert token_files.checksums(spark, token_files.write_tokens(no_docs, PATH, shared_dir(spark))).collect() == []


def test_batches_are_bounded_in_bytes(spark):
    """Long rows do not meet in one batch; tables of hashes are as long as they must be."""
    from cohortflow.llm import text

    docs = spark.range(0, 100, 1, 1).selectExpr("id AS doc_id", "repeat('x', 200000) AS text")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    sizes = [r[0] for r in text.rows_with(docs, "doc_id", "text").mapInArrow(run, "n long").collect()]
    assert sum(sizes) == 100 and max(sizes) * 200000 <= text.BATCH_BYTES + 200000
    code = "from cohortflow.llm import text; import numpy as np; text.prefix_hash(np.zeros(5000, np.uint8)); print(len(text._powers[0]))"
    assert int(subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120).stdout) < 20000


def test_tables_do_not_travel():
    """What the driver has hashed does not make the functions it sends longer."""
    code = (
        "import numpy as np, cohortflow; from pyspark import cloudpickle; from cohortflow.llm import jaccard, text; "
        "cloudpickle.register_pickle_by_value(cohortflow); f = lambda b: jaccard.sets_of(b, b, 5); text.prefix_hash(np.zeros(1 << 20, np.uint8)); "
        "raw = cloudpickle.dumps(f); own = cloudpickle.loads(raw); print(len(raw))"
    )
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert int(done.stdout) < 1 << 20, done.stderr


def test_payloads_travel_a_few_at_a_time():
    from cohortflow.llm import suffixes, text

    rows = [(k % 7, k, k, bytes(k * 1000)) for k in range(1200)]
    batches = list(suffixes._dealt(list(rows)))
    assert sorted(tuple(r.values()) for b in batches for r in b.to_pylist()) == sorted(rows)
    assert all(b.num_rows == 1 or sum(map(len, b.column(3).to_pylist())) <= text.SMALL_BATCH for b in batches)


def test_hash_tables_stay_short():
    """Hashes of spans anywhere in a long buffer are those of the spans alone, with tables much shorter than the buffer."""
    code = (
        "import numpy as np; from cohortflow.llm import text; rng = np.random.default_rng(4); buf = rng.integers(0, 256, 1 << 21).astype(np.uint8); "
        "start = np.append(rng.integers(0, len(buf) - 9000, 300), [0, 8191, 8192, 16383, len(buf) - 9000]); end = start + rng.integers(0, 9000, len(start)); "
        "got = text.span_hash(text.prefix_hash(buf), start, end); "
        "own = [text.span_hash(text.prefix_hash(buf[a:b]), np.array([0]), np.array([b - a]))[0] for a, b in zip(start, end)]; "
        "print(got.tolist() == own and len(set(own)) > 300, sum(x.nbytes for x in text._powers))"
    )
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    same, size = done.stdout.split()
    assert same == "True" and int(size) < 1 << 19, done.stderr
