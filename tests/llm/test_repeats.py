"""Passage removal and the Jaccard join against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest

from cohortflow.llm import jaccard, suffixes, text
from cohortflow.session import shared_dir


def brute_repeats(docs, length):
    late = 2**63 - 1
    first = {}
    for d, t in docs:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            k = raw[i : i + length]
            first[k] = min(first.get(k, late), late if d is None else d)
    out = []
    for d, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < (late if d is None else d):
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got_repeats(docs, **options):
    rows = suffixes.remove_repeats(docs, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_odd_documents(odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert got_repeats(odd_docs.repartition(3)) == brute_repeats(docs, 50)


@pytest.mark.parametrize("seed", range(3))
def test_random_passages(spark, seed, monkeypatch):
    rng = random.Random(seed)
    alphabet = ["ab", "abcdefgh ", "aé🙂 "][seed]
    letters = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [letters(rng.randrange(10, 130)) for _ in range(12)]
    docs = []
    for d in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else letters(rng.randrange(60)) for _ in range(rng.randrange(8))]
        docs.append((d * 7 % 61, "".join(parts)))
    rng.shuffle(docs)
    # several blocks, families and segments even for small data
    monkeypatch.setattr(suffixes, "FAMILY_BYTES", 700)
    monkeypatch.setattr(suffixes, "MANY_CONTENTS", [2, 4, 256][seed])
    got = got_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), length=30)
    assert got == brute_repeats(docs, 30)


def test_runs_do_not_depend_on_segments(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    buf, off = rng.integers(97, 100, 5000).astype(np.uint8), np.array([0, 0, 1200, 1230, 5000])
    whole = [np.concatenate(x) for x in zip(*suffixes.suffix_runs(buf, off), strict=True)]
    covered = np.concatenate([np.arange(s, s + n) for s, n in zip(whole[2], whole[3], strict=True)])
    assert sorted(covered.tolist()) == [p for a, b in zip(off[:-1], off[1:], strict=True) for p in range(a, b - 49)]
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    parts = [np.concatenate(x) for x in zip(*suffixes.suffix_runs(buf, off), strict=True)]
    low = {s + k: h for h, s, n in zip(whole[0], whole[2], whole[3], strict=True) for k in range(n)}
    assert low == {s + k: h for h, s, n in zip(parts[0], parts[2], parts[3], strict=True) for k in range(n)}


def test_passage_in_many_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "MANY_CONTENTS", 8)
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(130))
    docs = [(d, f"{rng.random()} {passage}{rng.random()}" + "\0" * (d % 3) * 30) for d in range(80)]
    assert got_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)) == brute_repeats(docs, 50)


def test_kept_text_and_spans(spark):
    passage = "the same fifty bytes and some more of it stand here twice. "
    docs = spark.createDataFrame([(1, f"A {passage}B"), (2, f"C {passage}D")], "doc_id long, text string")
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs, length=50).collect()}
    assert got[1].kept == f"A {passage}B" and got[1].spans == []
    # the space before is common as well
    assert got[2].kept == "CD" and got[2].spans == [1, 2 + len(passage)]


def test_family_finds_earlier_documents_in_any_order():
    import numpy as np

    rng = np.random.default_rng(0)
    batches = [(rng.integers(0, 40, 30).astype(np.uint64), rng.integers(0, 9, 30)) for _ in range(20)]
    family = suffixes.Family()
    for keys, docs in batches:
        family.add(keys, docs)
    least = {}
    for keys, docs in batches:
        for k, d in zip(keys.tolist(), docs.tolist(), strict=True):
            least[k] = min(least.get(k, 99), d)
    for (keys, docs), covered in zip(batches, family.covered, strict=True):
        assert covered.tolist() == [d > least[k] for k, d in zip(keys.tolist(), docs.tolist(), strict=True)]
    assert len(family.levels) <= 6


def shingle_sets(docs, n):
    out = []
    for d, t in docs:
        words = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        out.append((d, frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])))
    return out


def brute_components(docs, percent, n):
    sets = shingle_sets(docs, n)
    late = 2**63 - 1
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j in range(i):
            y = sets[j][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), late), late if d is None else d)
    return sorted(((d, len(x), None if least[root(i)] == late else least[root(i)]) for i, (d, x) in enumerate(sets)), key=repr)


@pytest.mark.parametrize(("percent", "n"), [(90, 3), (80, 5)])
def test_join_of_odd_documents(odd_docs, percent, n):
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in jaccard.near_duplicates(odd_docs, percent, n).collect()), key=repr)
    assert got == brute_components(docs, percent, n)


@pytest.fixture(scope="module")
def edited(spark):
    """Chains of edits, so that many pairs lie close to the threshold, with sizes from 1 to 150 shingles."""
    rng = random.Random(8)
    docs = []
    for group in range(25):
        words = [f"g{group}_{k}" for k in range(rng.choice([1, 4, 9, 14, 25, 60, 150]))]
        for _ in range(rng.choice([2, 5, 30])):
            docs.append((len(docs), " ".join(words)))
            words = list(words)
            for _ in range(rng.randrange(1 + len(words) // 30)):
                words[rng.randrange(len(words))] = f"n{rng.random()}"
    return docs, spark.createDataFrame(docs, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize(("percent", "n"), [(90, 1), (80, 2), (80, 1)])
def test_join_of_edit_chains(edited, percent, n):
    docs, df = edited
    got = sorted((tuple(r) for r in jaccard.near_duplicates(df, percent, n).collect()), key=repr)
    assert got == brute_components(docs, percent, n)


def test_all_links(edited):
    docs, df = edited
    join = jaccard.Join(df, 80, 1)
    ids = {r.sid: r.doc_id for r in join.classes.collect()}
    got = {tuple(sorted((ids[r.a], ids[r.b]))) for r in join.links().collect()}
    first = {}
    for d, x in shingle_sets(docs, 1):
        first.setdefault(x, d)
    classes = [(d, x) for x, d in first.items()]
    want = {tuple(sorted((d, e))) for i, (d, x) in enumerate(classes) for e, y in classes[:i] if 100 * len(x & y) >= 80 * len(x | y)}
    assert got == want


def test_tree_drops_no_pair():
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(60) < 0.03, rng.integers(0, 2**63, 60).astype(np.uint64), base)) for _ in range(100)]
    sets.sort(key=len)
    size = np.array([len(s) for s in sets])
    signs = jaccard.bitmaps(np.concatenate(sets), size)
    tree = jaccard.SignatureTree(size, signs, np.arange(100))
    got = {(min(a, b), max(a, b)) for i, j in tree.pairs(90) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(j, i) for i in range(100) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))}
    assert want <= got and len(want) < 4950


def test_one_of_each_keeps_columns(odd_docs):
    got = jaccard.one_of_each(odd_docs, 80, 5)
    assert got.columns == odd_docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and ids.count(None) == 2 and ids.count(12) == 1 and ids.count(11) == 2


def test_nothing(no_docs):
    assert suffixes.remove_repeats(no_docs).collect() == []
    assert jaccard.near_duplicates(no_docs).collect() == []
    assert jaccard.one_of_each(no_docs).collect() == []


def test_shingle_hashes_tell_orders_apart():
    import numpy as np

    one, _ = text.shingles(np.array([1, 2, 3, 4], np.uint64), np.array([0, 4]), 2)
    two, _ = text.shingles(np.array([2, 1], np.uint64), np.array([0, 2]), 2)
    assert len(set(one.tolist()) | set(two.tolist())) == 4


@pytest.mark.parametrize("percent", [80, 90])
def test_roots_left_out_lose_no_link(percent):
    """Every linked pair still shares a root when each set leaves out its most frequent ones, as many as it can spare."""
    rng = np.random.default_rng(percent)
    linked = left_out = 0
    for _ in range(60):
        pool, sets = rng.integers(0, 2**63, 1500).astype(np.uint64), []
        for _ in range(4):
            base = rng.choice(pool, int(rng.integers(1, 250)), replace=False)
            for _ in range(5):
                kept = base[rng.random(len(base)) >= rng.choice([0, 0.03, 0.08, 0.15])]
                sets.append(np.unique(np.concatenate([kept, rng.choice(pool, int(rng.integers(0, len(base) // 8 + 2)))])))
        sets = [s for s in sets if len(s)]
        size = np.array([len(s) for s in sets])
        keys, row, cut, spare = jaccard.root_keys(np.concatenate(sets), size, jaccard.Ranges(percent, int(size.max())))
        count = Counter(keys.tolist())
        own, kept = {}, [set() for _ in sets]
        for k, r, c, s in zip(keys.tolist(), row.tolist(), cut.tolist(), spare.tolist(), strict=True):
            own.setdefault((r, c), []).append((count[k], k, s))
        for (r, _), roots in own.items():
            shared = sorted((x for x in roots if x[0] > 1), reverse=True)
            kept[r] |= {k for n, (_, k, s) in enumerate(shared) if n >= s}
            left_out += min(shared[0][2], len(shared)) if shared else 0
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= percent * (size[i] + size[j] - both):
                    linked += 1
                    assert kept[i] & kept[j]
    assert linked > 100 and left_out > 1000


def test_levels_merge_a_column_at_a_time():
    """Two levels become one sorted level without a second copy of all of it."""
    rng = np.random.default_rng(6)
    n = 1 << 16
    keys = rng.integers(97, 123, (2 * n, 50)).astype(np.uint8).view("S50").ravel()
    family = suffixes.Family()
    for a, b in ((0, n + n // 2), (n + n // 2, 2 * n)):
        family.add(keys[a:b], np.arange(a, b))
    assert len(family.levels) == 2
    size = sum(x.nbytes for level in family.levels for x in level)
    tracemalloc.start()
    try:
        copies = [tuple(x.copy() for x in level) for level in family.levels]
        family.levels = copies
        del copies
        there = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        family._merge()
        got, docs, batch, place = family.levels[0]
        extra = tracemalloc.get_traced_memory()[1] - there
    finally:
        tracemalloc.stop()
    assert extra < size and (got == np.sort(keys)).all()
    assert (keys[docs] == got).all() and (np.array([0, n + n // 2])[batch] + place == docs).all()


def test_hashes_of_single_suffixes():
    buf = np.random.default_rng(7).integers(97, 100, 3 * suffixes.SEGMENT + 77).astype(np.uint8)
    at = np.append(np.arange(0, len(buf) - 50, 991)[::-1], [suffixes.SEGMENT - 1, suffixes.SEGMENT, len(buf) - 50])
    got = suffixes._hashes_at(buf, at, 50)
    assert (got == text.span_hash(text.prefix_hash(buf), at, at + 50)).all()
    assert len(suffixes._hashes_at(buf, at[:0], 50)) == 0


def test_tables_in_between_go(spark):
    """Once a result is there, the shared folder holds only what it is read from."""
    own = "how much wood would a chuck chuck if it could chuck all of the wood there is"
    df = spark.createDataFrame([(1, own), (2, own), (3, own + " " + own), (4, "else")], "doc_id long, text string")
    folder = Path(urlparse(shared_dir(spark)).path).parent
    there = set(folder.iterdir())
    kept = jaccard.one_of_each(df, 80, 5)
    assert len(set(folder.iterdir()) - there) == 2
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    there = set(folder.iterdir())
    cut = suffixes.remove_repeats(df)
    assert len(set(folder.iterdir()) - there) == 2
    assert {r.doc_id: r.n_removed for r in cut.collect()} == {d: n for d, _, n, *_ in brute_repeats([tuple(r) for r in df.collect()], 50)}


def test_open_runs_are_not_written_beside_the_shuffle(spark, monkeypatch):
    """Their bytes are the largest table in between: once in the shuffle is enough."""
    written = []

    def settle(df, *path):
        written.append(set(df.columns))
        return kept(df, *path)

    kept = suffixes.settle
    monkeypatch.setattr(suffixes, "settle", settle)
    shared = "a passage that all of them have, and that is long enough to be found again "
    docs = [(n, f"{n} own words of {n} " + shared + f" end of {n}") for n in range(6)]
    got = got_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == brute_repeats(docs, 50)
    assert written and not any("first" in columns for columns in written)


@pytest.mark.parametrize("values", [[], [5], [5, 260], [0, 2**63 - 1], [-(2**63), 2**63 - 1, -1], [7, 7 + 2**32]])
def test_numbers_in_few_bytes(values):
    values = np.array(values, np.int64)
    base, above = suffixes.narrow(values)
    assert suffixes.widen(base, np.frombuffer(above.tobytes(), np.uint8), len(values)).tolist() == values.tolist()
    assert above.itemsize == 8 or not len(values) or int(values.max()) - int(values.min()) < 256**above.itemsize
