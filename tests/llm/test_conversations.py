"""Conversation trie, structure repair and license scan against plain Python."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import defaultdict

import pytest

from checks.compare import compare, duck
from cohortflow.llm import ORACLES, QUERIES, licences, repair, trie

ROOT = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, block int, fp1 string, pos string, length double, `there` boolean"
WORD = re.compile("[^\x20\x09-\x0d]+")
BLANK = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 0.5, None) for r in rows], SCHEMA)


def some_rows(seed=1):
    """Nulls, ties, repeated rows, shared beginnings, negative ids, texts of every fault, and conversations beyond a block."""
    rng = random.Random(seed)
    texts = ["", " ", "a b.", "a b", "No?", "É x\n y!", None, "the same.", "long " * 300]
    rows = []
    for c in [*range(0, 70), -5, -20, 400, 407, 2**40]:
        n = rng.choice([1, 1, 2, 3, 5, 9, 30] if c % 9 else [40])
        for t in range(n):
            rows.append((c, rng.choice([t, t, t, t + 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "", None, "tool"]), rng.choice(texts)))
    rows += [r for r in rows if r[0] == 3] * 2
    shared = [(t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(25)]
    for c in range(100, 130):
        rows += [(c, *s) for s in shared[: rng.choice([17, 25, 25, 8])]]
    return rows


def expected_trie(rows, step=20, most=4):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))

    def name(r, x):
        digest = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()[:32]
        return f"{digest}:{len(WORD.findall(x))}"

    seq = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda z: (*z[:2], z[2].encode(), name(*z[2:])))] for c, v in conv.items()}
    made = {}
    for c in seq:
        h = zlib.crc32(str(c).encode()) % most
        made[c] = seq.get(c - int(math.fmod(c, step)), [])[:h] + seq[c][h:]
    member, kids = defaultdict(list), defaultdict(list)
    for c, s in sorted(made.items()):
        for d in range(len(s) + 1):
            member[tuple(s[:d])].append(c)
    for p in member:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(member, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(member[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0)
        ends = ",".join(str(c) for c in member[p] if len(made[c]) == len(p))
        above = member[p[:-1]][0] if p else None
        out.append((member[p][0], len(p), above, len(member[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found_trie(df):
    return sorted(tuple(r)[:8] for r in trie.trie(*trie.rebased(trie.turns(df))).collect())


def test_trie_equals_brute_force(spark, monkeypatch):
    rows = some_rows()
    rows.append((None, 0, "user", "nobody's"))
    assert found_trie(frame(spark, rows)) == expected_trie(rows)
    # blocks of one conversation in several stretches, members of one node in several pieces
    monkeypatch.setattr(trie, "STRETCH", 2)
    monkeypatch.setattr(trie, "PIECE", 3)
    assert found_trie(frame(spark, rows).repartition(7)) == expected_trie(rows)


def test_trie_of_one_very_common_conversation(spark):
    rows = [(c, t, "user", f"{t} words here") for c in range(0, 3000) for t in range(3)]
    got = found_trie(frame(spark, rows))
    assert got == expected_trie(rows)
    assert len(got) == 4 and got[-1][3] == 3000


def test_turns_of_a_conversation_over_many_ranges(spark):
    rows = [(1, t, "user", "x" * (t % 7)) for t in range(5000)] + [(2, None, "user", "y")] * 40
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = trie.turns(frame(spark, rows).repartition(16)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.pos for r in got if r.conv_id == 1) == list(range(1, 5001))
    assert sorted(r.pos for r in got if r.conv_id == 2) == list(range(1, 41))
    assert all(r.turn_id.endswith(":1" if (r.pos - 1) % 7 else ":0") for r in got if r.conv_id == 1)


def test_trie_of_nothing(spark):
    assert found_trie(frame(spark, [])) == []
    assert found_trie(frame(spark, [(None, 1, "user", "x")])) == []
    # all turns replaced by those of a conversation that is not there
    alone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 4 == 1 and c % 20)
    assert found_trie(frame(spark, [(alone, 0, "user", "x")])) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_trie_as_it_stands(spark):
    rows = [(1, 0, "user", "a b"), (1, 1, "assistant", "c"), (2, 0, "user", "a b"), (2, 1, "assistant", "d")]
    got = {(r.conv_id, r.depth): (r.n_convs, r.n_children, r.saved_tokens) for r in trie.conversation_trie(frame(spark, rows)).collect()}
    assert got == {(1, 0): (2, 1, 2), (1, 1): (2, 2, 2), (1, 2): (1, 0, 0), (2, 2): (1, 0, 0)}


def damaged(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        conv[c]
        space = lambda v: " " if v is None else v
        r, x, kind = space(r), space(x), zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        if kind:
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            conv[c] += [(t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    for c in conv:
        conv[c].sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), z[2].encode()))
    return conv


def faults_of(rows):
    seen, out = set(), []
    for _, r, x in rows:
        bare = x.strip(BLANK)
        out.append("blank" if not bare else "duplicate" if (r, x) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((r, x))
    return out


def all_scripts(rows, faults, limit):
    """Every script of edits with at most ``limit`` inserts that gives a legal conversation, with its cost."""
    names = {"u": "user", "a": "assistant"}
    best = None
    for n in range(limit + 1):
        for where in itertools.combinations_with_replacement(range(len(rows) + 1), n):
            options = []
            for k in range(len(rows) + 1):
                options += [[("I", 5, "u", ""), ("I", 5, "a", "")]] * where.count(k)
                if k < len(rows):
                    _, r, x = rows[k]
                    more = 5 if faults[k] == "truncated" else 0
                    stay = [] if faults[k] in ("blank", "duplicate") else [("K", more, r, x), *(("R", 1 + more, i, x) for i in names)]
                    options.append([("D", 2, None, None), *stay])
            for script in itertools.product(*options):
                kept = [s for s in script if s[2] is not None]
                if re.fullmatch("(s?(ua)+)?", "".join(s[2][:1] or "-" for s in kept)):
                    lines = [f"{names.get(s[2], s[2]) if s[0] in 'IR' else s[2]}:{s[3]}" for s in kept]
                    found = (sum(s[1] for s in script), "".join(s[0] for s in script), "\n".join(lines))
                    best = min(best or found, found)
    return best


def by_tables(rows, faults, costs=(1, 2, 5, 5)):
    """Plain tables of the best (cost, audit, lines) per state."""
    rerole, delete, insert, cut = costs
    table = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def put(best, state, found):
        if state not in best or found[:2] < best[state][:2]:
            best[state] = found

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit, lines) in list(best.items()):
                for i, to in table[state].items():
                    if i in names:
                        put(best, to, (cost + insert, audit + "I", (*lines, f"{names[i]}:")))
        return best

    best = inserted({"": (0, "", ())})
    for (_, r, x), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, audit, lines) in best.items():
            put(new, state, (cost + delete, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = cut if fault == "truncated" else 0
                if r[:1] and r[:1] in table[state]:
                    put(new, table[state][r[:1]], (cost + more, audit + "K", (*lines, f"{r}:{x}")))
                for i, to in table[state].items():
                    if i in names:
                        put(new, to, (cost + more + rerole, audit + "R", (*lines, f"{names[i]}:{x}")))
        best = inserted(new)
    cost, audit, lines = min((best[s] for s in ("", "a") if s in best), key=lambda v: v[:2])
    return cost, audit, "\n".join(lines)


def expected_repair(rows):
    out = []
    for c, rs in damaged(rows).items():
        turns, faults = [t for t, _, _ in rs if t is not None], faults_of(rs)
        cost, audit, text = by_tables(rs, faults)
        out.append((
            c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rs)), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_tables(spark, seed):
    rows = some_rows(seed) + [(None, 0, "user", "a."), (None, None, None, None)] + [(9000 + n, 0, "user", "x.") for n in range(60)]
    df = frame(spark, rows).repartition(5)
    got = sorted((tuple(r) for r in repair.digests(repair.damage(df)).collect()), key=repr)
    assert got == expected_repair(rows)
    assert any(g[7] == "" for g in got)  # a conversation whose only row was dropped
    assert repair.digests(repair.damage(frame(spark, []))).collect() == []


def test_edits_hold_the_repaired_turns(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Again?"), (1, 2, "assistant", "cut"), (1, 3, "assistant", "Well."), (2, 5, "assistant", " ")]
    got = repair.edits(frame(spark, rows)).orderBy("conv_id", "step").collect()
    assert [(r.conv_id, r.edit, r.role, r.text, r.fault) for r in got] == [
        (1, "D", None, None, ""), (1, "K", "user", "Again?", ""), (1, "D", None, None, "truncated"), (1, "K", "assistant", "Well.", ""),
        (2, "D", None, None, "blank"),
    ]


def search(rows, faults, costs, every=1):
    s, out = repair.Search(costs), []
    for k, ((_, r, x), f) in enumerate(zip(rows, faults, strict=True)):
        s.add((r, x, f))
        if k % every == 0:
            out += s.settled()
    out += s.finish()
    lines = "\n".join(f"{role}:{'' if row is None else row[1]}" for _, _, row, role in out if role is not None)
    return sum(e[1] for e in out), "".join(e[0] for e in out), lines


def test_search_equals_all_scripts():
    rng = random.Random(4)
    for _ in range(150):
        rows = [(None, rng.choice(["user", "assistant", "system", "tool", ""]), f"t{n}.") for n in range(rng.randint(0, 4))]
        faults = [rng.choice(["", "", "truncated", "blank"]) for _ in rows]
        assert search(rows, faults, repair.Costs()) == all_scripts(rows, faults, 2) == by_tables(rows, faults)


@pytest.mark.parametrize("costs", [(1, 2, 5, 5), (1, 1, 1, 1), (2, 3, 1, 0), (0, 2, 1, 4), (3, 9, 1, 2)])
def test_search_equals_tables_for_any_costs(costs):
    rng = random.Random(sum(costs))
    for n in range(120):
        rows = [(None, rng.choice(["user", "assistant", "system", "tool"] if n % 2 else ["user", "assistant"]), f"t{k}") for k in range(rng.randint(0, 40))]
        faults = [rng.choice(["", "", "", "truncated", "duplicate"]) for _ in rows]
        assert search(rows, faults, repair.Costs(*costs), every=rng.choice([1, 3, 50])) == by_tables(rows, faults, costs)


def test_undecided_edits_stay_few():
    rng, s, most, edits = random.Random(8), repair.Search(repair.Costs()), 0, 0
    for k in range(20_000):
        s.add((rng.choice(["user", "assistant", "system"]), f"t{k}.", rng.choice(["", "", "truncated", "blank"])))
        edits += len(s.settled())
        most = max(most, max(e.length for _, e in s.alive.values()) - s.root.length)
    assert edits > 19_000 and most < 500


def test_costs_are_checked():
    with pytest.raises(ValueError, match="cost"):
        repair.Costs(insert=0)


def expected_licences(text, notices=licences.NOTICES, threshold=0.8):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda s: s.translate({k: k + 32 for k in range(65, 91)})
    templates = [(label, set(word.findall(low(t)))) for label, t in notices]
    text = low(text or "")
    w, places, base, blocks, part = word.findall(text), [], set(), [], []
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    for line in [*text.split("\n"), ""]:
        found = word.findall(line)
        if found:
            blocks.append(set(found))
            part.append(found)
        else:
            if len(part) > 1:
                blocks.append(set(sum(part, [])))
            part = []
    labels, score = set(base), 1.0 if places else 0.0
    for b in blocks:
        hits = [((len(b & s) / len(s), len(b & s)), label) for label, s in templates if len(b & s) >= math.ceil(threshold * len(s) - 1e-9)]
        if hits:
            top = max(hits)[0]
            labels |= {label for strength, label in hits if strength == top}
            score = max(score, top[0])
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def licence_texts():
    rng = random.Random(5)
    texts = [None, "", "\n \n", "MIT\nLicense", "mit-license MIT_LICENSE mit1 license", "ÉMIT License. apache  license; general public license general public license"]
    texts += [t for _, t in licences.NOTICES] + [t.upper() for _, t in licences.NOTICES]
    for _, t in licences.NOTICES:
        w = t.split()
        texts.append(" ".join(x for x in w if rng.random() > 0.15))
        texts.append("Some text before.\n\n" + "\n".join(" ".join(w[i : i + 5]) for i in range(0, len(w), 5)) + "\n--\nand after it")
        texts.append("\n".join(rng.sample(w, len(w))) + " the of and")
    texts += ["the of and to in a this is or " * 3000, "Licensed under CC BY-NC-ND 4.0.\nLicensed under CC BY 4.0."]
    return texts


def test_licence_scan_equals_brute_force(spark):
    texts = licence_texts()
    rows = [(k % 20 if k % 7 else None, t, "x", 1, 2.0) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `row` string, blocks int, score double").repartition(3)
    got = sorted((tuple(r) for r in licences.scan(df).collect()), key=repr)
    assert got == sorted(((r[0], *expected_licences(r[1])) for r in rows), key=repr)
    assert {"mit", "gpl", "bsd", "cc-by-nc", "lgpl", "isc"} <= {x for g in got for x in g[6].split(",")}
    assert licences.scan(df.limit(0)).collect() == []


def test_licence_matches_are_complete(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(14)]
    notices = [(f"l{k}", " ".join(rng.sample(vocabulary, rng.randint(1, 9)))) for k in range(12)]
    docs = [(n, "\n".join(" ".join(rng.choices(vocabulary, k=rng.randint(0, 14))) for _ in range(4))) for n in range(60)]
    templates = licences.Templates.of(notices, 0.7, {})
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.first_line, r.last_line, r.template): r.overlap for r in licences.matches(df, templates).collect()}
    want = {}
    for d, text in docs:
        lines = [line.split() for line in text.split("\n")]
        blocks = [(k, k, set(x)) for k, x in enumerate(lines) if x]
        for worded, run in itertools.groupby(enumerate(lines), lambda p: bool(p[1])):
            run = list(run)
            if worded and len(run) > 1:
                blocks.append((run[0][0], run[-1][0], {w for _, x in run for w in x}))
        for a, b, s in blocks:
            for k, (_, t) in enumerate(notices):
                shared = len(s & set(t.split()))
                if shared >= max(1, math.ceil(0.7 * len(set(t.split())) - 1e-9)):
                    want[d, a, b, k] = shared
    assert got == want and len(want) > 100


def test_templates_are_checked():
    with pytest.raises(ValueError, match="words"):
        licences.Templates.of([("x", "...")])
    with pytest.raises(ValueError, match="threshold"):
        licences.Templates.of(threshold=0)


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables are not here")
@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_structure_repair", "op13_license_scan"])
def test_same_rows_as_sql(spark, name):
    ok, text = compare(spark, duck(ROOT), ROOT, name, QUERIES[name], ORACLES[name])
    assert ok, text
