"""Top-k search, page extraction, piece sampling, the pipeline and the registration."""

import itertools
import json
import os
import subprocess
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cohortflow.llm import pieces, style_tree, topk
from cohortflow.llm.labelled import held_out, training_rows
from cohortflow.llm.text import flat

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("blocks", [(7, 3), (1000, 1000)])
def test_top_k_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(2)
    vectors = [[float(v) for v in rng.choice([-1.0, -0.3, 0.0, 0.2, 0.9], 6)] for _ in range(60)]
    rows = [(n, v) for n, v in enumerate(vectors)] + [(60, vectors[0]), (61, vectors[0]), (62, None), (63, [1.0, None]), (64, [float("nan")] * 6), (65, [float("inf")])]
    rows += [(66, [0.5]), (67, []), (None, vectors[1]), (10, vectors[3])]
    df = spark.createDataFrame([(n, v, 1, 2) for n, v in rows], "vec_id long, embedding array<float>, rb int, v int")
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, k=4, row_block=blocks[0], query_block=blocks[1]).collect()
    use = [(n, [int(np.floor(256 * np.float32(c).astype(float))) for c in v]) for n, v in rows if n is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for q, x in use:
        if q % 5 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), n) for n, y in use if n != q)[:4]
            want += [(q, k + 1, n, -s) for k, (s, n) in enumerate(scores)]
    # an id that two rows share is asked twice, and its answers are ranked together
    single = {q for q, c in Counter(n for n, _ in use).items() if c == 1}
    assert sorted(tuple(r) for r in got if r.query_id in single) == sorted(w for w in want if w[0] in single)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 2 == 0).collect() == []


def test_index_never_loses_a_member():
    rng = np.random.default_rng(7)
    for n, dims in ((5, 3), (300, 8), (300, 1)):
        x = rng.integers(-200, 200, (n, dims))
        index = topk.ImpactIndex(x)
        for q in (*x[:5], np.zeros(dims, int)):
            possible = index.search(q, np.array([0]), 3)
            scores = x @ q
            bar = np.sort(np.delete(scores, 0))[::-1][min(2, n - 2)]
            assert set(np.flatnonzero(scores > bar)) - {0} <= set(possible) and 0 not in possible


PAGE = """<!DOCTYPE html><HTML><head><title>T</title><style>p{}</style><script>var t="</p><article>no";</script></head><body>
<header>Site</header><nav><ul><li><a>x</a></ul></nav><!-- <p>old</p> --><div class="ad-box">buy</div><div id="cookieNotice">cookies</div>
<article><header><h1>Big &amp; title</h1><span>by me</span></header><p><b>First &eacute;&#32; line<br><p title="a > b">Two
 lines&nbsp;<i>here</i></p><aside>side</aside><form>f</form><ul><li>one<li>two</ul><pre>3 &lt; 4</pre>
<section class="comments"><article>reader says</article></section><div hidden>h</div><table><tr><td>c1<td>c2</table></article><footer>f</footer>"""


def test_blocks_of_a_page():
    want = ["Big & title", "First é line", "Two lines here", "one", "two", "3 < 4", "c1", "c2"]
    assert style_tree.blocks(style_tree.parse(PAGE)) == want


def test_wrappers_named_after_their_surroundings():
    source = """<body class="has-cookie-notice"><div class="page with-sidebar"><main class="search-results"><p>Text</p><div class="share">s</div></main>
    <div class="sidebar">side</div></div><section id="comments"><article class="comment"><p>reader</p></article></section>
    <div class="related"><article>other page</article></div></body>"""
    assert style_tree.blocks(style_tree.parse(source)) == ["Text"]


@pytest.mark.parametrize("source", ["", "plain & text", "<p", "</div></p>", "<p><p><p>", "<<>>", "a<b", "<a title='x>y</a>z", "<script>never closed", "<!-- open", "<" * 3000, "<div>" * 2000 + "deep"])
def test_broken_pages(source):
    root = style_tree.parse(source)
    style_tree.elements(root)
    assert isinstance(style_tree.blocks(root), list)


def test_repeated_branches_of_a_site_go(spark):
    """Nothing is marked here: only the tree can tell what all pages of the site share."""
    def page(n, site):
        return f"<html><body><div><span>{site} home, best deals</span></div><div><p>Text {n} of its own.</p><p>More {n * 7}.</p></div><div>Call {site} now</div></body></html>"

    rows = [(n, f"https://{site}.example/{n}", page(n, site)) for n, site in enumerate(["one"] * 12 + ["two"] * 12)]
    rows += [(100, "https://three.example/", page(100, "three")), (101, None, None), (102, "x", ""), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, low int")
    got = style_tree.extract(df).collect()
    assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows) and all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    assert all(texts[n] == f"Text {n} of its own.\nMore {n * 7}." for n in range(24))
    assert texts[100].startswith("three home") and texts[101] == texts[102] == ""


def test_what_varies_below_a_constant_label_stays(spark):
    def page(n):
        return f"<body><div>You are here: <p>Article {n} of its own.</p></div><p>Note: <b>sentence {n * 3}</b></p><div>Call us <i>today</i></div></body>"

    rows = [(n, f"http://h/{n}", page(n)) for n in range(30)]
    got = style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == {n: f"Article {n} of its own.\nsentence {n * 3}" for n in range(30)}


def test_copies_of_an_unmarked_page_stay(spark):
    """Under other ids, urls and spellings they count once; what the site's other pages share goes from every copy."""
    def page(n, more=""):
        ps = "".join(f"<p>Part {k} of text {n}.</p>" for k in range(2 if n else 3))
        return f"<body{more}><div>Site home</div><div>{ps}</div></body>"

    rows = [(n, f"http://h/{n}", page(0, f" data-n='{n}'")) for n in range(30)] + [(n, f"http://h/{n}", page(n)) for n in range(30, 40)]
    got = style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    texts = {r.page_id: r.text for r in got.collect()}
    assert {texts[n] for n in range(30)} == {"Part 0 of text 0.\nPart 1 of text 0.\nPart 2 of text 0."}
    assert all(texts[n] == f"Part 0 of text {n}.\nPart 1 of text {n}." for n in range(30, 40))


@pytest.mark.parametrize("name", ["page with-sidebar", "content-bottom", "has-cookie-notice"])
def test_marked_wrappers_of_the_main_text_stay(name):
    source = f"<body><div class='{name}'><div><p>All that the page has to say.</p></div><div class='sidebar'>side</div></div><div class='menu'>x</div></body>"
    assert style_tree.blocks(style_tree.parse(source)) == ["All that the page has to say."]


def test_teaser_cards_are_not_the_article():
    text = "A long text of its own. " * 9
    source = f"<body><div><p>{text}</p></div><article>Read also</article></body>"
    assert style_tree.blocks(style_tree.parse(source))[0] == text.strip()


def test_the_tree_decides_within_and_without_marks(spark):
    def page(n, tag, name=""):
        return f"<body><div>Site home</div><{tag}{name}><p>Text {n} of its own, more or less.</p><p>Join our club</p></{tag}></body>"

    kinds = [("main", ""), ("article", ""), ("div", " role='main'"), ("div", ""), ("div", " class='content-bottom'")]
    rows = [(20 * k + n, f"http://{k}.h/{n}", page(n, *kind)) for k, kind in enumerate(kinds) for n in range(20)]
    got = style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == {20 * k + n: f"Text {n} of its own, more or less." for k in range(len(kinds)) for n in range(20)}


def test_copies_of_an_article_stay(spark):
    rows = [(n, "http://h/x", f"<body><article><p>Same for all.</p></article><div>menu {n}</div></body>") for n in range(30)]
    got = style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.text for r in got.collect()} == {"Same for all."}
    assert style_tree.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_importance_follows_pages(spark):
    """Elements: 1 the same on all pages, 2 different on all, 3 half and half in style."""
    rows = [(p, 0, 1, 5, 9, True) for p in range(8)] + [(p, 1, 2, 5, 100 + p, True) for p in range(8)] + [(p, 2, 3, p % 2 + 1, 0, True) for p in range(8)]
    got = {r.element: r for r in style_tree.importance(spark.createDataFrame(rows, style_tree.ELEMENT_ROWS)).collect()}
    assert got[1].importance == pytest.approx(0.0) and got[2].importance == pytest.approx(0.9)
    assert got[3].importance == 1.0 and got[3].pages == 8


MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(pieces.read_vocabulary(MODEL))


def all_segmentations(v, text):
    """Every path with its log-probability."""
    by_bytes = {raw: i for i, raw in enumerate(v.bytes) if raw and i not in set(v.byte_ids.tolist())}
    chars, out = [c.encode() for c in " " + text], []

    def go(k, ids, weight):
        if k == len(chars):
            out.append((tuple(ids), weight))
        for j in range(k + 1, len(chars) + 1):
            i = by_bytes.get(b"".join(chars[k:j]))
            if i is not None:
                go(j, [*ids, i], weight + v.weight[i])
        if k < len(chars) and chars[k] not in by_bytes:
            go(k + 1, [*ids, *(int(v.byte_ids[b]) for b in chars[k])], weight + v.byte_weight * len(chars[k]))

    go(0, [], 0.0)
    weights = np.array([w for _, w in out])
    return {ids: float(w - np.logaddexp.reduce(weights)) for ids, w in out}


@pytest.mark.parametrize("text", ["abc", "a cat", "é x\n", "\U0001f9ffa", "  b"])
def test_samples_follow_the_distribution(vocabulary, text):
    paths, n, k = all_segmentations(vocabulary, text), 3000, 3
    buf, off = flat(pa.array([text] * n))
    sampler = pieces.Sampler(vocabulary, buf, off, np.arange(n))
    found, weighted = {}, 0.0
    for r, s, edges, log_p, value, inclusion in sampler.run(k):
        ids = tuple(sampler.ids(edges).tolist())
        assert log_p == pytest.approx(paths[ids])
        assert sentencepiece.SentencePieceProcessor(model_file=MODEL).decode(list(ids)) == text if r == 0 else True
        found.setdefault(r, []).append((s, ids, value))
        weighted += np.exp(log_p) / inclusion / n
    assert weighted == pytest.approx(1.0, abs=0.05)
    first, second = Counter(), Counter()
    for own in found.values():
        own.sort()
        assert len({ids for _, ids, _ in own}) == len(own) == min(k, len(paths))
        assert all(a[2] >= b[2] for a, b in itertools.pairwise(own))
        first[own[0][1]] += 1
        if len(own) > 1:
            second[own[0][1], own[1][1]] += 1
    for ids, log_p in paths.items():
        p = np.exp(log_p)
        assert abs(first[ids] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-9
        for other, q in paths.items():
            pair = p * np.exp(q) / (1 - p) if other != ids and p < 1 else 0.0
            assert abs(second[ids, other] / n - pair) < 5 * np.sqrt(pair / n) + 1e-9


def test_noise_is_drawn_where_sets_can_still_be_opened(vocabulary, monkeypatch):
    """Of long texts most edges lie too deep; a step over all texts draws at once."""
    texts = [" ".join(f"word{i}" * (1 + i % 3) for i in range(k, k + 300)) for k in range(40)]
    buf, off = flat(pa.array(texts))
    drawn, plain = [], pieces._uniform
    monkeypatch.setattr(pieces, "_uniform", lambda key: drawn.append(len(key)) or plain(key))
    found = list(pieces.Sampler(vocabulary, buf, off, np.arange(len(texts))).run(4))
    assert len(found) == 4 * len(texts)
    edges = sum(len(x[2]) for x in found)
    assert sum(drawn) < 1.3 * edges and len(drawn) < 150


def test_sampling_of_odd_documents(odd_docs, no_docs):
    rows = pieces.sample(odd_docs, MODEL, samples=2, with_ids=True).collect()
    texts = Counter((r.doc_id, r.sample) for r in rows)
    assert texts[1, 0] == texts[1, 1] == 1 and texts[4, 0] == texts[5, 0] == 1 and texts[4, 1] == 0
    assert all(r.decodes and 0 < r.inclusion <= 1 for r in rows)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    source = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert all(model.decode(list(r.ids)) == source[r.doc_id] for r in rows if r.doc_id in (1, 3, 10, 14))
    again = pieces.sample(odd_docs.repartition(5), MODEL, samples=2).collect()
    key = lambda r: (str(r.doc_id), r.sample, r.ids_crc32)
    assert sorted(map(key, again)) == sorted(map(key, rows))
    assert pieces.sample(no_docs, MODEL).collect() == []


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = np.random.default_rng(0)
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 3000, 120))
    shared, copy = text(), text()
    docs = [(0, copy), (1, copy + " end"), (2, text() + " " + shared), (3, shared + " " + text()), (4, "too short"), (5, None), (6, "spam " * 200)]
    docs += [(n, text()) for n in range(7, 40)]
    labels = spark.createDataFrame([(n, 1, 0) for n, _ in docs], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.createDataFrame([(n, t, "en", "s", len(t or "")) for n, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = frame, []
    for name, stage in cp.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == frame.columns
        seen.append({r.doc_id: r.text for r in now.collect()})
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "packing"]
    assert not {4, 5, 6} & set(seen[0]) and set(seen[0]) == set(seen[1])
    assert 0 in seen[2] and 1 not in seen[2] and set(seen[1]) - set(seen[2]) == {1}
    assert shared in seen[3][2] and shared not in seen[3][3] and all(seen[3][n] == seen[2][n] for n in range(7, 40))
    pieces_ = cp.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces_} == set(seen[3])


def test_stages_take_columns_of_any_name(spark, tmp_path):
    """Extra columns with the names that stages use themselves pass through all of them."""
    import corpus_pipeline as cp

    rng = np.random.default_rng(3)
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 3000, 120))
    shared = text()
    docs = [(n, text() + (" " + shared if n in (3, 5) else "")) for n in range(12)] + [(12, None), (None, text())]
    names = ["kept", "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256", "carried", "more", "block", "family", "payload", "row", "size", "score", "y", "a b"]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    frame = spark.createDataFrame([(n, t, len(t or ""), *(f"{c}{n}" for c in names)) for n, t in docs], schema)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, 1, 0) for n in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = frame
    for _, stage in cp.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == frame.columns
    got = {r.doc_id: r for r in now.collect()}
    assert shared in got[3].text and shared not in got[5].text and got[5].n_chars == len(got[5].text)
    assert all(got[n][c] == f"{c}{n}" for n in got for c in names)
    assert cp.run(spark, str(tmp_path)).count() > 0


def test_training_rows_are_bounded_in_rows_and_bytes(spark):
    """A thousand rows of one id give one; long texts and too many bytes are left out, of each class alike."""
    copies = [(1, "same"), (1, "other")] * 500 + [(n, "x" * 100) for n in range(2, 300)] + [(300, "y" * 5000)]
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(n, n % 2) for n in range(1, 301)], "doc_id long, quality int")
    rows = training_rows(docs, labels, "quality", 400)[0].collect()
    assert len({r.doc_id for r in rows}) == len(rows) > 150
    rows = training_rows(docs, labels, "quality", 40, most_bytes=64 * 1000)[0].collect()
    assert len(rows) == 40 and len({r.doc_id for r in rows}) == 40 and max(len(r.text) for r in rows) <= 1000
    rows = training_rows(docs, labels, "quality", 400, most_bytes=64 * 100)[0].collect()
    for y in (0, 1):
        assert 0 < sum(len(r.text) for r in rows if r.y == y) <= 3200
    assert {r.text for r in training_rows(docs, labels, "quality", 4000)[0].collect() if r.doc_id == 1} <= {"same", "other"}


def test_the_classifier_rejects_what_the_rules_miss(spark, tmp_path):
    """The rows labelled 0 are no longer among the stage's documents, unlabelled ones of their kind are."""
    import corpus_pipeline as cp

    rng = np.random.default_rng(1)
    text = lambda kind: " ".join(f"{kind}{k}" for k in rng.integers(0, 3000, 120))
    docs = [(n, text("good" if n % 2 else "bad")) for n in range(240)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame([(n, t, "en", "s", len(t)) for n, t in docs], schema)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    # ids beyond the table must not use up the bounded sample
    labels = [(n, n % 2, 0) for n in range(200)] + [(n, 0, 0) for n in range(1000, 1300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = frame.where("doc_id >= 200 OR doc_id % 2 = 1")
    kept = {r.doc_id for r in cp.classifier(spark, left, str(tmp_path)).collect()}
    assert kept == set(range(1, 240, 2))


def test_training_rows_are_chosen_among_the_documents(spark):
    docs = spark.createDataFrame([(n, f"text {n}") for n in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(400)], "doc_id long, quality int")
    rows, counts = training_rows(docs, labels, "quality", 10)
    assert sorted(r.y for r in rows.collect()) == [0] * 5 + [1] * 5
    assert counts == [r["n"] for r in labels.where("doc_id < 40").where(~held_out()).groupBy("quality").agg(F.count("*").alias("n")).orderBy("quality").collect()]


def test_registered_names():
    import __spark_entry__ as driver

    names = list(driver.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


def test_the_rest_works_without_these_folders(tmp_path):
    """The entry file imports when the subpackage and the pipeline are gone."""
    for name in ("cohortflow", "checks", "__spark_entry__.py"):
        os.symlink(os.path.join(REPO, name), tmp_path / name) if name != "cohortflow" else None
    os.mkdir(tmp_path / "cohortflow")
    for name in os.listdir(os.path.join(REPO, "cohortflow")):
        if name not in ("llm", "__pycache__"):
            os.symlink(os.path.join(REPO, "cohortflow", name), tmp_path / "cohortflow" / name)
    code = "import importlib.util as u, json, sys; sys.path.insert(0, '.'); import runpy; m = runpy.run_path('__spark_entry__.py'); print(json.dumps(sorted(m['queries']())))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    with open(tmp_path / "__spark_entry__.py") as f:
        source = f.read()
    os.unlink(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(source)
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    names = json.loads(out.stdout.splitlines()[-1])
    assert "item_scan" in names and "pipeline" not in names and not [n for n in names if n.startswith("op")]


def test_lattice_sums_plain_and_by_logarithm(monkeypatch):
    """Chances are the same whether weights are multiplied as they are or by logarithm, and add up at every state."""
    import numpy as np
    import public_tokenizers

    from cohortflow.llm import pieces

    v = pieces.Vocabulary(pieces.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    buf = np.frombuffer(" hello übermäßig 漢字 \U0001f600 a internationalisation".encode(), np.uint8)
    end = np.append(np.flatnonzero(buf == 32)[1:], len(buf))
    begin = np.append(0, end[:-1])
    plain = pieces.build_lattice(v, buf, begin, end)
    monkeypatch.setattr(pieces, "MOST_LOG", 0)
    logs = pieces.build_lattice(v, buf, begin, end)
    assert (plain.piece == logs.piece).all() and np.abs(plain.chance - logs.chance).max() < 1e-12
    state = np.flatnonzero(np.diff(plain.first))
    assert np.abs(np.add.reduceat(plain.chance, plain.first[state]) - 1).max() < 1e-12
    # a word too long for plain products
    long = np.frombuffer(b" " + b"ab" * 400, np.uint8)
    monkeypatch.undo()
    far = pieces.build_lattice(v, long, np.zeros(1, np.int64), np.array([len(long)]))
    assert np.isfinite(far.chance).all() and (far.chance > 0).all()


def test_samples_do_not_depend_on_the_window(monkeypatch):
    import numpy as np
    import public_tokenizers

    from cohortflow.llm import pieces

    v = pieces.Vocabulary(pieces.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    texts = [("some words that part in many ways " * 30).encode(), b"short", b"\xe6\xbc\xa2" * 300, b"", b"x " * 900]
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])

    def drawn():
        own = pieces.Sampler(v, buf, off, np.arange(len(texts)))
        return sorted((r, s, own.ids(e).tolist(), round(g, 6), round(q, 6)) for r, s, e, _, g, q in own.run(4))

    wide = drawn()
    monkeypatch.setattr(pieces, "WINDOW", pieces.NEAR)
    assert drawn() == wide
