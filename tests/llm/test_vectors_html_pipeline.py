"""Vector searches against brute force, HTML extraction, and the pipeline as a whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from aftershock.llm import ann, html_pages, html_text, topk

from .util import documents

SF001 = "/root/testdata/sf0.001"


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double")


def brute(x, ids, queries, k):
    out = {}
    for q in queries:
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), s[j]) for j in order]
    return out


def _by_query(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + 0.2 * rng.normal(size=(1500, 16))) * rng.lognormal(0, 0.6, (1500, 1))
    x[100:160] = x[100]  # ties
    return x.astype(np.float32)


def _table(spark, x):
    return _vectors(spark, [(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)])


def test_top_products_are_exact(spark, points, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 128)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk, "RUN", 32)
    got = _by_query(topk.top_table(_table(spark, points)))
    x = np.floor(256 * points.astype(float)).astype(np.int64)
    want = brute(x, np.arange(len(x)), range(0, len(x), 50), 5)
    assert got == want


def test_scan_prunes_but_loses_nothing(points):
    x = np.floor(256 * points.astype(float)).astype(np.int64)
    order = np.argsort(-(x * x).sum(axis=1), kind="stable")
    x, ids = x[order], order.astype(np.int64)
    search = topk.Search(np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1], 3)
    calls = []
    exact, search.exact = search.exact, lambda q, x, row, col: calls.append(len(row)) or exact(q, x, row, col)
    found = search.scan(ids[:40], x[:40], np.full(40, -np.inf), ids, x)
    for q, (i, s) in enumerate(found):
        assert [(int(a), int(b)) for a, b in zip(i, s)] == brute(x, ids, [q], 3)[int(ids[q])]
    assert sum(calls) < 0.7 * 40 * len(x)


def test_neighbours_reach_recall(spark, points, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "SAMPLE", 500)
    monkeypatch.setattr(ann, "BOXES", 4)
    got = _by_query(ann.nearest_table(_table(spark, points)))
    x = points.astype(float)
    want = brute(x, np.arange(len(x)), range(0, len(x), 20), 20)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    for q, rows in got.items():
        assert len(rows) == 20 and all(i != q and s == pytest.approx(x[i] @ x[q], abs=1e-12) for i, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))


def test_search_stops_early(points):
    x = points.astype(float) / np.linalg.norm(points, axis=1)[:, None]
    normal = np.random.default_rng(ann.SEED).standard_normal((17, ann.DIMS))
    projection = ann.Projection(normal, 1.0 + 1e-9, np.zeros((0, 2)), 0)
    block = ann.Block.build(np.arange(len(x)), x, projection.vectors(x))
    assert sorted(block.ids.tolist()) == list(range(len(x))) and np.diff(block.ends, prepend=0).max() <= ann.LEAF
    ids, scores = block.search(3, x[3], projection.queries(x[3:4])[0], 1.0 + 1e-9, 5, -np.inf, ann._ratio_at(ann.SURE))
    assert len(ids) == 5 and abs(ann.chi_square_mass(np.array(ann._ratio_at(0.9))) - 0.9) < 1e-9


@pytest.mark.parametrize("search", [topk.top_table, ann.nearest_table])
def test_awkward_vectors(spark, search):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 0, 0.1), (50, None, 0, 0.1), (100, [nan, 1.0], 0, 0.1), (1, [inf, 1.0], 0, 0.1), (2, [None, 1.0], 0, 0.1),
            (3, [0.5], 1, 0.1), (4, [0.25, 0.25], 1, 0.1), (5, [0.25, 0.25], None, None), (None, [1.0, 1.0], 0, 0.1), (200, [-1.0, 0.0], 0, 0.1)]
    got = _by_query(search(_vectors(spark, rows)))
    assert {q: [i for i, _ in r] for q, r in got.items()} == {0: [3, 4, 5, 200], 200: [4, 5, 3, 0]}
    assert search(_vectors(spark, []).limit(0)).count() == 0
    assert search(_vectors(spark, [(7, [1.0], 0, 0.0)])).count() == 0
    zero = _by_query(search(_vectors(spark, [(0, [0.0, 0.0], 0, 0.0), (1, [1.0, 0.0], 0, 0.0)])))
    assert zero == ({0: [(1, 0)]} if search is topk.top_table else {})
    big = [(i, [1e6 * (i + 1), 1.0], 0, 0.0) for i in (0, 1, 2)]
    assert [i for i, _ in _by_query(search(_vectors(spark, big)))[0]] == [2, 1]


# --------------------------------------------------------------------- HTML


@pytest.fixture(scope="module")
def extractor():
    return html_text.train(html_pages.labelled_pages())


def test_extracts_the_article_and_nothing_else(extractor):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header class="site-header"><h1>Site</h1><nav><ul><li><a href="/">Home</a></li></ul></nav></header>
    <!-- ad 1 --><div class="ad">Buy this</div><div id="cookie-notice">We use cookies</div>
    <article><h1>Title &amp; more</h1><p><b>First  part<br><p>Second&nbsp;part with a <a href="/x">link</a>, and fi<i>ni</i>sh.</p>
    <div class="advertisement"><p>An advert of quite a few words inside of the article</p></div>
    <ul><li>one item</li><li>two &lt;items&gt;</li></ul><p></p></article>
    <section id="comments" class="comments"><div class="comment"><p>I liked this very much, thank you for the post</p></div></section>
    <aside>Related things</aside><form>Mail <input><button>Send</button></form><footer>&copy; 2024 Somebody</footer>"""
    assert extractor.extract(page) == "Title & more\nFirst part\nSecond part with a link, and finish.\none item\ntwo <items>"


def test_plain_and_broken_pages(extractor):
    assert extractor.extract(None) == extractor.extract("") == extractor.extract("<nav><a>Home</a></nav>") == ""
    assert extractor.extract("just text") == "just text"
    assert extractor.extract("a < b and 3 > 2 <p>next") == "a < b and 3 > 2\nnext"
    assert extractor.extract("<p>one<script>never closed <p>two") == "one"
    long = "<article>" + "".join(f"<p>paragraph number {i} of many</p>" for i in range(5000)) + "</article>"
    assert extractor.extract(long).count("\n") == 4999


def test_learns_the_labelled_pages(extractor):
    wrong = 0
    for page in html_pages.labelled_pages():
        plain = page.replace(html_pages.MARK, "").replace(html_pages.UNMARK, "")
        parts = [p.split(html_pages.UNMARK)[0] for p in page.split(html_pages.MARK)[1:]]
        wrong += extractor.extract(plain) != extractor.extract(f"<article>{''.join(parts)}</article>")
    assert wrong <= 4


def test_best_stretch_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        w = rng.integers(-3, 4, rng.integers(1, 25)).astype(float).tolist()
        a, b = html_text.best_stretch(w)
        assert sum(w[a:b]) == max([0.0] + [sum(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)]) or min(w) < 0
    assert html_text.best_stretch([-1, 2, -1, 3, -5, -5]) == (1, 4)
    assert html_text.best_stretch([20, *[-1] * 40, 20]) == (0, 42)  # the gap costs no more than its most


def test_scan_equals_brute_force_with_gaps():
    rng = np.random.default_rng(5)
    for gap in html_text.GAPS:
        for _ in range(60):
            w = rng.integers(-3, 4, rng.integers(1, 25)).astype(float).tolist()
            costs = [x if x > 0 else gap * x for x in w]
            a, b = html_text.best_stretch(w, gap)
            assert sum(costs[a:b]) == max([0.0] + [sum(costs[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)])


def test_a_long_gap_cuts_off_a_slogan(extractor):
    article = f"<article><p>{'word ' * 80}</p></article>"
    for n, cut in ((200, True), (3, False)):
        page = f'<body><div class="tagline"><p>a slogan of a dozen words that no name tells from the text</p></div><nav>{"menu " * n}</nav>{article}</body>'
        assert extractor.extract(page).startswith("word") == cut
    assert html_text.GAPS[0] >= extractor.gap > html_text.GAPS[-1]


def test_a_block_within_the_article_does_not_cut_it(extractor):
    part = f"<p>{'word ' * 40}</p>"
    page = f'<article>{part}<div class="related"><p>{"other " * 60}</p></div>{part}</article>'
    assert extractor.extract(page).split() == ["word"] * 80


@pytest.mark.parametrize("around", ['<body class="page has-sidebar sidebar">{}</body>', '<html class="no-sidebar"><body class="menu">{}</body></html>',
                                    '<div class="menu sidebar">{}</div>', '<main id="search">{}</main>', '<div class="site no-sidebar">{}</div>'])
def test_names_around_a_page_do_not_empty_it(extractor, around):
    page = around.format(f'<nav>{"menu " * 20}</nav><article class="more"><p>{"word " * 60}</p></article><div class="sidebar">other text</div>')
    assert extractor.extract(page).split() == ["word"] * 60


@pytest.mark.parametrize("names", ['id="discussion"', 'class="read-more-content"', 'id="legal-history"', 'class="side-by-side"', 'id="legal"', 'class="form-factor"'])
def test_sections_of_an_article_keep_their_text(extractor, names):
    for tag in ("section", "div"):
        page = f'<article><p>{"word " * 30}</p><{tag} {names}><h2>word</h2><p>{"word " * 20}</p></{tag}><div id="sidebar">other</div><p>{"word " * 9}</p></article>'
        assert extractor.extract(page).split() == ["word"] * 60


def test_names_are_taken_by_their_letters(extractor):
    for names in ('class="side-bar"', 'class="col sidebar-2"', 'id="cookieBanner"', "class=related_posts", 'id="sidebar"'):
        for start in ("", "<article>"):
            assert "other" not in extractor.extract(f'{start}<p>{"word " * 60}</p><div {names}>other text</div><p>{"word " * 60}</p>')


def test_formulas_are_text(extractor):
    page = "<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='application/x-tex'>x=2</annotation></math> holds</p></article>"
    assert extractor.extract(page) == "so x=2 holds"


def test_pages_table(spark):
    rows = [(1, "u", "<p>some words here</p>", 3), (2, None, None, 4), (None, "u", "", 5), (1, "u", "<p>some words here</p>", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted(map(tuple, html_text.page_table(pages).collect()), key=str)
    assert got == sorted([(1, "u", "some words here", 15), (2, None, "", 0), (None, "u", "", 0), (1, "u", "some words here", 15)], key=str)
    assert html_text.page_table(pages.limit(0)).count() == 0


# ------------------------------------------------------------------ pipeline


def test_every_operator_is_registered_once():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF001), "stage")
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and ids <= before and ids, name
        if name == "near-dedup":
            assert docs.count() == len(ids)
        before = ids
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == before
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()
    assert corpus_pipeline.run(spark, SF001).count() == out.count()


def test_pipeline_survives_awkward_documents(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (None, "some words", "en", "b")] + [(k, f"a text of words {k % 3}", "en", "s") for k in range(3, 30)]
    for docs in (documents(spark, rows), documents(spark, rows).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, SF001), "stage")
        docs.count()
