"""The FM-index against plain search, spans against a scan of all windows, and against the SQL."""

import hashlib
import random
import re
from types import SimpleNamespace

import duckdb
import numpy as np
from hypothesis import given, settings, strategies as st

from aftershock.llm import decontam
from pyspark.sql import functions as F

from .util import awkward, documents

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def windows(items):
    out = {}
    for i, text in items:
        w = words(text)
        for k in range(max(len(w) - 9, 1) if w else 0):
            out.setdefault(tuple(w[k:k + 10]), set()).add(i)
    return out


def brute(docs, items):
    known, rows = windows(items), []
    lengths = {len(w) for w in known}
    for i, text in docs:
        w, hit, named = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in known:
                    hit.update(range(k, k + n))
                    named |= {str(x) for x in known[tuple(w[k:k + n])] if x is not None}
        rows.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return rows


def key(r):
    return tuple((x is not None, x) for x in r)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_words_equal_the_pattern(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [w.decode() for w in decontam.words_of(text)] == words(text)


piece = st.lists(st.sampled_from([b"a", b"b", b"c", b"dd"]), max_size=90)


@settings(max_examples=150, deadline=None)
@given(st.lists(piece, max_size=6), st.lists(st.lists(st.sampled_from([b"a", b"b", b"c", b"x"]), min_size=1, max_size=4), min_size=1, max_size=8))
def test_search_and_location_equal_a_scan(pieces, phrases):
    index = decontam.FMIndex.build(pieces)
    index = decontam.FMIndex.unpack(SimpleNamespace(**index.pack()))
    assert index.n == sum(len(p) + 1 for p in pieces)
    known = {w: k for k, w in enumerate(index.vocabulary, 1)}
    flat = [w for p in pieces for w in (*p, None)]
    matrix = np.zeros((len(phrases), 4), dtype=np.int64)
    for k, p in enumerate(phrases):
        matrix[k, 4 - len(p):] = [known.get(w, -1) for w in p]
    found = dict.fromkeys(range(len(phrases)), ())
    for which, low, high in zip(*index.search(matrix)):
        found[which] = sorted(index.locate(np.arange(low, high)).tolist())
    for k, p in enumerate(phrases):
        assert list(found[k]) == [i for i in range(len(flat)) if flat[i:i + len(p)] == p]


def case(seed):
    rng = random.Random(seed)
    some = lambda n: [rng.choice(["the", "of", "é", "x1", "中文", "run"]) for _ in range(n)]
    items = [(k, rng.choice([" ", ", ", "\n"]).join(some(n))) for k, n in enumerate([14, 30, 10, 9, 3, 12, 25, 1, 0])]
    items += [(3, "a second text of item three that is long enough here"), (None, "no id but hit all the same by its ten words"), (20, None),
              (21, items[0][1])]
    items[7] = (7, "lonely")
    docs = []
    for i in range(60):
        parts = [some(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            w = words(rng.choice(items)[1])
            a = rng.randrange(0, max(len(w), 1))
            parts += [w[a:] if rng.random() < 0.5 else w, some(rng.randrange(0, 9))]
        docs.append((i, rng.choice([" ", ". ", "-"]).join(x.upper() for p in parts for x in p)))
    return docs, items


def tables(spark, docs, items):
    return documents(spark, [(i, t, None, None) for i, t in docs]), spark.createDataFrame(items, "item_id long, text string")


def test_table_equals_a_scan_and_the_sql(spark):
    docs, items = case(1)
    got = sorted((tuple(r) for r in decontam.decontamination_table(*tables(spark, docs, items)).select(*COLUMNS).collect()), key=key)
    assert got == sorted(brute(docs, items), key=key)
    assert {r[5] for r in got} == {True, False} or all(r[5] for r in got)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    sql = con.execute(decontam.ORACLE_SQL)
    assert [d[0] for d in sql.description] == COLUMNS
    assert sorted(sql.fetchall(), key=key) == got


def test_small_shards_and_blocks_give_the_same(spark, monkeypatch):
    docs, items = case(2)
    d, b = tables(spark, docs, items)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 3_000)
    for size in (5, 25, 400):
        index = decontam.fm_shards(d, size=size)
        assert index.count() > 1
        got = decontam.removal_spans(index, decontam.benchmark_phrases(b)).collect()
        hits = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["items"])) for r in got}
        assert hits == {r[0]: r[1:4] for r in brute(docs, items)}
        for r in got:
            ends = [x for s in r["spans"] for x in (s["start"], s["end"])]
            assert ends == sorted(set(ends))


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark).withColumn("row", F.lit(1)).withColumn("spans", F.lit("x"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(1, "the same few words here now"), (1, "here now"), (None, "w5 x5 w6 x6 w7 x7 w8 x8 w9 x9 w10"), (5, ""), (6, None), (7, "中文")]
    b = spark.createDataFrame([(*x, 1, "x") for x in items], "item_id long, text string, doc_id int, phrase string")
    got = sorted((tuple(r) for r in decontam.decontamination_table(docs, b).select(*COLUMNS).collect()), key=key)
    assert got == sorted(brute(rows, items), key=key)
    none = decontam.decontamination_table(docs, b.where("false"))
    assert none.columns == COLUMNS and none.where("contaminated").isEmpty() and none.count() == len(rows)
    assert decontam.decontamination_table(docs.where("false"), b).count() == 0
