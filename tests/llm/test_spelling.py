"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings, strategies as st

from aftershock.llm import spelling
from pyspark.sql import functions as F

from .util import awkward, documents

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {i: i + 32 for i in range(65, 91)}
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def brute_counts(rows):
    total = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = None if i is None else zlib.crc32(f"{i}:{run}".encode())
            if h is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def brute(rows):
    n = brute_counts(rows)
    near = {a: [b for b in n if one_edit(a, b)] for a in n}
    form = {}
    for a in n:
        best = min(near[a], key=lambda b: (-n[b], b), default=None)
        form[a] = best if best is not None and n[best] >= 2 * n[a] else None

    def root(a):
        return a if form[a] is None else root(form[a])

    return sorted((a, form[a], root(a), n[a], len(near[a]), n[form[a]] if form[a] else None) for a in n)


def got(df):
    assert df.columns[:6] == COLUMNS
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def variants(seed, n_docs=40):
    rng = random.Random(seed)
    stems = ["straße", "señora", "letter", "lettre", "aaaaaa", "ababab", "bababa", "abbaab", "house", "mouse", "Ünder", "×÷×÷×"]
    rows = []
    for i in range(n_docs):
        words = []
        for _ in range(60):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abeñÉ") + w[k:], w[:k] + rng.choice("abeñÉ") + w[k + 1:]])
            words.append(w)
        rows.append((i, rng.choice([" ", "\n", "1", "_中"]).join(words)))
    return rows


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_words_equal_the_pattern(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [w.decode("latin-1") for w in spelling.words_of(text)] == [r.translate(LOWER) for r in RUN.findall(text)]


@pytest.mark.parametrize("seed", [1, 2])
def test_table_equals_all_pairs_and_the_sql(spark, seed):
    rows = variants(seed)
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    assert got(spelling.spelling_table(docs)) == brute(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    sql = con.execute(spelling.ORACLE_SQL)
    assert [d[0] for d in sql.description] == COLUMNS
    assert sorted(sql.fetchall()) == brute(rows)


@pytest.mark.parametrize("parts, each", [(1, 4), (2, 3), (3, 1)])
def test_every_scheme_finds_all_near_words(spark, monkeypatch, parts, each):
    monkeypatch.setattr(spelling, "DISTANCE_IN_PART", (spelling.DISTANCE + parts) // parts - 1)
    words = sorted(brute_counts(variants(3)))
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    letters = spelling.subparts(table, parts, each)
    assert sorted("".join(map("".join, letters))) == sorted(spelling.LETTERS)
    found = {tuple(r) for r in spelling.near_words(table, letters).collect()}
    assert found == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_words_of_the_same_letters_do_not_meet(spark):
    """720 words of the same six letters: only few share a half."""
    from itertools import permutations
    words = ["".join(p) for p in permutations("abcdef")]
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    assert spelling.near_words(table, spelling.subparts(table)).isEmpty()


def test_chains_are_followed_to_their_end(spark):
    chain = ["abcde" + "x" * k for k in range(9)]
    rows = spark.createDataFrame([(w, chain[k + 1] if k < 8 else None) for k, w in enumerate(chain)], "word string, form string")
    assert {tuple(r) for r in spelling.roots(rows).collect()} == {(w, chain[-1]) for w in chain}


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark).withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(spelling.spelling_table(docs)) == brute(rows)
    empty = spelling.spelling_table(docs.where("false"))
    assert empty.columns == COLUMNS and empty.count() == 0
    many = documents(spark, [(k, "repeated words again", None, None) for k in range(9)])
    assert got(spelling.spelling_table(many.union(many))) == brute([(r["doc_id"], r["text"]) for r in many.union(many).collect()])
