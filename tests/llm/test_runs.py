"""Lyndon arrays and runs against their definitions, and the query against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from aftershock.llm import runs
from pyspark.sql import functions as F

from .util import awkward, documents


def brute_lyndon(s):
    out = []
    for i in range(len(s)):
        words = (s[i:i + m] for m in range(1, len(s) - i + 1))
        out.append(max(len(w) for w in words if all(w < w[k:] for k in range(1, len(w)))))
    return out


def brute_runs(s, exponent, least):
    out = []
    for q in range(1, len(s) // exponent + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            n = j - i + q
            w = s[i:i + n]
            if j > i and n >= max(least, exponent * q) and not any(w[p:] == w[:-p] for p in range(1, q)):
                out.append((i, n, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words, 4, 6)
    dropped = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in found), default=None)
    first = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *first, digest("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()),
            digest(b" ".join(w for k, w in enumerate(words) if k not in dropped)))


texts = st.lists(st.integers(0, 3), max_size=40) | st.builds(
    lambda a, w, k, z: a + w * k + w[:len(w) // 2] + z, st.lists(st.integers(0, 2), max_size=5),
    st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9), st.lists(st.integers(0, 2), max_size=5))


@settings(max_examples=300, deadline=None)
@given(texts)
def test_lyndon_array_equals_the_definition(s):
    assert runs.lyndon_lengths(s, 4) == brute_lyndon(s)
    turned = [3 - x for x in s]
    assert runs.lyndon_lengths(turned, 4) == brute_lyndon(turned)


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(2, 5), st.integers(2, 8))
def test_runs_equal_the_definition(s, exponent, least):
    assert runs.find_runs(np.array(s, dtype=np.int64), exponent, least) == brute_runs(s, exponent, least)


@pytest.mark.parametrize("text", [[0] * 3000, [0, 1] * 1500, list(range(60)) * 50, [0, 0, 1] * 700 + [1] * 700])
def test_long_repetitions(text):
    assert runs.find_runs(np.array(text), 4, 6) == brute_runs(text, 4, 6)


def test_table_equals_plain_python(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        words = [rng.choice(["the", "of", "É", "x", "y z", "中"]) for _ in range(rng.randrange(0, 60))]
        if i % 3 == 0:
            words += [rng.choice("abc") for _ in range(rng.randrange(1, 6))] * rng.randrange(1, 9)
        rows.append((i, rng.choice([" ", "\n", " \t", "\x0b\x0c\r"]).join(words)))
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    got = sorted(tuple(r) for r in runs.run_table(docs).collect())
    assert got == [brute_row(i, t) for i, t in rows]
    assert sum(r[1] for r in got) > 20   # the case has runs


def test_texts_and_runs_themselves(spark):
    docs = documents(spark, [(1, "say no no no no no no more", None, None)])
    row = runs.run_texts(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 6, 1)]
    assert row["collapsed"] == "say no more" and row["n_words"] == 8


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark).withColumn("runs", F.lit(1)).withColumn("first", F.lit("x"))
    key = lambda r: (r[0] is not None, r)
    assert runs.run_table(docs).count() == docs.count()
    short = docs.where("length(text) < 1000 or text is null")
    got = sorted((tuple(r) for r in runs.run_table(short).collect()), key=key)
    assert got == sorted((brute_row(r["doc_id"], r["text"]) for r in short.collect()), key=key)
    assert runs.run_table(docs.where("false")).count() == 0
