"""Token counts and packing against the tokenizers library."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from aftershock.llm import packing, tokens

from .util import awkward, documents

TEXTS = ["", "a", "it's we'll 've 'tis", "  two  spaces\n\nand\tlines  ", "naïve café Ünïcode ß", "日本語のテキスト", "x²+y½ ⅷ ₂",
         "a<|endoftext|>b <|endoftext|>", "tab\x1csep\x85nel\xa0nbsp", "🙂👍🏽 emoji", "123 4567,89.0", "__init__ snake_case", "  end \r\n"]


def expected(text):
    return tokens.library().encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_encode_and_pre_tokens_equal_the_library(text):
    assert tokens.encode(text).tolist() == expected(text)
    assert int(tokens.count_pieces(tokens.pre_tokens(text)).sum()) == len(expected(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_equals_the_library(text):
    assert tokens.encode(text).tolist() == expected(text)
    assert int(tokens.count_pieces(tokens.pre_tokens(text)).sum()) == len(expected(text))


def test_counts_of_awkward_documents(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_DOCS", 3)
    docs = awkward(spark).union(documents(spark, [(100 + k, t, "en", "a") for k, t in enumerate(TEXTS)],
                                          "c1 double, c2 long, c3 string, c4 string, c5 string, c6 string, c7 string, c8 string, c9 string, d1 string, d2 string, d3 string",
                                          (0.5, 7, *["x"] * 10)))
    text = {(r["doc_id"], r["n_chars"]): r["text"] or "" for r in docs.collect()}
    want = sorted((str(i), len(t.encode()), len(expected(t))) for (i, _), t in text.items())
    got = tokens.token_table(docs).collect()
    assert sorted({(str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got}) == want
    assert len(got) == docs.count() and all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert tokens.token_table(docs.limit(0)).count() == 0


def test_cut():
    assert packing.cut(np.arange(5), 4) == [(0, 1), (1, 5)]
    assert packing.cut(np.arange(8), 4) == [(0, 4), (4, 8)]
    assert packing.cut(np.arange(3), 4) == [(0, 3)]


def _check(docs, out):
    rows = out.collect()
    by_sequence, by_document = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_document.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    for d in docs.collect():
        ids = np.array([*expected(d["text"]), 2], dtype="<u4")
        at = 0
        for piece, start, length, crc in sorted(set(by_document[d["doc_id"]])):
            assert start == at and zlib.crc32(ids[at:at + length].tobytes()) == crc and (piece == 0 or length == 1024)
            at += length
        assert at == len(ids)
    return by_sequence, rows


def test_packing_of_awkward_documents(spark):
    docs = awkward(spark)
    by_sequence, rows = _check(docs, packing.packing_table(docs))
    assert len(by_sequence) <= 1.1 * sum(r["length"] for r in rows) / 1024 + 1
    assert packing.packing_table(docs.limit(0)).count() == 0


def test_packing_is_tight(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["word"] * int(n)), "en", "a") for i, n in enumerate(rng.integers(1, 1500, 700))]
    docs = documents(spark, rows)
    by_sequence, pieces = _check(docs, packing.packing_table(docs))
    assert len(by_sequence) <= 1.02 * sum(r["length"] for r in pieces) / 1024 + 1


def test_pieces_can_keep_their_ids(spark):
    docs = documents(spark, [(1, "some words to keep", "en", "a"), (2, None, None, None)])
    got = {r["doc_id"]: r["ids"] for r in packing.pieces(docs, keep_ids=True).collect()}
    assert got[1] == [*expected("some words to keep"), 2] and got[2] == [2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.integers(1, 40))
def test_plans_place_every_piece_once(lengths, groups):
    sequence, large = 64, 16
    counts = np.bincount(lengths or [0], minlength=sequence + 2)
    counts[0] = 0
    slots, n = packing.plan_large(counts, sequence, large, groups)
    big = sorted((x for x in lengths if x >= large), reverse=True)
    room = np.full(n, sequence)
    at = 0
    for a, b, first, times in slots:
        assert a == at
        at = b
        for k in range(a, b):
            room[first + (k - a) % times] -= big[k]
    assert at == len(big) and (room >= 0).all()
    left = np.bincount(room, minlength=sequence + 2) if n else np.zeros(sequence + 2, dtype=int)
    left[0] = 0
    plan = packing.plan_small(counts, left, sequence, large)
    used = {}
    for length, a, b, origin, number in plan:
        for k in range(b - a):
            used[origin, number + k] = used.get((origin, number + k), 0) + length
    for (origin, number), total in used.items():
        assert total <= min(origin, sequence) and (origin > sequence or number < left[origin])
    for length in range(1, large):
        spans = sorted((a, b) for x, a, b, *_ in plan if x == length)
        assert sum(b - a for a, b in spans) == counts[length] and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_best_fill_is_a_knapsack():
    assert packing.best_fill(10, np.array([7, 4, 3]), np.array([1, 2, 2])) in ([1, 0, 1], [0, 1, 2])
    assert packing.best_fill(2, np.array([7, 4, 3]), np.array([1, 2, 2])) == [0, 0, 0]
    assert sum(np.array(packing.best_fill(12, np.array([5, 4]), np.array([9, 1]))) * [5, 4]) == 10
