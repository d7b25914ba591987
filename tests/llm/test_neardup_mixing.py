"""Near duplicates against all pairs, components against union-find, mixing against its contract."""

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from aftershock.llm import mixing, neardup
from aftershock.llm.components import components
from aftershock.llm.ranks import BUCKETS, bucket_of, number_within
from pyspark.sql import functions as F

from .util import awkward, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) >= 5:
        return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    return frozenset([tuple(words)] if words else [])


def brute_components(rows):
    """doc_id -> least id reachable over links of all pairs; rows: (doc_id, text)."""
    sets = {i: brute_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbB \n\té中", max_size=40), max_size=12))
def test_shingle_sets_equal_word_tuples(texts):
    for text, got in zip(texts, neardup.shingle_sets(texts)):
        assert len(got) == len(brute_set(text))
    got = neardup.shingle_sets(texts)
    for a, x in zip(texts, got):
        for b, y in zip(texts, got):
            assert len(np.intersect1d(x, y)) == len(brute_set(a) & brute_set(b))
            p, q = brute_set(a), brute_set(b)
            assert neardup.similar(x, y) == bool(p and q and 100 * len(p & q) >= 75 * len(p | q))


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(4)
    for share in (0.95, 0.85, 0.75):
        for _ in range(20):
            union = np.unique(rng.integers(0, 1 << 62, 1200, dtype=np.uint64))[:1000]
            own = int(1000 * (1 - share) / 2)
            a, b = union[own:], union[:1000 - own]
            (bands_a, sketch_a), (bands_b, sketch_b) = neardup.signature(a), neardup.signature(b)
            bits = sum(int(x).bit_count() for x in (sketch_a ^ sketch_b).view(np.uint64))
            assert bits <= neardup.most_differing_bits()
            toggles = -neardup.SKETCH_BITS / 2 * np.log(1 - 2 * bits / neardup.SKETCH_BITS)
            assert abs(1 - toggles / (2 * neardup.BANDS * neardup.ROWS) - share) < 0.17
            assert (bands_a == bands_b).any()


def _family(rng, n_words, copies, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(n_words)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(n_words)] = f"e{rng.randrange(10 ** 6)}"
        yield " ".join(words)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 3)  # most buckets are large
    rng = random.Random(seed)
    texts = [t for n, copies, edits in ((100, 12, 8), (60, 25, 6), (200, 15, 14), (40, 10, 4), (7, 8, 1), (3, 4, 1))
             for t in _family(rng, n, copies, edits)]
    texts += ["shared passage of many words that stands in several texts here " + " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(30))
              for _ in range(15)]
    # a chain: neighbours are linked, far ends are not
    chain = [f"c{k}" for k in range(200)]
    texts += [" ".join(chain[3 * k:3 * k + 60]) for k in range(30)]
    rng.shuffle(texts)
    rows = [(i * 3, t, "en", "a") for i, t in enumerate(texts)]
    got = neardup.neardup_table(documents(spark, rows)).collect()
    want = brute_components([(i, t) for i, t, *_ in rows])
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    for r in got:
        assert r["kept"] == (r["doc_id"] == r["component_id"])
        assert r["n_shingles"] == len(brute_set(next(t for i, t, *_ in rows if i == r["doc_id"])))


def test_near_dedup_equals_sql(spark):
    rng = random.Random(9)
    texts = [t for n, copies, edits in ((80, 8, 8), (30, 6, 3), (6, 5, 1), (4, 3, 1)) for t in _family(rng, n, copies, edits)]
    texts += [None, "", " \t\n", "One Two\tthree\u00a0x FOUR five", "one two THREE\u00a0x four\nfive", "one two three", "c " * 30, "c " * 9]
    # a chain: the far ends are linked only through the others
    texts += [" ".join(f"c{k}" for k in range(4 * i, 4 * i + 60)) for i in range(12)]
    rng.shuffle(texts)
    docs = documents(spark, [(i * 3, t, "en", "a") for i, t in enumerate(texts)])
    got = neardup.neardup_table(docs)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    found = con.execute(neardup.ORACLE_SQL)
    assert [c[0] for c in found.description] == got.columns
    assert sorted(found.fetchall()) == sorted(tuple(r) for r in got.collect())


def test_awkward_documents(spark):
    docs = awkward(spark)
    got = neardup.neardup_table(docs).collect()
    assert len(got) == docs.count()
    where = {r["doc_id"]: r["component_id"] for r in got}
    assert where == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, None: None}
    assert neardup.neardup_table(docs.limit(0)).count() == 0
    one = neardup.keep_one(docs)
    assert one.columns == docs.columns and sorted(str(r["doc_id"]) for r in one.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 7, 8, None]))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=60))
def test_component_labels(spark, edges):
    parent = list(range(41))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in range(41) if find(k) != k}


def test_number_within_splits_groups(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2500, 0).otherwise(F.col("id") % 3).alias("g"))
    out = number_within(rows.withColumn("b", bucket_of(F.col("id").cast("string"))), ["g"], "b", ["id"], "k").collect()
    assert {r["b"] for r in out} <= set(range(BUCKETS)) and len({r["b"] for r in out}) > BUCKETS / 2
    by = defaultdict(list)
    for r in out:
        by[r["g"]].append(r["k"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def brute_targets(sizes):
    """Targets by resharing the excess until none is above its cap; sizes by source."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, free, out = sum(sizes.values()), set(names), {}
    while free:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            free.remove(s)
    return out


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        source = rng.choice(["big"] * 8 + ["Z", "a", "b", "c", None, "é"] + ["tiny"] * (i % 40 == 0))
        rows.append((i, None if i % 97 == 0 else " ".join(["w"] * rng.randrange(0, 200)), "en", source))
    return documents(spark, rows)


def test_mixing_contract(sources):
    got = mixing.mixing_table(mixing.sized(sources)).collect()
    source = {r["doc_id"]: r["source"] for r in sources.collect()}
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        targets[s] = r["target"]
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    assert targets == pytest.approx(brute_targets(sizes))
    assert all(r["source_size"] == sizes[source[r["doc_id"]]] for r in got)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 200 + 0.01 * targets[s]


def test_mixing_equals_sql_and_reruns_agree(spark, sources):
    got = mixing.mixing_table(mixing.sized(sources))
    frame = sources.toPandas()
    con = duckdb.connect()
    con.register("documents", frame)
    want = sorted(con.execute(mixing.ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in got.collect()) == want
    again = mixing.mixing_table(mixing.sized(sources.repartition(7, "source")))
    assert sorted(tuple(r) for r in again.collect()) == want


def test_mix_emits_what_the_table_says(sources):
    table = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mixing_table(mixing.sized(sources)).collect()}
    out = mixing.mix(sources)
    assert out.columns == sources.columns
    copies = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert all(copies.get(i, 0) * size == taken for i, (size, taken) in table.items())


def test_mixing_awkward_documents(spark):
    docs = awkward(spark)
    got = mixing.mixing_table(mixing.sized(docs)).collect()
    assert len(got) == docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs).count() > 0
    assert mixing.mixing_table(mixing.sized(docs.limit(0))).count() == 0
    silent = documents(spark, [(1, None, None, "a"), (2, "", None, None)])
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mixing_table(mixing.sized(silent)).collect()} == {(0, 0.0, 0)}
