"""Language ID, quality and toxicity: held-out accuracy, folds, and defined results."""

import random
import zlib

import numpy as np
import pytest

from aftershock.llm import langid, quality, toxicity

from .util import awkward, documents

WORDS = {
    "en": "the of and house water with morning that people under river street never always".split(),
    "de": "der die und haus wasser mit morgen dass leute unter fluss strasse niemals immer".split(),
    "es": "el los y casa agua con manana que gente bajo rio calle nunca siempre".split(),
}


def _text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        lang = ("en", "de", "es")[i % 3]
        text = _text(rng, lang, rng.randint(20, 120))
        bad, toxic = i % 7 == 0, i % 5 == 1
        if bad:
            text = " ".join(w + "###$$" for w in text.split())
        if toxic:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgit", "zorgam", "blarfest"]))
            text = " ".join(words)
        rows.append((i, text, lang, f"s{i % 4}"))
        if i % 2:
            labels.append((i, 0 if bad else 1, int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def _accuracy(got, truth):
    held = [r for r in got if r["held_out"]]
    assert held and len(held) < len(got)
    return np.mean([truth(r) for r in held])


def test_language_held_out_accuracy(corpus):
    docs, _ = corpus
    got = langid.language_table(docs).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert _accuracy(got, lambda r: r["lang_pred"] == lang[r["doc_id"]]) > 0.97
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in WORDS


def test_language_rejects_narrow_margins():
    model = langid.build_model({k: [" ".join(v * 20)] for k, v in WORDS.items()})
    assert model.predict("the house and the water under the river")[0] == "en"
    language, score, margin, rejected = model.predict("qq")
    assert language in WORDS and score <= 0.5 and margin < langid.NARROW and rejected
    assert model.predict("12 !?") == ("und", 0.0, 0.0, True)
    assert model.predict(None)[0] == model.predict("")[0] == "und"


def test_language_dictionary_leaves_foreign_passages_out():
    foreign = " ".join(WORDS["de"])
    model = langid.build_model({"en": [" ".join(WORDS["en"] * 5) + " " + foreign], "de": [foreign] * 3})
    assert b"wasser" not in model.dictionaries[model.languages.index("en")]


def test_quality_held_out_accuracy(corpus):
    docs, labels = corpus
    got = quality.quality_table(docs, labels).collect()
    assert _accuracy(got, lambda r: r["predicted"] == int(r["doc_id"] % 7 != 0)) > 0.98
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_quality_scores_equal_gaussian_densities():
    rng = np.random.default_rng(0)
    x = [rng.normal(0, 1, (400, 3)), rng.normal(1, 2, (200, 3))]
    model = quality.fit_moments(np.array([400.0, 200.0]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]), 0.2)
    both = np.concatenate(x)
    pooled = np.diag(both.var(axis=0))
    dens = []
    for a, prior in zip(x, (401 / 602, 201 / 602)):
        cov = 0.8 * np.cov(a.T, bias=True) + 0.2 * pooled
        d = both - a.mean(axis=0)
        dens.append(np.log(prior) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (d * np.linalg.solve(cov, d.T).T).sum(axis=1))
    assert np.allclose(model.scores(both), 1 / (1 + np.exp(dens[0] - dens[1])), atol=1e-6)


def test_toxicity_held_out_accuracy(corpus):
    docs, labels = corpus
    got = toxicity.toxicity_table(docs, labels).collect()
    assert _accuracy(got, lambda r: r["predicted"] == int(r["doc_id"] % 5 == 1)) > 0.98
    for r in got:
        assert r["predicted"] == int(r["score"] >= 0.5)


def test_label_model_finds_accuracies_and_discounts_copies():
    rng = np.random.default_rng(1)
    y = rng.random(6000) < 0.3
    good = np.where(rng.random(6000) < 0.9, y, ~y)
    weak = np.where(rng.random(6000) < 0.7, y, ~y)
    votes = np.stack([good, weak, weak, np.where(rng.random(6000) < 0.8, y, ~y)], axis=1).astype(float)
    labels = np.where(np.arange(6000) % 10 == 0, y, -1).astype(int)
    model = toxicity.fit_label_model(votes, labels)
    assert abs(model.rates[1][0] - 0.9) < 0.05 and abs(model.rates[0][0] - 0.1) < 0.05
    assert model.weights[1] < 0.75 * model.weights[0]  # the second and third voters are one
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.88


def test_lexicon_matches_whole_words_starts_and_ends():
    lexicon = toxicity.Lexicon((" bad ", " evi", "ful "))
    hits = lambda t: sorted(lexicon.entries[i] for i in lexicon.hits(t)[0])
    assert hits("Bad, evil!") == [" bad ", " evi"]
    assert hits("badly a bad") == [" bad "] and hits("hateful") == ["ful "] and hits("fully") == []
    assert lexicon.hits("evil evil")[1] == 2 and lexicon.hits(None)[1] == 0


@pytest.mark.parametrize("table", ["language", "quality", "toxicity"])
def test_awkward_and_empty_tables(spark, corpus, table):
    docs, labels = corpus
    run = {"language": lambda d, _: langid.language_table(d), "quality": quality.quality_table,
           "toxicity": toxicity.toxicity_table}[table]
    marks = labels.unionByName(spark.createDataFrame([(None, 1, 1), (2, None, None), (4, 1, 0), (4, 0, 1)], labels.schema))
    odd = awkward(spark)
    got = run(odd, marks).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    twins = [tuple(r) for r in got if r["doc_id"] == 8]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert run(odd.limit(0), marks.limit(0)).count() == 0
    assert run(odd, marks.limit(0)).count() == odd.count()


def test_filters_keep_columns(spark, corpus):
    docs, labels = corpus
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns and {r["doc_id"] % 7 for r in good.collect()} == set(range(1, 7))
    clean = toxicity.keep_clean(good, labels)
    assert clean.columns == docs.columns and all(r["doc_id"] % 5 != 1 for r in clean.collect())
    assert set(quality.keep_good(awkward(spark), labels).columns) == set(awkward(spark).columns)


def test_a_language_of_long_texts_only_is_learned(spark):
    rng = random.Random(12)
    words = {k: ["".join(rng.choice(v) for _ in range(6)) for _ in range(300)] for k, v in (("aa", "abcde"), ("xx", "vwxyz"))}
    rows = [(i, " ".join(rng.choice(words["aa"]) for _ in range(40)), "aa", "s") for i in range(40)]
    rows += [(100 + i, " ".join(rng.choice(words["xx"]) for _ in range(9_000)), "xx", "s") for i in range(8)]
    assert min(len(t) for _, t, g, _ in rows if g == "xx") > 60_000
    got = langid.language_table(documents(spark, rows)).collect()
    assert {(r["doc_id"] >= 100, r["lang_pred"]) for r in got} == {(False, "aa"), (True, "xx")}
    pairs = langid.word_pairs(rows[-1][1])
    assert len(pairs) == langid.SAMPLE_PAIRS and langid.word_pairs("b a b a") == {"b a": 2}
