"""Toxicity by weak supervision.

1. Voters.  A lexicon is mined from a bounded sample of labelled texts: whole
   words, word beginnings and word endings that occur almost only in toxic
   texts; families of near copies count as about one text, else the words of a
   text with many copies would look toxic or clean by chance.  Its entries are dealt into many lexicon voters by kind and length;
   pattern voters look at shouting, exclamation marks and repeated hits.
   Every voter says 1 (toxic) or 0 of a text.
2. Label model.  A generative model of the votes of all sampled texts,
   labelled or not: a class prior, each voter's rate of saying 1 in either
   class, and the correlations between voters within a class.  It is fitted by
   expectation maximisation that starts from the labelled rows; a voter's
   log-odds are divided by its sum of absolute correlations, so that voters
   that repeat one another count once.
3. Classifier.  A logistic regression over the presence of lexicon entries
   and the votes learns the posterior labels, and scores every whole text.

Defined results: a null or empty text has no hits and gets the score of no
hits; null labels are no labels; without a toxic labelled row there is no
lexicon and every score is the prior.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import hash_sample, is_remainder, unit_hash

MAX_LABELLED = 20_000      # labelled texts of each class in the fitting sample, about
MAX_UNLABELLED = 10_000    # unlabelled texts in it, about
MAX_ENTRIES = 3_000        # lexicon entries
AFFIX = (3, 4, 5, 6, 7)    # lengths of word beginnings and endings
MIN_TEXTS = 5              # toxic texts that must hold an entry
MIN_ODDS = 30.0            # how many times as frequent it must be among toxic texts
THRESHOLD = 0.5
ROUNDS = 40
SEED = 37
LABEL_ODDS = 3.0           # log-odds that a given label adds to its row's posterior
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
MASK = (1 << 64) - 1

WORD = re.compile(r"[^\W\d_]+")


def keys_of(word: str) -> list[str]:
    """The entries that a word can match; a blank marks the word's edge."""
    n = len(word)
    return [f" {word} ", *(f" {word[:k]}" for k in AFFIX if k <= n), *(f"{word[-k:]} " for k in AFFIX if k <= n)]


def normalised(text: str | None) -> str:
    return f" {' '.join(WORD.findall((text or '').lower()))} "


# ---------------------------------------------------------------- lexicon


def fingerprints(text: str | None) -> tuple[int, ...]:
    """Least values of a few hashes of the text's runs of four words: near copies share most."""
    words = WORD.findall((text or "").lower())
    runs = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4])) for i in range(max(1, len(words) - 3))]
    return tuple(min((x * m) & MASK for x in runs) >> 1 for m in MULTIPLIERS)


def one_of_each_family(rows: DataFrame) -> DataFrame:
    """i and y of about one row of each family of near copies; ``rows`` has i, t and y."""
    names = [f"s{j}" for j in range(len(MULTIPLIERS))]

    def mark(batches):
        for pdf in batches:
            got = np.array([fingerprints(t) for t in pdf["t"]], dtype=np.int64).reshape(len(pdf), len(names))
            yield pd.DataFrame({"i": pdf["i"], "y": pdf["y"]} | {n: got[:, j] for j, n in enumerate(names)})

    marked = rows.mapInPandas(mark, f"i {rows.schema['i'].dataType.simpleString()}, y int, {', '.join(n + ' long' for n in names)}")
    for n in names:
        marked = marked.groupBy(n).agg(F.min(F.struct("i", "y", *(m for m in names if m != n))).alias("r")).select(n, "r.*")
    return marked.select("i", "y")


def _batch_counts(batches):
    """Texts that hold each key, counted within a batch."""
    for pdf in batches:
        for toxic, part in pdf.groupby("y"):
            found: Counter[str] = Counter()
            for text in part["t"]:
                words = set(WORD.findall((text or "").lower()))
                found.update({k for w in words for k in keys_of(w)})
            yield pd.DataFrame({"k": pd.Series(list(found), dtype=object), "y": int(toxic), "n": pd.Series(list(found.values()), dtype="int64")})


def mine_lexicon(sample: DataFrame) -> list[str]:
    """Entries that mark toxic texts, strongest first; ``sample`` has t and y (0, 1)."""
    counts = sample.mapInPandas(_batch_counts, "k string, y int, n long").groupBy("k").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not size.get(1):
        return []
    rate = ((F.col("a") + 0.1) / float(size[1] + 1)) / ((F.col("b") + 0.5) / float(size.get(0, 0) + 1))
    best = counts.where(F.col("a") >= MIN_TEXTS).withColumn("r", rate).where(F.col("r") >= MIN_ODDS)
    return [r["k"] for r in best.orderBy(F.desc("a"), F.desc("r"), "k").limit(MAX_ENTRIES).collect()]


class Lexicon:
    """Finds entries in a text and turns them into votes."""

    def __init__(self, entries: tuple[str, ...]):
        self.entries = entries
        self.automaton = ahocorasick.Automaton()
        for i, entry in enumerate(entries):
            self.automaton.add_word(entry, i)
        if entries:
            self.automaton.make_automaton()
        groups: dict[tuple[str, int], int] = {}
        self.voter_of = np.zeros(len(entries), dtype=np.int64)
        for i, entry in enumerate(entries):
            kind = "word" if entry[0] == entry[-1] == " " else "start" if entry[0] == " " else "end"
            self.voter_of[i] = groups.setdefault((kind, min(len(entry) // 2, 6)), len(groups))
        self.n_lexicons = len(groups)
        self.n_voters = self.n_lexicons + 4

    def hits(self, text: str | None) -> tuple[np.ndarray, int]:
        """Distinct entries found, and how many words hold one."""
        if not self.entries or not text:
            return np.zeros(0, dtype=np.int64), 0
        plain = normalised(text)
        found: set[int] = set()
        places = set()
        for end, i in self.automaton.iter(plain):
            found.add(i)
            entry = self.entries[i]
            places.add(plain.rfind(" ", 0, end) if entry[-1] == " " else end - len(entry) + 1)
        return np.array(sorted(found), dtype=np.int64), len(places)

    def votes(self, text: str | None, hits: np.ndarray, places: int) -> np.ndarray:
        votes = np.zeros(self.n_voters)
        votes[self.voter_of[hits]] = 1.0
        text = text or ""
        capitals = sum(w.isupper() and len(w) > 1 for w in text.split()) if text[:1] else 0
        n = max(1, text.count(" ") + 1)
        votes[self.n_lexicons] = places >= 1
        votes[self.n_lexicons + 1] = places >= 2
        votes[self.n_lexicons + 2] = capitals > 0.3 * n
        votes[self.n_lexicons + 3] = text.count("!") > 0.05 * n
        return votes


# ------------------------------------------------------------- label model


@dataclass(frozen=True)
class LabelModel:
    """Prior of class 1, each voter's rate in either class, and its weight."""

    prior: float
    rates: np.ndarray    # 2 x voters
    weights: np.ndarray  # voters, 1 / sum of absolute correlations within a class

    def posterior(self, votes: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """Probability of class 1; a given label counts as one more, strong voter."""
        one = np.log(self.rates[1] / self.rates[0])
        none = np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        odds = np.log(self.prior / (1 - self.prior)) + (votes * one + (1 - votes) * none) @ self.weights
        if labels is not None:
            odds = odds + np.where(labels >= 0, LABEL_ODDS * (2 * labels - 1), 0.0)
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -40, 40)))


def fit_label_model(votes: np.ndarray, labels: np.ndarray) -> LabelModel:
    """EM over all rows; ``labels`` has 0, 1 or -1 (none), and starts and steadies it."""
    known = labels >= 0
    p = np.where(known, np.clip(labels, 0, 1) * 0.98 + 0.01, 0.1)
    if known.any():
        p[~known] = np.clip(labels[known].mean(), 0.01, 0.99) * (votes[~known].sum(axis=1) > 0)
    model = None
    for _ in range(ROUNDS):
        mass = np.stack([1 - p, p])
        prior = float(np.clip((p.sum() + 1.0) / (len(p) + 2.0), 1e-4, 1 - 1e-4))
        rates = np.clip((mass @ votes + np.array([[0.05], [0.5]])) / (mass.sum(axis=1)[:, None] + 1.0), 1e-5, 1 - 1e-5)
        weights = 1.0 / _correlated(votes, mass, rates)
        new = LabelModel(prior, rates, weights)
        q = new.posterior(votes, labels)
        done = model is not None and np.abs(q - p).max() < 1e-4
        model, p = new, q
        if done:
            break
    return model


def _correlated(votes: np.ndarray, mass: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """For each voter, the sum of absolute correlations with all voters, itself included, averaged over the classes."""
    total = np.zeros(votes.shape[1])
    for k in (0, 1):
        centred = votes - rates[k]
        cov = (centred * mass[k][:, None]).T @ centred / max(mass[k].sum(), 1.0)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.clip(cov / np.outer(sd, sd), -1, 1)
        np.fill_diagonal(corr, 1.0)
        total += 0.5 * np.abs(corr).sum(axis=1)
    return np.maximum(total, 1.0)


# -------------------------------------------------------------- classifier


@dataclass(frozen=True)
class ToxicityModel:
    entries: tuple[str, ...]
    weights: np.ndarray  # of the entries, then of the voters
    bias: float
    label_model: LabelModel | None

    def score(self, text: str | None) -> float:
        lexicon = _lexicon(self.entries)
        hits, places = lexicon.hits(text)
        z = self.bias + self.weights[hits].sum() + self.weights[len(self.entries):] @ lexicon.votes(text, hits, places)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


@lru_cache(maxsize=4)
def _lexicon(entries: tuple[str, ...]) -> Lexicon:
    return Lexicon(entries)


def fit_linear(hits: list[np.ndarray], votes: np.ndarray, target: np.ndarray, n_entries: int,
               l2: float = 0.3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels: accelerated gradient steps over sparse rows.

    Each column's step is one over its bound of the curvature, so that rare
    entries learn as fast as common ones.
    """
    n = len(hits)
    rows = np.repeat(np.arange(n), [len(h) for h in hits])
    cols = np.concatenate([*hits, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    used = np.bincount(rows, minlength=n) + votes.sum(axis=1) + 1.0
    curve = 0.25 * np.concatenate([np.bincount(cols, weights=used[rows], minlength=n_entries), votes.T @ used]) + l2
    bias_curve = 0.25 * used.sum()
    w = v = np.zeros(n_entries + votes.shape[1])
    bias = v_bias = 0.0
    for t in range(steps):
        z = v_bias + np.bincount(rows, weights=v[cols], minlength=n) + votes @ v[n_entries:]
        err = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))) - target
        grad = np.concatenate([np.bincount(cols, weights=err[rows], minlength=n_entries), votes.T @ err]) + l2 * v
        new_w, new_bias = v - grad / curve, v_bias - err.sum() / bias_curve
        pull = t / (t + 3.0)
        v, v_bias = new_w + pull * (new_w - w), new_bias + pull * (new_bias - bias)
        w, bias = new_w, new_bias
    return w, float(bias)


def build_model(entries: tuple[str, ...], hits: list[np.ndarray], votes: np.ndarray, labels: np.ndarray) -> ToxicityModel:
    """Label model and classifier from the sampled texts' hits and votes; labels are 0, 1 or -1 (none)."""
    if not entries or not len(hits):
        known = labels[labels >= 0]
        rate = (known.sum() + 0.5) / (len(known) + 1.0)
        return ToxicityModel((), np.zeros(Lexicon(()).n_voters), float(np.log(rate / (1 - rate))), None)
    label_model = fit_label_model(votes, labels)
    w, bias = fit_linear(hits, votes, label_model.posterior(votes, labels), len(entries))
    return ToxicityModel(entries, np.round(w, 9), round(bias, 9), label_model)


# ------------------------------------------------------------------- Spark


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic") -> ToxicityModel:
    """Fit on hash samples of the labelled and the unlabelled rows of ``docs``.

    The caller leaves out held-out rows.  The driver gets the entries and, of
    each sampled text, its hits and votes; texts stay on the executors.
    """
    marks = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y"))
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))
    # at most about 2 x MAX_LABELLED ids: a broadcast of bounded size
    chosen = hash_sample(marks, F.col("y"), MAX_LABELLED, SEED, "i")
    labelled = rows.join(F.broadcast(chosen), "i").select("t", "y")
    n = rows.count()
    share = min(1.0, MAX_UNLABELLED / n) if n else 0.0
    others = rows.where(unit_hash(SEED + 1, "i") < share).join(marks.select("i"), "i", "left_anti")
    distinct = one_of_each_family(rows.join(F.broadcast(chosen), "i"))
    entries = tuple(mine_lexicon(rows.join(F.broadcast(distinct), "i").select("t", "y")))
    shared = docs.sparkSession.sparkContext.broadcast(entries)

    def look(batches):
        lexicon = _lexicon(shared.value)
        for pdf in batches:
            found = [lexicon.hits(t) for t in pdf["t"]]
            yield pd.DataFrame({"y": pdf["y"].to_numpy(), "h": [h.tolist() for h, _ in found],
                                "v": [lexicon.votes(t, h, p).tolist() for t, (h, p) in zip(pdf["t"], found)]})

    sample = labelled.union(others.select("t", F.lit(-1).alias("y"))).mapInPandas(look, "y int, h array<int>, v array<double>")
    got = sorted(sample.collect(), key=lambda r: (r["y"], r["h"], r["v"]))
    votes = np.array([r["v"] for r in got]).reshape(len(got), Lexicon(entries).n_voters)
    return build_model(entries, [np.array(r["h"], dtype=np.int64) for r in got], votes, np.array([r["y"] for r in got]))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """Probability that the text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def predict(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype=float)

    return predict(F.col(text))


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn outside the held-out fold (crc32 of the id mod 5 is 0), score every text."""
    held_out = is_remainder("doc_id", 5, 0)
    model = train(docs.where(~held_out), labels)
    out = docs.select("doc_id", held_out.alias("held_out"), score(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    model = train(docs.where(~is_remainder("doc_id", 5, 0)), labels)
    return docs.where(score(docs, model) < THRESHOLD)
