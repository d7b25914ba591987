"""Language identification by compression.

Every language has a zstandard raw-content dictionary made of word pairs from
a bounded sample of its labelled texts.  A text is encoded once with each
dictionary; the language whose dictionary gives the fewest bytes wins.  When
the two smallest sizes are close, the text is encoded again at a finer level,
and a text whose margin stays narrow is marked ``rejected`` (its best guess is
still given).

What is encoded are the distinct words of the whole text, lower-cased, in
order of first use and cut into blocks: repeats and symbols say nothing about
a language, and in one long frame a text's own matches would hide the
dictionary's.

Defined results: a null text, or one without a letter, is ``und`` with score
0 and is rejected; ties go to the smaller language name; without any labelled
row every text is ``und``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import hash_sample, is_remainder

SAMPLE_DOCS = 400           # labelled texts a language's dictionary is made from, about
SAMPLE_PAIRS = 2_000        # distinct word pairs taken from one of these texts, by their hash
DICTIONARY_BYTES = 128_000  # of each language
CHUNK_WORDS = 2             # words in a dictionary entry
BLOCK_BYTES = 3_000         # bytes encoded at once
LEVEL, FINE_LEVEL = 9, 12
NARROW = 0.01               # share of the smallest size under which a margin is narrow
BITS_PER_BYTE = 0.8         # weight of one byte of margin in the score
UNKNOWN = "und"
SEED = 11

LETTERS = re.compile(r"[^\W\d_]+")


def blocks(text: str) -> list[bytes]:
    """The text's distinct words as it is encoded; none if it has no letter."""
    words = dict.fromkeys(LETTERS.findall(text.lower()))
    data = f" {' '.join(words)} ".encode() if words else b""
    return [data[i:i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]


@dataclass(frozen=True)
class LanguageModel:
    """One raw-content dictionary per language, in order of the names."""

    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...] = field(repr=False)

    def compressors(self, level: int) -> list[zstandard.ZstdCompressor]:
        return _compressors(self.dictionaries, level)

    def sizes(self, parts: list[bytes], level: int = LEVEL) -> np.ndarray:
        return np.array([sum(len(c.compress(p)) for p in parts) for c in self.compressors(level)])

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """language, score, margin (share of the smallest size), rejected."""
        parts = blocks(text) if text else []
        if not parts or not self.languages:
            return UNKNOWN, 0.0, 0.0, True
        sizes = self.sizes(parts)
        if _margin(sizes) < NARROW:
            sizes = self.sizes(parts, FINE_LEVEL)
        best = int(sizes.argmin())
        score = 1.0 / float(np.exp2((sizes[best] - sizes) * BITS_PER_BYTE).sum())
        margin = _margin(sizes)
        return self.languages[best], score, margin, margin < NARROW


def _margin(sizes: np.ndarray) -> float:
    if len(sizes) < 2:
        return 1.0
    first, second = np.partition(sizes, 1)[:2]
    return float(second - first) / float(first)


@lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[bytes, ...], level: int) -> list[zstandard.ZstdCompressor]:
    """Kept for a worker's life: preparing a dictionary costs more than a text."""
    made = []
    for data in dictionaries:
        content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=level)
        made.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False,
                                             write_checksum=False, write_dict_id=False))
    return made


def word_pairs(text: str, at_most: int = SAMPLE_PAIRS) -> dict[str, int]:
    """Runs of ``CHUNK_WORDS`` words of the whole text and their counts; of more
    than ``at_most`` distinct ones those of the smallest hashes."""
    words = LETTERS.findall(text.lower())
    own = Counter(" ".join(words[i:i + CHUNK_WORDS]) for i in range(0, len(words), CHUNK_WORDS))
    if len(own) <= at_most:
        return own
    return {e: own[e] for e in sorted(own, key=lambda e: (zlib.crc32(e.encode()), e))[:at_most]}


def build_model(samples: dict[str, list[str]]) -> LanguageModel:
    """Dictionaries from sample texts by language."""
    counts: dict[str, Counter[str]] = {}
    for lang, texts in samples.items():
        own = counts.setdefault(lang, Counter())
        for text in texts:
            own.update(word_pairs(text))
    return model_of(counts)


def model_of(counts: dict[str, Counter[str]]) -> LanguageModel:
    """Dictionaries from the counts of word pairs by language.

    An entry is a run of ``CHUNK_WORDS`` words, kept for the language that has
    it most often: passages in a foreign language then teach nothing wrong.
    """
    most: dict[str, int] = {}
    for own in counts.values():
        for entry, n in own.items():
            most[entry] = max(most.get(entry, 0), n)
    shared = {}
    for own in counts.values():
        for entry, n in own.items():
            if n == most[entry]:
                shared[entry] = shared.get(entry, 0) + 1
    made = {}
    for lang, own in counts.items():
        entries = [e for e, n in own.items() if n == most[e] and shared[e] == 1]
        entries.sort(key=lambda e: (zlib.crc32(e.encode()), e))
        data = f" {' '.join(entries)} ".encode()[:DICTIONARY_BYTES]
        if len(data) > 8:  # zstandard takes no shorter content
            made[lang] = data
    names = tuple(sorted(made))
    return LanguageModel(names, tuple(made[n] for n in names))


def _pairs(batches):
    for pdf in batches:
        found = [word_pairs(t) for t in pdf["t"]]
        yield pd.DataFrame({"l": pdf["l"], "pairs": [list(f) for f in found], "counts": [list(f.values()) for f in found]})


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on a bounded hash sample of the labelled rows (``SAMPLE_DOCS`` a
    language, of any length), of each of which the executors send at most
    ``SAMPLE_PAIRS`` word pairs."""
    rows = labelled.select(F.col(doc_id).alias("i"), F.col(lang).alias("l"), F.col(text).alias("t"))
    rows = hash_sample(rows.where(F.col("l").isNotNull() & F.col("t").isNotNull()), F.col("l"), SAMPLE_DOCS, SEED, "i")
    counts: dict[str, Counter[str]] = {}
    for r in rows.select("l", "t").mapInPandas(_pairs, "l string, pairs array<string>, counts array<int>").collect():
        own = counts.setdefault(r["l"], Counter())
        for pair, n in zip(r["pairs"], r["counts"]):
            own[pair] += n
    return model_of(counts)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """A struct column: lang_pred, score, margin, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("lang_pred string, score double, margin double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts],
                            columns=["lang_pred", "score", "margin", "rejected"]).astype({"lang_pred": object})

    return predict(F.col(text))


def language_table(docs: DataFrame) -> DataFrame:
    """Learn outside the held-out fold (crc32 of the id mod 4 is 2), predict every text."""
    held_out = is_remainder("doc_id", 4, 2)
    model = train(docs.where(~held_out))
    out = docs.select("doc_id", held_out.alias("held_out"), identify(docs, model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.margin", "p.rejected")
