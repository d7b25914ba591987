"""Benchmark decontamination with an FM-index of each shard of documents.

``fm_shards`` packs the documents' words into shards of at most ``SHARD_WORDS``
words.  A shard's suffixes are sorted by prefix doubling; it keeps its
Burrows-Wheeler transform as a wavelet matrix of packed bits, its words, and
the positions of every ``SAMPLE``-th suffix.  The written table is the index.

``benchmark_phrases`` are the windows of ``WINDOW`` consecutive words of each
item (an item of fewer words is one window).  They go to the shards in blocks
of about ``BLOCK_BYTES``, so what is broadcast is bounded whatever the size of
the benchmark; each block reads the written index again.  In a shard, all
windows of a block are searched backwards at once through wavelet ranks, and
occurrences are located by stepping to the next sampled suffix.  Occurrences
are merged to removal spans, in a task for its shard and block, then for each
document.

A document longer than a shard is cut into pieces that overlap by a window
less one word, so that memory is bounded and no occurrence is lost.

Defined results: words are of lower-cased A-Z, digits and everything beyond
ASCII; a null text has none, and an item without words no window.  Repeated
rows are documents of their own.  An item without an id counts its words as
hit and is not named.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

WINDOW = 10
SAMPLE = 16
SHARD_WORDS = 700_000
BLOCK_BYTES = 8 << 20
BATCH_BYTES = 32 << 20    # of index rows that a Python worker gets at once

#: A-Z to a-z, all other ASCII but digits and letters to a space
FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))
UPPER, LOWER = (bytes(range(a, a + 26)).decode() for a in (65, 97))
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    """The UTF-8 words of a whole text."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling.

    Each document must end in a symbol that occurs nowhere else.  Only
    suffixes that still tie are sorted again.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    h = max(1, 62 // bits)
    key, padded = np.zeros(n, dtype=np.int64), np.concatenate([symbols, np.zeros(h, dtype=np.int64)])
    for k in range(h):
        key = (key << bits) | padded[k:k + n]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(starts, np.diff(starts, append=n))
    at = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(at):
        pos = order[at]
        key = rank[pos] * n + rank[pos + h]
        by = np.argsort(key)
        pos, key = pos[by], key[by]
        order[at] = pos
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(fresh)
        rank[pos] = np.repeat(at[starts], np.diff(starts, append=len(at)))
        at = at[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    return order


class Bits:
    """Bits with the number of ones before any place."""

    def __init__(self, packed: np.ndarray):
        self.words = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])

    @staticmethod
    def pack(bits: np.ndarray) -> np.ndarray:
        """64 bits a number and one number more, so that a rank at the end has one."""
        full = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        full[:len(bits)] = bits
        return np.packbits(full, bitorder="little").view("<u8")

    def ones(self, i: np.ndarray) -> np.ndarray:
        low = self.words[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[i >> 6] + np.bitwise_count(low)

    def at(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """Search and location in the words of some pieces of text."""

    def __init__(self, vocabulary: list[bytes], counts: np.ndarray, starts: np.ndarray, levels: np.ndarray,
                 zeros: np.ndarray, marks: np.ndarray, samples: np.ndarray):
        self.vocabulary, self.counts, self.starts = vocabulary, counts, starts
        self.zeros, self.samples = zeros, samples
        self.n = int(counts.sum())
        self.levels = [Bits(x) for x in levels]
        self.marks = Bits(marks)
        # rows before the first suffix that starts with a symbol, less the symbol's place at the last level
        symbols = np.arange(len(counts))
        self.shift = np.cumsum(counts) - counts - self.walk(np.zeros(len(counts), dtype=np.int64), symbols)

    @classmethod
    def build(cls, pieces: list[list[bytes]]) -> FMIndex:
        number: dict[bytes, int] = {}
        ids = [number.setdefault(w, len(number)) for piece in pieces for w in (*piece, None)]
        # a place for each word, and a separator after each piece
        separator = number.get(None, 0)
        flat = np.array(ids, dtype=np.int64)
        ends = np.flatnonzero(flat == separator) if pieces else np.zeros(0, dtype=np.int64)
        word = np.where(flat > separator, flat, flat + 1)   # 1, 2, ... in order of first use
        word[ends] = 0
        distinct = word + (len(ends) - 1)
        distinct[ends] = np.arange(len(ends))
        starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
        order = suffix_order(distinct)
        last = word[order - 1]    # at the first position this is the last separator
        listed = [w for w in number if w is not None]
        depth = max(1, len(listed).bit_length())
        levels, zeros = [], []
        now = last.astype(np.uint32)
        for b in reversed(range(depth)):
            one = (now >> np.uint32(b)) & np.uint32(1)
            levels.append(Bits.pack(one.astype(np.uint8)))
            one = one.astype(bool)
            now = np.concatenate([now[~one], now[one]])
            zeros.append(len(one) - int(one.sum()))
        first = np.zeros(len(flat), dtype=bool)
        first[starts] = True
        sampled = (order % SAMPLE == 0) | first[order]
        counts = np.bincount(word, minlength=len(listed) + 1)
        return cls(listed, counts, starts, np.array(levels, dtype="<u8").reshape(depth, -1), np.array(zeros, dtype=np.int64),
                   Bits.pack(sampled.astype(np.uint8)), order[sampled].astype(np.int32))

    def pack(self) -> dict[str, bytes]:
        """Columns of the written index."""
        whole = np.concatenate([x.words for x in self.levels])
        return {"vocabulary": zlib.compress(b" ".join(self.vocabulary), 1), "counts": self.counts.astype("<i4").tobytes(),
                "starts": self.starts.astype("<i4").tobytes(), "levels": whole.tobytes(), "zeros": self.zeros.astype("<i4").tobytes(),
                "marks": self.marks.words.tobytes(), "samples": self.samples.astype("<i4").tobytes()}

    @classmethod
    def unpack(cls, row) -> FMIndex:
        numbers = lambda x: np.frombuffer(x, dtype="<i4").astype(np.int64)
        zeros = numbers(row.zeros)
        return cls(zlib.decompress(row.vocabulary).split(), numbers(row.counts), numbers(row.starts),
                   np.frombuffer(row.levels, dtype="<u8").reshape(len(zeros), -1), zeros,
                   np.frombuffer(row.marks, dtype="<u8"), numbers(row.samples))

    def walk(self, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Places i followed through the levels as if they held the symbol."""
        for b, bits, zeros in zip(reversed(range(len(self.levels))), self.levels, self.zeros):
            ones = bits.ones(i)
            i = np.where((symbol >> b) & 1, zeros + ones, i - ones)
        return i

    def back(self, i: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that start one word earlier."""
        symbol = np.zeros(len(i), dtype=np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            ones, bit = bits.ones(i), bits.at(i)
            i = np.where(bit, zeros + ones, i - ones)
            symbol = symbol * 2 + bit
        return self.shift[symbol] + i

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur (their numbers), and first and last row of each.

        ``phrases`` holds symbols, filled with zeros on the left; -1 is a word
        that the shard lacks.
        """
        which = np.flatnonzero((phrases >= 0).all(axis=1))
        low, high = np.zeros(len(which), dtype=np.int64), np.full(len(which), self.n, dtype=np.int64)
        for column in reversed(range(phrases.shape[1])):
            symbol = phrases[which, column]
            more = symbol > 0
            low = np.where(more, self.shift[symbol] + self.walk(low, symbol), low)
            high = np.where(more, self.shift[symbol] + self.walk(high, symbol), high)
            live = low < high
            which, low, high = which[live], low[live], high[live]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in the given rows."""
        out, left = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        rows, steps = rows.copy(), 0
        while len(left):
            known = self.marks.at(rows)
            out[left[known]] = self.samples[self.marks.ones(rows[known])] + steps
            left, rows = left[~known], self.back(rows[~known])
            steps += 1
        return out


INDEX = ("rows array<long>, doc_ids array<long>, n_words array<long>, piece_rows array<long>, piece_offsets array<int>, "
         "vocabulary binary, counts binary, starts binary, levels binary, zeros binary, marks binary, samples binary")


def _shards(batches, size: int, overlap: int):
    """Index rows of a task's documents."""
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    shard = {"rows": [], "doc_ids": [], "n_words": [], "piece_rows": [], "piece_offsets": []}
    pieces, held = [], 0

    def done():
        return pd.DataFrame([shard | FMIndex.build(pieces).pack()])

    for pdf in batches:
        for i, text in zip(pdf["i"], pdf["t"]):
            words = words_of(text)
            shard["rows"].append(row)
            shard["doc_ids"].append(None if pd.isna(i) else int(i))
            shard["n_words"].append(len(words))
            at = 0
            while at < len(words):
                take = min(len(words) - at, max(size - held, 2 * overlap + 1))
                pieces.append(words[at:at + take])
                shard["piece_rows"].append(row)
                shard["piece_offsets"].append(at)
                held += take
                at = len(words) if at + take == len(words) else at + take - overlap
                if held >= size:
                    yield done()
                    shard, pieces, held = {k: [] for k in shard}, [], 0
            row += 1
    if shard["rows"] or pieces:
        yield done()


def fm_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
              size: int = SHARD_WORDS) -> DataFrame:
    """The written index: a row for each shard, good for phrases of up to ``window`` words."""
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    return materialize(rows.mapInPandas(lambda it: _shards(it, size, window - 1), INDEX), "fm-index")


def words_column(text: str | Column) -> Column:
    """The words of a text as an array of strings (null: none)."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(F.translate(col, UPPER, LOWER), F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def benchmark_phrases(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct phrase (words and spaces) and item (string, or null)."""
    w = words_column(text)
    rows = items.select(F.col(item_id).cast("string").alias("item"), w.alias("w")).where(F.size("w") > 0)
    firsts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    rows = rows.select("item", "w", F.explode(firsts).alias("first"))
    return rows.select(F.concat_ws(" ", F.slice("w", F.col("first"), window)).alias("phrase"), "item").distinct()


class Phrases:
    """A block of phrases as numbers, with the items of each."""

    def __init__(self, pairs: list[tuple[str, str | None]]):
        number: dict[str, int] = {}
        items: dict[str, int] = {}
        own = [(number.setdefault(p, len(number)), items.setdefault(i, len(items))) for p, i in pairs if i is not None]
        for p, _ in pairs:
            number.setdefault(p, len(number))
        self.pairs = np.array(sorted(own), dtype=np.int64).reshape(-1, 2)
        self.items = list(items)
        phrases = [p.encode("utf-8", "surrogatepass").split() for p in number]
        self.lengths = np.array([len(p) for p in phrases], dtype=np.int64)
        words: dict[bytes, int] = {}
        self.matrix = np.zeros((len(phrases), int(self.lengths.max(initial=1))), dtype=np.int64)
        for k, p in enumerate(phrases):
            self.matrix[k, self.matrix.shape[1] - len(p):] = [words.setdefault(w, len(words) + 1) for w in p]
        self.words = list(words)

    def hits(self, index: FMIndex):
        """Per piece that is hit: its number, spans (from, to) in it, and the items."""
        known = {w: k for k, w in enumerate(index.vocabulary, 1)}
        symbols = np.array([0, *(known.get(w, -1) for w in self.words)], dtype=np.int64)
        which, low, high = index.search(symbols[self.matrix])
        counts = high - low
        first = np.cumsum(counts) - counts
        rows = np.repeat(low - first, counts) + np.arange(int(counts.sum()))
        which = np.repeat(which, counts)
        at = index.locate(rows)
        change = np.bincount(at, minlength=index.n + 1) - np.bincount(at + self.lengths[which], minlength=index.n + 1)
        inside = np.concatenate([[0], (np.cumsum(change) > 0).astype(np.int8)])
        begins, ends = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
        piece_of = lambda x: np.searchsorted(index.starts, x, side="right") - 1
        met = np.unique(piece_of(at) * len(self.lengths) + which)   # pieces and the phrases that they hold
        piece, phrase = met // max(len(self.lengths), 1), met % max(len(self.lengths), 1)
        a, b = (np.searchsorted(self.pairs[:, 0], phrase, side=s) for s in ("left", "right"))
        span_piece = piece_of(begins)
        begins, ends = begins - index.starts[span_piece], ends - index.starts[span_piece]
        cuts, held = (np.searchsorted(x, np.unique(span_piece)) for x in (span_piece, piece))
        for p, s, t, u, v in zip(np.unique(span_piece), cuts, np.append(cuts[1:], len(span_piece)), held, np.append(held[1:], len(piece))):
            of = sorted({int(x) for i, j in zip(a[u:v], b[u:v]) for x in self.pairs[i:j, 1]})
            yield int(p), begins[s:t], ends[s:t], [self.items[x] for x in of]


@lru_cache(maxsize=1)
def _phrases(block) -> Phrases:
    return Phrases(block.value)


FOUND = "row long, spans array<struct<start: int, end: int>>, items array<string>"


def _found(batches, block):
    for pdf in batches:
        for shard in pdf.itertuples(index=False):
            out = []
            for p, begins, ends, items in _phrases(block).hits(FMIndex.unpack(shard)):
                offset = shard.piece_offsets[p]
                out.append({"row": shard.piece_rows[p], "items": items,
                            "spans": [{"start": int(x + offset), "end": int(y + offset)} for x, y in zip(begins, ends)]})
            yield pd.DataFrame(out, columns=["row", "spans", "items"])


def _merged(spans: Column) -> Column:
    """Sorted spans, those that meet or overlap as one."""
    nothing = F.array().cast("array<struct<start: int, end: int>>")

    def add(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), nothing, add)


def removal_spans(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (words from ``start`` to before ``end``) and items of every document."""
    spark = index.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    phrases = materialize(phrases, "phrases")
    size = phrases.agg(F.sum(F.octet_length("phrase") + F.lit(64))).first()[0] or 0
    n_blocks = -(-size // BLOCK_BYTES)
    shards = index.select("piece_rows", "piece_offsets", "vocabulary", "counts", "starts", "levels", "zeros", "marks", "samples")
    found = spark.createDataFrame([], FOUND)
    for b in range(n_blocks):
        # dealt by a hash to about BLOCK_BYTES each, so that a bounded part goes through the driver at once
        own = phrases.where(F.pmod(F.xxhash64("phrase", "item"), F.lit(n_blocks)) == b)
        block = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])
        found = found.union(shards.mapInPandas(lambda it, block=block: _found(it, block), FOUND))
    # a document has a row for each block and piece
    found = found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    docs = index.select(F.explode(F.arrays_zip("rows", "doc_ids", "n_words")).alias("d")).select(
        F.col("d.rows").alias("row"), F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<start: int, end: int>>"))
    return docs.join(found, "row", "left").select(
        "doc_id", "n_words", _merged(spans).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontamination_table(docs: DataFrame, items: DataFrame) -> DataFrame:
    """What the benchmark has in common with every document."""
    found = removal_spans(fm_shards(docs), benchmark_phrases(items))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))


ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORDS}'), []) AS w
  FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORDS}') AS w
  FROM benchmark WHERE text IS NOT NULL),
p AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS k, array_to_string(w[i:i + {WINDOW} - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM p),
s AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
f AS (SELECT s.r, s.i, s.k, p.item FROM s JOIN p USING (k, phrase)),
h AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM f) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
