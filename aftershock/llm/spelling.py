"""Groups of spelling variants by PartEnum signatures.

1. ``word_counts``: the words of all texts are counted in the Python workers,
   a block at a time, and the counts summed.
2. Two words one inserted, deleted or replaced letter apart have letter
   multisets that, as binary vectors, differ in at most ``DISTANCE`` = 2
   places, which belong to at most two letters.  PartEnum: the letters are
   partitioned into ``PARTS`` parts; at least one of these agrees up to
   ``DISTANCE_IN_PART`` letters.  Each is partitioned into ``SUBPARTS``, and
   every choice of all but ``DISTANCE_IN_PART`` of them gives a signature: the
   word's sorted letters in it.  Near words agree in at least one signature.
   Letters are dealt to the subparts so that each holds about as many letters
   of the counted words.
3. Words meet in an equi-join on a hash of the signature.  Since one edit leaves the
   first or the last half of the shorter word as it was, the join also asks for
   the half: words of the same letters in other orders, of which there may be
   any number, do not meet.  What meets is verified by edit distance.
4. A word's form is its most frequent near word, if at least ``RATIO`` times as
   frequent; forms of forms are followed by doubling steps.

Exact: no signature, group or partner is capped.

Defined results: null texts have no words; an edit by id does not happen
without an id; repeated rows count again.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

LEAST_LETTERS = 5
LEAST_COUNT = 3
RATIO = 2
DISTANCE = 2
PARTS, SUBPARTS = 2, 3
DISTANCE_IN_PART = (DISTANCE + 1 + PARTS - 1) // PARTS - 1
BLOCK_WORDS = 200_000    # distinct words that a worker counts before it hands them on

LETTERS = "".join(map(chr, [*range(97, 123), *range(0xC0, 0x100)]))
#: of Latin-1: letters, A-Z as a-z, and a space for all else
FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 0xC0 else 32 for x in range(256))

Edit = Callable[[int | None, bytes], bytes]


def words_of(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, in Latin-1, A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(FOLD).split()


def _count(batches, least: int, edit: Edit | None):
    total: Counter[bytes] = Counter()

    def block():
        words = [w.decode("latin-1") for w in total]
        return pd.DataFrame({"word": words, "n": list(total.values())})

    for pdf in batches:
        for i, text in zip(pdf["i"], pdf["t"]):
            if not text:
                continue
            own = Counter(words_of(text))
            i = None if pd.isna(i) else int(i)
            for word, n in own.items():
                word = edit(i, word) if edit else word
                if len(word) >= least:
                    total[word] += n
        if len(total) >= BLOCK_WORDS:
            yield block()
            total.clear()
    if total:
        yield block()


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, doc_id: str = "doc_id", text: str = "text",
                edit: Edit | None = None) -> DataFrame:
    """word and n, its occurrences in all whole texts; ``edit`` may change a document's word first."""
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    counted = rows.mapInPandas(lambda it: _count(it, least_letters, edit), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def subparts(words: DataFrame, parts: int = PARTS, each: int = SUBPARTS) -> list[list[str]]:
    """The letters of each subpart, by part: in order of frequency, each to the subpart with the fewest so far."""
    seen = words.select(F.explode(F.split("word", "")).alias("x")).where("x != ''").groupBy("x").agg(F.count("*").alias("n"))
    counts = {r["x"]: r["n"] for r in seen.collect()}   # at most a row for each of LETTERS
    held, letters = [0] * (parts * each), [""] * (parts * each)
    for x in sorted(LETTERS, key=lambda x: (-counts.get(x, 0), x)):
        k = min(range(parts * each), key=lambda k: (held[k], len(letters[k]), k))
        held[k] += counts.get(x, 0)
        letters[k] += x
    return [letters[p * each:(p + 1) * each] for p in range(parts)]


def signatures(word: Column, letters: list[list[str]]) -> list[Column]:
    """A word's signatures, numbered: its sorted letters in the chosen subparts."""
    every = "".join("".join(part) for part in letters)
    in_order = F.array_join(F.array_sort(F.split(word, "")), "")
    out = []
    for part in letters:
        for dropped in combinations(part, DISTANCE_IN_PART):
            kept = set("".join(part)) - set("".join(dropped))
            others = "".join(x for x in every if x not in kept)
            out.append(F.concat_ws(":", F.lit(str(len(out))), F.translate(in_order, others, "")))
    return out


def near_words(words: DataFrame, letters: list[list[str]]) -> DataFrame:
    """a and b: all pairs of words (each way round) that one edit of a letter turns into each other."""
    length = F.length("word")
    keyed = words.select("word", length.alias("l"), F.explode(F.array(*signatures(F.col("word"), letters))).alias("s"))
    # the shorter word's length is this word's or one less; one half of the shorter word is left as it was
    halves = F.array(*(F.struct(F.expr(f"l - {less}").alias("m"), F.lit(side).alias("side"), F.expr(half).alias("half"))
                       for less in (0, 1)
                       for side, half in (("first", f"left(word, int((l - {less}) / 2))"),
                                          ("last", f"right(word, l - {less} - int((l - {less}) / 2))"))))
    keyed = keyed.select("word", "l", "s", F.explode(halves).alias("h"))
    # words meet by a hash of signature and half: short keys to shuffle and sort; what it throws together is verified
    keyed = keyed.select("word", "l", "h.m", F.xxhash64("s", "h.m", "h.side", "h.half").alias("key"))
    a = keyed.where("l = m").select(F.col("word").alias("a"), "key")
    b = keyed.select(F.col("word").alias("b"), (F.col("l") > F.col("m")).alias("longer"), "key")
    met = a.join(b.hint("merge"), "key")
    met = met.where((F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    pairs = materialize(met.select("a", "b").distinct(), "near-words")
    return pairs.union(pairs.select("b", "a"))


def forms(words: DataFrame, near: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Words with n_near, form and form_n."""
    counted = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    best = near.join(counted, "b").groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    rows = words.join(best, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                       F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))


def roots(rows: DataFrame) -> DataFrame:
    """word and root: the last of its form, that one's form, and so on.

    Counts grow along the way, so there is no circle; each step doubles how
    far a word has been followed.
    """
    now = materialize(rows.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        onward = now.where("word != root").select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.where("word != root").select("root").join(onward, "root", "semi").isEmpty():
            return now
        now = materialize(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO,
                      edit: Edit | None = None) -> DataFrame:
    """word, form, root, n, n_near and form_n of every counted word."""
    words = materialize(word_counts(docs, least_letters, edit=edit).where(F.col("n") >= least_count), "words")
    rows = materialize(forms(words, near_words(words, subparts(words)), ratio), "forms")
    return rows.join(roots(rows), "word").select("word", "form", "root", "n", "n_near", "form_n")


def misspell(doc_id: int | None, word: bytes) -> bytes:
    """One word of a document in 97 (by the crc32 of id and word) loses a letter; none without an id."""
    if doc_id is None:
        return word
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), zlib.crc32(b"%d:" % doc_id))
    k = h % len(word)
    return word if h % 97 else word[:k] + word[k + 1:]


def spelling_table(docs: DataFrame) -> DataFrame:
    """Spelling variants among the words of all documents, some of which lose a letter."""
    return spelling_variants(docs, edit=misspell)


def _crc_table() -> list[int]:
    """The crc32 of one byte, for each byte."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(c)
    return out


#: near words by the patterns that a replaced or a deleted letter leaves
ORACLE_SQL = f"""
WITH RECURSIVE o AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\u00C0-\u00FF]+')) AS run
  FROM documents),
u AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id::VARCHAR || ':' || run)) AS x FROM o GROUP BY doc_id, run),
c AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(range(1, len(x), 2), lambda k: ('0x' || substr(x, k, 2))::BIGINT)),
           lambda h, b: xor(list_extract({_crc_table()}::BIGINT[], xor(h, b) % 256 + 1), h // 256))) AS h
  FROM u),
e AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % len(run))::INT) || substr(run, (h % len(run))::INT + 2) ELSE run END AS word, n
  FROM c),
w AS (SELECT word, sum(n)::BIGINT AS n FROM e WHERE len(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
p AS (SELECT word, unnest(range(1, len(word) + 1)) AS i FROM w),
g AS (SELECT DISTINCT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM p),
r AS (SELECT x.word AS a, y.word AS b FROM g x JOIN g y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word),
s AS (SELECT DISTINCT g.word AS a, w.word AS b FROM g JOIN w ON w.word = g.a || g.z),
m AS (SELECT a, b FROM r UNION SELECT a, b FROM s UNION SELECT b, a FROM s),
t AS (
  SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k
  FROM m JOIN w ON w.word = m.b),
f AS (
  SELECT w.word, w.n, coalesce(t.n_near, 0)::BIGINT AS n_near,
         CASE WHEN t.n >= {RATIO} * w.n THEN t.b END AS form, CASE WHEN t.n >= {RATIO} * w.n THEN t.n END AS form_n
  FROM w LEFT JOIN t ON t.a = w.word AND t.k = 1),
q AS (
  SELECT word, word AS root, form AS onward FROM f
  UNION ALL
  SELECT q.word, f.word, f.form FROM q JOIN f ON f.word = q.onward)
SELECT f.word, f.form, q.root, f.n, f.n_near, f.form_n
FROM f JOIN q ON q.word = f.word AND q.onward IS NULL
"""
