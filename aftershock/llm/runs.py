"""Periodic runs of words by Baier's grouping.

A run is a stretch of words with smallest period q, at least ``exponent`` times
as long, that no neighbouring word extends.  For each text:

1. Words that occur less than ``exponent`` times in their stretch of the text
   can be in no run, so the text is cut at them until none is left; most texts
   leave nothing.
2. ``lyndon_lengths`` is phase one of Baier's suffix sorter on what is left.
   Suffixes are grouped by the Lyndon word that they start with, the highest
   group first; the suffixes before a finished group's members take these into
   their own words and move to higher groups.  A suffix's word is final when
   its group is finished, so the Lyndon array comes out directly: once for the
   order of the words and once for the reverse.
3. One of both holds each run's root.  A root is extended through the longest
   common extensions of its two copies to both sides; a root inside a run that
   is already known has nothing to add.

``collapse`` keeps of each run its first q words.

A text is worked on in one task: memory grows with the longest text only, and
time in proportion to the words, however a text repeats.

Defined results: a null text has no words; words are stretches without ASCII
white space; repeated rows are documents of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

EXPONENT = 4    # least length of a run, in periods
LEAST = 6       # and in words


def lyndon_lengths(text: list[int], size: int) -> list[int]:
    """Length of the longest Lyndon word at each place of numbers below ``size``.

    Places whose group is not finished are a linked list; the Lyndon word of a
    place goes on to the next place in the list.
    """
    n = len(text)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    group = list(text)
    members: list[list[int]] = [[] for _ in range(size)]
    for i, x in enumerate(text):
        members[x].append(i)
    held = [len(m) for m in members]
    lower, higher = list(range(-1, size - 1)), list(range(1, size + 1))
    lengths = [0] * n
    now = size - 1
    while now >= 0:
        taken: dict[int, dict[int, list[int]]] = {}   # group and count of members of this one that follow: places
        for i in members[now]:
            if group[i] != now:
                continue
            j = before[i]
            if j >= 0 and group[j] == now:
                continue   # its chain is followed from its first member
            k, count = i, 1
            end = after[k]
            lengths[k] = end - k
            while end < n and group[end] == now:
                k, count = end, count + 1
                end = after[k]
                lengths[k] = end - k
            if end < n:
                before[end] = j
            if j >= 0:
                after[j] = end
                old = group[j]
                if held[old] > 1:   # a place alone in its group needs no other
                    taken.setdefault(old, {}).setdefault(count, []).append(j)
        for old, by_count in taken.items():
            for count in sorted(by_count, reverse=True):
                places = by_count[count]
                if len(places) == held[old]:
                    break           # all that is left of the group grew alike
                held[old] -= len(places)
                new = len(members)
                members.append(places)
                held.append(len(places))
                for j in places:
                    group[j] = new
                above = higher[old]  # this group, or one that lies between
                lower.append(old)
                higher.append(above)
                higher[old] = new
                lower[above] = new
        now = lower[now]
    return lengths


def candidates(ids: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches (from, to) of numbers that each occur ``least`` times in their stretch, at least."""
    n = len(ids)
    keep = np.ones(n, dtype=bool)
    while True:
        edge = np.diff(keep.astype(np.int8), prepend=0, append=0)
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - begins >= max(least, 2)
        begins, ends = begins[long], ends[long]
        if not len(begins):
            return []
        which = np.repeat(np.arange(len(begins)), ends - begins)
        at = np.repeat(begins - np.concatenate([[0], np.cumsum(ends - begins)[:-1]]), ends - begins) + np.arange(len(which))
        # numbers counted within their stretch
        key = which * (int(ids.max()) + 1) + ids[at]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        ok = counts[inverse] >= least
        if ok.all():
            return list(zip(begins.tolist(), ends.tolist()))
        keep = np.zeros(n, dtype=bool)
        keep[at[ok]] = True


def _common(x: np.ndarray, i: int, j: int, end: int) -> int:
    """How far the words from i and those from j (after i) agree, up to ``end``."""
    done, step = 0, 16
    while j + done < end:
        m = min(step, end - j - done)
        other = np.flatnonzero(x[i + done:i + done + m] != x[j + done:j + done + m])
        if len(other):
            return done + int(other[0])
        done, step = done + m, 2 * step
    return done


def find_runs(ids: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers, in this order."""
    found = set()
    for a, b in candidates(ids, exponent):
        distinct, x = np.unique(ids[a:b], return_inverse=True)
        back, n = x[::-1], b - a
        for order in (x, len(distinct) - 1 - x):
            roots = np.array(lyndon_lengths(order.tolist(), len(distinct)), dtype=np.int64)
            at = np.flatnonzero(np.arange(n) + roots < n)
            at = at[x[at] == x[at + roots[at]]]    # the first root of a run is followed by its first word
            known: dict[int, int] = {}             # period: end of its last run
            for i, q in zip(at.tolist(), roots[at].tolist()):
                if known.get(q, 0) >= i + q:
                    continue
                end = i + q + _common(x, i, i + q, n)
                start = i - _common(back, n - i - q, n - i, n)
                if end - start >= 2 * q:
                    known[q] = end
                    if end - start >= max(least, exponent * q):
                        found.add((a + start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


Edit = Callable[[int | None, list[bytes]], list[bytes]]


def _texts(batches: Iterator[pd.DataFrame], exponent: int, least: int, edit: Edit | None):
    for pdf in batches:
        out = []
        for i, text in zip(pdf["i"], pdf["t"]):
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            i = None if pd.isna(i) else int(i)
            if edit:
                words = edit(i, words)
            number: dict[bytes, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
            runs = find_runs(ids, exponent, least)
            out.append((i, len(words), [{"start": s, "length": n, "period": q} for s, n, q in runs],
                        b" ".join(collapse(words, runs)).decode("utf-8", "surrogatepass")))
        yield pd.DataFrame(out, columns=["doc_id", "n_words", "runs", "collapsed"]).astype({"doc_id": "Int64"})


RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def run_texts(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST, doc_id: str = "doc_id", text: str = "text",
              edit: Edit | None = None) -> DataFrame:
    """doc_id, n_words, runs and the collapsed text of every document.

    ``exponent`` is 2 or more.  ``edit`` may change a document's words first.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"))
    return rows.mapInPandas(lambda it: _texts(it, exponent, least, edit), RUNS)


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One text in ten (by the crc32 of its id) repeats some words from some place on; none without an id."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def run_table(docs: DataFrame) -> DataFrame:
    """Runs of every document whose tail may repeat, as counts, the longest run and digests."""
    rows = run_texts(docs, edit=repeat_tail)
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = rows.withColumn("first", first)
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("first.start").alias("start"),
                       (-F.col("first.n")).alias("length"), F.col("first.period").alias("period"),
                       F.floor(1000 * -F.col("first.n") / F.col("first.period")).cast("long").alias("exponent_milli"),
                       F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
                       F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
