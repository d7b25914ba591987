"""Entity resolution of company names.

* exact: equal normalised names; the first directory row (by position) of a
  normalised name wins -> score 100, ``exact_normalized``, ``auto_ok``;
* fuzzy: for names without exact hit, the best directory name; ties -> the
  larger string.  ``method="blocks"`` (the default) scores by the matching-block
  ratio ``round(100 * 2M / (la + lb))`` of ``difflib``, ``"levenshtein"`` by
  ``round(100 * (1 - levenshtein / max_len))``.  Candidates come from q-gram
  *prefix filtering*: every name keeps only its rarest ``K*q + 1`` q-grams, and
  two names are compared only if their prefixes share a gram.  K bounds the
  edits of any pair at the threshold: M matched characters leave
  ``la + lb - 2M`` to insert or delete, at most ``(1 - t)(la + lb)``.  By the
  q-gram count lemma every pair scoring >= threshold shares a prefix gram, so
  matches at or above the threshold are exactly those of an exhaustive search,
  while no all-pairs product of a common gram is ever formed.  A name without
  such a match gets the best name of the whole directory, for review: the best
  of those that hold one of its ``REVIEW_GRAMS`` rarest q-grams sets a mark, and
  every directory name that could reach it is scored too.  Such a name's bound
  is that of the shared letters (blocks) or the lengths (Levenshtein); below the
  threshold a pair need not share a q-gram, so no prefix would be exact.  A name
  that scores 0 with all of the directory stays unmatched.
* overrides: the last override per name replaces a mapped row (score 999,
  ``manual_override``, ``manual_ok``) or is appended when the name is new.
"""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from aftershock.functions.constants import EXACT_MATCH_SCORE, FUZZY_THRESHOLD, OVERRIDE_SCORE
from aftershock.functions.text import normalize_company_name
from aftershock.operators.dedup import first_by
from aftershock.session import materialize, ship_package

MAPPING_COLUMNS = ["orbis_company_name", "normalized_orbis_name", "matched_sec_name", "ticker", "cik",
                   "match_score", "match_method", "review_flag"]
Q = 3
REVIEW_GRAMS = 8
FIRM_BLOCK, NAME_BLOCK = 64, 2048  # names in a block of the search below the threshold


def prepare_directory(directory: DataFrame, name: str = "sec_company_name", pos: str = "pos") -> DataFrame:
    """Directory rows with normalised names, ticker upper/trim, cik as text."""
    return directory.select(F.col(name).alias("sec_company_name"),
                            F.upper(F.trim(F.col("ticker").cast("string"))).alias("ticker"),
                            F.col("cik").cast("string").alias("cik"), F.col(pos).alias("pos"),
                            normalize_company_name(F.col(name)).alias("norm"))


def prepare_firms(firms: DataFrame, name: str = "orbis_company_name", pos: str = "pos") -> DataFrame:
    """Distinct firm names (first occurrence kept) with normalised names."""
    f = firms.where(F.col(name).isNotNull()).select(F.col(name).alias("orbis_company_name"), F.col(pos).alias("pos"))
    f = first_by(f, ["orbis_company_name"], [("pos", False)])
    return f.withColumn("normalized_orbis_name", normalize_company_name("orbis_company_name"))


def _first_per_norm(d: DataFrame) -> DataFrame:
    return first_by(d.select("norm", "pos", "sec_company_name", "ticker", "cik"), ["norm"], [("pos", False)])


def exact_matches(firms: DataFrame, directory: DataFrame) -> DataFrame:
    best = _first_per_norm(directory)
    j = firms.join(best, firms.normalized_orbis_name == best.norm)
    return j.select("orbis_company_name", "normalized_orbis_name", F.col("sec_company_name").alias("matched_sec_name"),
                    "ticker", "cik", F.lit(EXACT_MATCH_SCORE).alias("match_score"),
                    F.lit("exact_normalized").alias("match_method"), F.lit("auto_ok").alias("review_flag"))


def _max_edits(length, threshold: int, method: str):
    """Largest edit count K any partner may need to score >= threshold
    against a name of this length.  Levenshtein: lev <= (1 - (t - 0.5)/100) * m
    and m <= len / (t - 0.5) * 100.  Blocks: the partner is at most
    (2 - t) / t times as long, which makes (1 - t)(la + lb) at most twice as much."""
    slack = 1 - (threshold - 0.5) / 100.0
    factor = slack / (1 - slack) * (2 if method == "blocks" else 1)
    return F.floor(F.lit(factor) * length + F.lit(1e-9)).cast("int")


def _grams(df: DataFrame, id_col: str, text: str) -> DataFrame:
    n = F.length(text)
    g = df.select(id_col, text, F.explode(F.sequence(F.lit(1), F.greatest(n - Q + 1, F.lit(0)))).alias("_i")) \
        .where(F.length(text) >= Q)
    g = g.withColumn("gram", F.substring(text, F.col("_i"), Q))
    # occurrence number makes repeated grams distinct (multiset semantics)
    occ = W.partitionBy(id_col, "gram").orderBy("_i")
    return g.withColumn("gram", F.concat(F.col("gram"), F.lit("#"), F.row_number().over(occ).cast("string")))


def _prefixes(names: DataFrame, text: str, doc_freq: DataFrame, threshold: int, method: str) -> DataFrame:
    g = _grams(names, text, text)
    g = g.join(doc_freq, "gram")
    k = _max_edits(F.length(text), threshold, method)
    rank = W.partitionBy(text).orderBy("df", "gram")  # one name's grams: bounded by its length
    return (g.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= k * Q + 1)
            .select(text, "gram"))


def _block_ratios(batches):
    """score: which directory name is best; shown: the score that is reported.
    The ratio depends on the order of its two texts; the best name is searched
    with the firm's name second and scored with it first."""
    for pdf in batches:
        best, shown = [], []
        search = SequenceMatcher(None)
        for fn, dn in zip(pdf["fn"], pdf["dn"]):
            if search.b != fn:
                search.set_seq2(fn)
            search.set_seq1(dn)
            best.append(search.ratio())
            shown.append(int(round(100 * SequenceMatcher(None, fn, dn).ratio())))
        yield pdf.assign(score=best, shown=shown)


def _scored(pairs: DataFrame, method: str) -> DataFrame:
    if method == "blocks":
        ship_package(pairs.sparkSession)
        return pairs.mapInPandas(_block_ratios, "fn string, dn string, score double, shown int")
    m = F.greatest(F.length("fn"), F.length("dn"))
    score = F.bround(F.lit(100.0) * (F.lit(1.0) - F.levenshtein("fn", "dn") / m), 0).cast("int")
    return pairs.withColumn("score", score.cast("double")).withColumn("shown", score)


def _best(scored: DataFrame) -> DataFrame:
    return scored.groupBy("fn").agg(F.max(F.struct("score", "dn", "shown")).alias("b")) \
        .select("fn", F.col("b.shown").alias("match_score"), F.col("b.dn").alias("dn"))


def _letters(names, alphabet: dict[str, int]):
    import numpy as np
    counts = np.zeros((len(names), len(alphabet) + 1), dtype=np.int32)
    for i, name in enumerate(names):
        for c in name:
            if c in alphabet:
                counts[i, alphabet[c]] += 1
    return counts


def _reach_marks(batches):
    """Per firm name of a block, the best directory name of another block whose
    score reaches the firm's mark.  Names are scored by falling bound, twice the
    letters shared over both lengths, until no bound reaches the best so far."""
    import numpy as np
    import pandas as pd
    for pdf in batches:
        rows = []
        for firms, names in zip(pdf["firms"], pdf["names"]):
            alphabet = {c: k for k, c in enumerate(sorted({c for f in firms for c in f["fn"]}))}
            held, size = _letters(names, alphabet), np.array([len(n) for n in names])
            for f in firms:
                fn, best = f["fn"], (f["mark"], "")
                shared = np.minimum(held, _letters([fn], alphabet)).sum(axis=1)
                bound = 2.0 * shared / np.maximum(size + len(fn), 1)
                able = np.flatnonzero((bound >= best[0]) & (shared > 0))
                search = SequenceMatcher(None, "", fn)
                for i in able[np.argsort(-bound[able], kind="stable")]:
                    if bound[i] < best[0]:
                        break
                    search.set_seq1(names[i])
                    best = max(best, (search.ratio(), names[i]))
                if best[1]:
                    rows.append((fn, best[1], best[0], int(round(100 * SequenceMatcher(None, fn, best[1]).ratio()))))
        yield pd.DataFrame(rows, columns=["fn", "dn", "score", "shown"])


def _blocks(names: DataFrame, value, size: int, name: str) -> tuple[DataFrame, int]:
    """Rows dealt by the hash of their first column to blocks of about ``size``."""
    n = -(-names.count() // size)
    block = F.pmod(F.xxhash64(names.columns[0]), F.lit(max(n, 1)))
    return names.groupBy(block.alias("_b")).agg(F.collect_list(value).alias(name)).drop("_b"), n


def best_of_all(fnames: DataFrame, dnames: DataFrame, near: DataFrame, method: str) -> DataFrame:
    """The best of all directory names for each firm name, by an exact search
    above the mark that the scored pairs ``near`` set."""
    marks = near.groupBy("fn").agg(F.max("score").alias("mark"))
    marked = fnames.join(marks, "fn", "left").select("fn", F.coalesce("mark", F.lit(0.0)).alias("mark"))
    marked = materialize(marked, "marks")
    if method != "blocks":
        la, lb = F.length("fn"), F.length("dn")
        reach = F.bround(F.lit(100.0) * F.least(la, lb) / F.greatest(la, lb), 0) >= F.col("mark")
        return _best(_scored(marked.crossJoin(dnames).where(reach).select("fn", "dn"), method).where("score > 0"))
    ship_package(fnames.sparkSession)
    firms, nf = _blocks(marked, F.struct("fn", "mark"), FIRM_BLOCK, "firms")
    names, nd = _blocks(dnames.select("dn"), F.col("dn"), NAME_BLOCK, "names")
    pairs = firms.repartition(max(min(nf, 8), nf // 8, 1)).crossJoin(names.repartition(max(-(-nd // 8), 1)))
    return _best(pairs.mapInPandas(_reach_marks, "fn string, dn string, score double, shown int"))


def fuzzy_matches(firms: DataFrame, directory: DataFrame, threshold: int = FUZZY_THRESHOLD,
                  suggest_below_threshold: bool = True, method: str = "blocks") -> DataFrame:
    """Best directory name per firm name (firms without exact hit only)."""
    dnames = directory.select(F.col("norm").alias("dn")).distinct()
    fnames = firms.select(F.col("normalized_orbis_name").alias("fn")).distinct()
    df_all = (_grams(dnames, "dn", "dn").select("gram").unionByName(_grams(fnames, "fn", "fn").select("gram"))
              .groupBy("gram").agg(F.count(F.lit(1)).alias("df")))
    fp = _prefixes(fnames, "fn", df_all, threshold, method)
    dp = _prefixes(dnames, "dn", df_all, threshold, method)
    cand = fp.join(dp.hint("merge"), "gram").select("fn", "dn").distinct()  # both exploded
    best = _best(_scored(cand, method).where(F.col("shown") >= threshold))
    if suggest_below_threshold:
        best = materialize(best, "matches")
        rest = fnames.join(best.select("fn"), "fn", "left_anti")
        held = _grams(dnames, "dn", "dn").select("gram", "dn")
        often = held.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
        rarest = W.partitionBy("fn").orderBy("df", "gram")  # one name's grams: bounded by its length
        few = _grams(rest, "fn", "fn").join(often, "gram").withColumn("_r", F.row_number().over(rarest)) \
            .where(F.col("_r") <= REVIEW_GRAMS).select("fn", "gram")
        near = few.join(held.hint("merge"), "gram").select("fn", "dn").distinct()
        best = best.unionByName(best_of_all(rest, dnames, _scored(near, method), method))
    drow = _first_per_norm(directory).withColumnRenamed("norm", "dn")
    j = (firms.join(best, firms.normalized_orbis_name == best.fn, "left").join(drow, "dn", "left"))
    found = F.col("match_score").isNotNull()
    return j.select(
        "orbis_company_name", "normalized_orbis_name", F.col("sec_company_name").alias("matched_sec_name"),
        "ticker", "cik", "match_score",
        F.when(found, F.lit("fuzzy")).otherwise(F.lit("unmatched")).alias("match_method"),
        F.when(~found, F.lit("unmatched")).when(F.col("match_score") >= threshold, F.lit("auto_ok"))
        .otherwise(F.lit("review")).alias("review_flag"))


def match_names(firms: DataFrame, directory: DataFrame, threshold: int = FUZZY_THRESHOLD,
                suggest_below_threshold: bool = True, method: str = "blocks") -> DataFrame:
    """Exact matches, then fuzzy for the remainder (anti-join between)."""
    exact = exact_matches(firms, directory)
    rest = firms.join(exact.select("orbis_company_name"), "orbis_company_name", "left_anti")
    return exact.unionByName(fuzzy_matches(rest, directory, threshold, suggest_below_threshold, method)) \
        .select(*MAPPING_COLUMNS)


def apply_overrides(mapping: DataFrame, overrides: DataFrame, directory: DataFrame) -> DataFrame:
    """Last override per name wins; matched names updated, new names
    appended; the directory name is looked up by ticker (first row)."""
    ov = overrides.select(F.col("orbis_company_name").cast("string").alias("orbis_company_name"),
                          F.upper(F.trim(F.col("ticker").cast("string"))).alias("ov_ticker"),
                          F.trim(F.col("cik").cast("string")).alias("ov_cik"), F.col("pos").alias("_p"))
    last = first_by(ov.withColumn("_np", -F.col("_p")), ["orbis_company_name"], [("_np", False)]).drop("_np", "_p")
    by_ticker = first_by(directory.select("ticker", "pos", "sec_company_name"), ["ticker"], [("pos", False)]) \
        .select(F.col("ticker").alias("ov_ticker"), F.col("sec_company_name").alias("ov_name"))
    last = last.join(by_ticker, "ov_ticker", "left")
    j = mapping.join(last, "orbis_company_name", "left")
    hit = F.col("ov_ticker").isNotNull()
    updated = j.select(
        "orbis_company_name", "normalized_orbis_name",
        F.when(hit, F.col("ov_name")).otherwise(F.col("matched_sec_name")).alias("matched_sec_name"),
        F.when(hit, F.col("ov_ticker")).otherwise(F.col("ticker")).alias("ticker"),
        F.when(hit, F.col("ov_cik")).otherwise(F.col("cik")).alias("cik"),
        F.when(hit, F.lit(OVERRIDE_SCORE)).otherwise(F.col("match_score")).alias("match_score"),
        F.when(hit, F.lit("manual_override")).otherwise(F.col("match_method")).alias("match_method"),
        F.when(hit, F.lit("manual_ok")).otherwise(F.col("review_flag")).alias("review_flag"))
    new = last.join(mapping.select("orbis_company_name"), "orbis_company_name", "left_anti").select(
        "orbis_company_name", normalize_company_name("orbis_company_name").alias("normalized_orbis_name"),
        F.col("ov_name").alias("matched_sec_name"), F.col("ov_ticker").alias("ticker"), F.col("ov_cik").alias("cik"),
        F.lit(OVERRIDE_SCORE).alias("match_score"), F.lit("manual_override").alias("match_method"),
        F.lit("manual_ok").alias("review_flag"))
    return updated.unionByName(new)


def needs_review(mapping: DataFrame) -> DataFrame:
    """Rows without ticker or cik, or flagged review / unmatched."""
    return mapping.where(F.col("ticker").isNull() | F.col("cik").isNull()
                         | F.col("review_flag").isin("review", "unmatched"))
