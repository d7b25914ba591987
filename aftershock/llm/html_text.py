"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of tags and text runs.  Each word of a run scores between
-1 and 1, from the run's enclosing elements: each tag name and each name of a
class, id or role makes the run boilerplate with a chance of its own, and a
word's score is twice the chance that none does, less one.  Each tag costs a
little, the more the oftener it stands outside main text.  Both weights are learned
from labelled pages, and so is the share of its cost that a word or tag of
boilerplate has in the scan.  One linear scan finds the contiguous stretch of largest
sum, in which a gap costs the more the longer it is, without a bound; the text
is that of the stretch's runs with a positive score, so an advert inside an
article is left out, and cuts the article in two only if it outweighs a part.

Names are taken whole, by their letters ("side-bar" and "sidebar-2" are sidebar,
"no-sidebar" is not).  Those of html, body, main, article and of any element
that holds most of the page's words say nothing; an id inside an article or main
element is a name of its own kind, since it also is what a section is about.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by line feeds in page order, empty ones
left out.  Scripts, styles, comments and other unseen elements have no text.

Defined results: null, empty and textless pages give an empty text; unclosed
and stray tags are taken as browsers do, near enough; a null url stays null.  A
block that holds most of a page's words is text whatever its name, comments too,
unless its tags say otherwise.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .html_pages import MARK, UNMARK, labelled_pages

GAPS = (1.0, 0.5, 0.25, 0.125, 0.0625)  # shares of its cost that boilerplate can have in the scan
GAP = 0.25  # where no labelled page tells

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMING = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NO_LETTER = re.compile(r"[\W\d_]+")

#: fixed values: elements of HTML by what they mean for text
HIDDEN = frozenset("head script style noscript template title textarea iframe svg annotation annotation-xml object select option button canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
          "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
WHOLE = frozenset("html body main article".split())  # what they hold is not told by their names
SCOPE = frozenset("ul ol table td th tr div section article main nav aside header footer body html blockquote form dl".split())


UNMARKED = {ord(MARK): None, ord(UNMARK): None}


@dataclass
class Run:
    """Text in one place of a page; ``tag`` instead of text for a tag."""

    tag: str = ""
    text: str = ""
    block: int = 0
    features: frozenset[str] = field(default_factory=frozenset)


@dataclass
class Element:
    """An open or closed element of a page."""

    tag: str
    rest: str
    around: Element | None
    words: int = 0
    features: frozenset[str] = frozenset()


def _names(rest: str, kept: bool) -> Iterator[str]:
    """Whole names by their letters; an id where names are ``kept`` apart is one of its own kind."""
    for m in NAMING.finditer(rest):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            if name := NO_LETTER.sub("", name):
                yield f"#{name}" if kept and m[1].lower() == "id" else name


def _features(element: Element, around: frozenset[str], named: bool) -> frozenset[str]:
    tag = element.tag
    own = tag in ("header", "footer") and "<article>" in around  # of the article, not of the page
    if own:
        return frozenset([f"<article {tag}>"])
    place = next((p for p in ("p", "li") if f"<{p}>" in around), "") if tag == "a" else ""
    found = {f"<{place} a>" if place else f"<{tag}>"}  # links of a menu and of running text differ
    if named and tag not in WHOLE:
        found.update(_names(element.rest, "<article>" in around or "<main>" in around))
    return frozenset(found)


def _raw_end(page: str, tag: str, at: int) -> int:
    m = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
    return m.start() if m else len(page)


def runs(page: str) -> list[Run]:
    """Tags and text runs in page order."""
    elements: list[Element] = []
    found: list[tuple[Run, Element | None]] = []
    for run, element in _placed(page, elements):
        found.append((run, element))
        if element is not None and run.text:
            element.words += len(run.text.translate(UNMARKED).split())
    for e in reversed(elements):  # an element comes after those around it
        if e.around is not None:
            e.around.words += e.words
    total = sum(e.words for e in elements if e.around is None) + sum(len(r.text.translate(UNMARKED).split()) for r, e in found if e is None and r.text)
    for e in elements:
        around = e.around.features if e.around is not None else frozenset()
        e.features = around | _features(e, around, 2 * e.words <= total)
    for run, element in found:
        if element is not None:
            run.features = element.features
    return [run for run, _ in found]


def _placed(page: str, elements: list[Element]) -> Iterator[tuple[Run, Element | None]]:
    """Tags and text runs, with the element that holds a text; adds to the elements."""
    stack: list[Element] = []
    block, at, n = 0, 0, len(page)

    def shut(names: frozenset[str], scope: frozenset[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in names:
                del stack[k:]
                return
            if stack[k].tag in scope:
                return

    while at < n:
        m = TOKEN.search(page, at)
        if m is None or m.start() > at:
            end = m.start() if m else n
            yield Run(text=html.unescape(page[at:end]), block=block), stack[-1] if stack else None
        if m is None:
            return
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in VOID or not any(e.tag == tag for e in stack):
                if tag in BLOCK:
                    block += 1
                continue
            shut(frozenset([tag]), frozenset())
        elif tag in HIDDEN:
            if tag != "head":  # what a head shows is hidden element by element
                at = at if m[3].endswith("/") else _raw_end(page, tag, at)
            continue
        elif tag == "br":
            yield Run(text=" ", block=block), stack[-1] if stack else None
        elif tag not in VOID:
            if tag in CLOSES:
                shut(CLOSES[tag], SCOPE - CLOSES[tag])
            elif tag in BLOCK:  # a block ends an open paragraph
                shut(CLOSES["p"], SCOPE)
            stack.append(Element(tag, m[3], stack[-1] if stack else None))
            elements.append(stack[-1])
        if tag in BLOCK:
            block += 1
        yield Run(tag=tag), None


@dataclass(frozen=True)
class Extractor:
    """Learned weights: each feature's chance to make boilerplate, and costs of tags."""

    chances: dict[str, float]
    costs: dict[str, float]
    cost: float  # of a tag not seen
    gap: float = GAP  # share of its cost that boilerplate has in the scan

    def word_score(self, features: frozenset[str]) -> float:
        main = 1.0
        for f in features:
            main *= 1.0 - self.chances.get(f, 0.0)
        return 2.0 * main - 1.0

    def weighed(self, page: Iterable[Run]) -> list[tuple[Run, float, float]]:
        """Each run, its word score and its weight in the scan."""
        known: dict[frozenset[str], float] = {}
        seq = []
        for run in page:
            if run.tag:
                seq.append((run, 0.0, -self.costs.get(run.tag, self.cost)))
            elif n := len(run.text.split()):
                score = known.get(run.features)
                if score is None:
                    score = known[run.features] = self.word_score(run.features)
                seq.append((run, score, n * score))
            else:
                seq.append((run, 1.0, 0.0))
        return seq

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        seq = self.weighed(runs(page))
        a, b = best_stretch([w for _, _, w in seq], self.gap)
        blocks: dict[int, list[str]] = {}
        for run, score, _ in seq[a:b]:
            if not run.tag and score > 0:
                blocks.setdefault(run.block, []).append(run.text)
        lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
        return "\n".join(x for x in lines if x)


def best_stretch(weights: list[float], gap: float = GAP) -> tuple[int, int]:
    """First and one beyond the last of the contiguous stretch of largest positive
    sum, where negative weights count ``gap`` times: the first of the shortest."""
    best = total = 0.0
    start = first = end = 0
    for k, w in enumerate(weights):
        total += w if w > 0 else w * gap
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, first, end = total, start, k + 1
    return first, end


def _labelled_runs(page: str) -> list[tuple[Run, bool]]:
    """Runs without the marks, and whether they are main text."""
    out, inside = [], False
    for run in runs(page):
        for part in [""] if run.tag else re.split(f"([{MARK}{UNMARK}])", run.text):
            if run.tag:
                out.append((run, inside))
            elif part in (MARK, UNMARK):
                inside = part == MARK
            elif part:
                out.append((replace(run, text=part), inside))
    return out


def _misplaced(weighed: list[tuple[list[tuple[Run, float, float]], list[bool]]], gap: float) -> int:
    """Words of main text left out and of boilerplate taken in."""
    wrong = 0
    for seq, inside in weighed:
        a, b = best_stretch([w for _, _, w in seq], gap)
        wrong += sum(len(run.text.split()) for k, (run, score, _) in enumerate(seq)
                     if not run.tag and (a <= k < b and score > 0) != inside[k])
    return wrong


def train(pages: list[str], rounds: int = 200) -> Extractor:
    """Learn from pages whose main text stands between MARK and UNMARK.

    Expectation maximisation: a boilerplate run is shared out among its
    features by their chances; a feature's chance is its shares over its runs.
    Of ``GAPS``, the one that misplaces the fewest words; of equals, the largest.
    """
    labelled = [_labelled_runs(page) for page in pages]
    rows: Counter[tuple[frozenset[str], bool]] = Counter()
    inside_tags: Counter[str] = Counter()
    all_tags: Counter[str] = Counter()
    for run, inside in chain.from_iterable(labelled):
        if run.tag:
            all_tags[run.tag] += 1
            inside_tags[run.tag] += inside
        elif run.text.strip():
            rows[run.features, inside] += 1
    uses: Counter[str] = Counter()
    for (features, _), n in rows.items():
        uses.update(dict.fromkeys(features, n))
    chances = dict.fromkeys(sorted(uses), 0.5)
    for _ in range(rounds):
        shares = dict.fromkeys(chances, 0.0)
        for (features, inside), n in rows.items():
            if not inside and features:
                total = 1.0 - float(np.prod([1.0 - chances[f] for f in features]))
                for f in features:  # the chance that this feature made it boilerplate, given that one did
                    shares[f] += n * chances[f] / max(total, 1e-12)
        chances = {f: min(shares[f] / (uses[f] + 0.1), 0.995) for f in chances}
    costs = {t: 0.02 + 0.3 * (1 - inside_tags[t] / c) for t, c in all_tags.items()}
    model = Extractor({f: round(q, 6) for f, q in chances.items() if q > 1e-4}, costs, 0.1)
    weighed = [(model.weighed(run for run, _ in page), [inside for _, inside in page]) for page in labelled]
    return replace(model, gap=min(GAPS, key=lambda gap: _misplaced(weighed, gap)))


def main_text(pages: DataFrame, page: str = "html", labelled: list[str] | None = None) -> Column:
    """The main text of each whole page."""
    model = pages.sparkSession.sparkContext.broadcast(train(labelled_pages() if labelled is None else labelled))

    @pandas_udf("string")
    def extract(texts: pd.Series) -> pd.Series:
        return pd.Series([model.value.extract(t) for t in texts], dtype=object)

    return extract(F.col(page))


def page_table(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    out = pages.select("page_id", "url", main_text(pages).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
