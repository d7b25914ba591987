"""Labelled pages for the HTML extractor: small layouts whose main text is marked.

The pages are made by rule from layouts, boilerplate kinds and names that are
common on public sites.  ``MARK`` and ``UNMARK`` stand around main text.
"""

from __future__ import annotations

import re

MARK, UNMARK = "", ""

#: where main text is found: opening and closing tags
LAYOUTS = (
    ("<main><article>", "</article></main>"),
    ("<article>", "</article>"),
    ('<div id="main"><div class="article">', "</div></div>"),
    ('<div class="post"><div class="entry">', "</div></div>"),
    ('<div class="content">', "</div>"),
    ("<table><tr><td>", "</td></tr></table>"),
    ('<section class="story">', "</section>"),
    ("<div><div>", "</div></div>"),
)
#: elements that are never main text
ELEMENTS = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "address")
#: names by their letters, of a class, an id or a role, that mark what is not main text
NAMES = (
    "ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navigation", "navbar", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar",
    "header", "masthead", "topbar", "footer", "bottom", "copyright", "legal",
    "sidebar", "side", "aside", "widget", "related", "recommended", "more", "tags", "share", "sharing", "social",
    "cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login",
    "comment", "comments", "reply", "replies", "respond", "discussion", "feedback", "search", "form", "skip",
    "adbanner", "adbox", "adcontainer", "adslot", "adunit", "adwrapper", "bannerad", "sponsoredcontent", "sponsoredlinks",
    "mainnav", "sitenav", "topnav", "sidenav", "navmenu", "mainmenu", "topmenu", "sidemenu", "mainnavigation", "sitenavigation", "mwnavigation",
    "siteheader", "globalheader", "sitefooter", "pagefooter", "globalfooter", "colophon", "contentinfo", "complementary", "copyrightnotice", "legalnotice",
    "sidebarleft", "sidebarright", "leftsidebar", "rightsidebar", "primarysidebar", "widgetarea", "widgettext", "tagcloud", "posttags",
    "relatedposts", "relatedarticles", "relatedlinks", "relatedcontent", "readmore", "morelinks", "recommendedarticles",
    "sharebuttons", "sharelinks", "sociallinks", "socialshare", "socialmedia", "socialicons",
    "cookienotice", "cookiebanner", "cookieconsent", "cookiebar", "newslettersignup", "signupform", "loginform", "searchform", "searchbox",
    "commentlist", "commentform", "commentsection", "commentsarea", "postcomments", "skiplink", "skipnav", "backtotop",
)
#: names of that list that are also what a section of an article can be about
TOPICS = ("discussion", "legal", "feedback", "search", "form", "notice", "more", "side", "menu", "navigation", "alert", "consent", "social",
          "promotion", "copyright", "reply", "bottom", "header", "tags")
TOPIC_ID = re.compile(f' id="({"|".join(TOPICS)})"')
WORDS = "the report says that most people who live near the river have moved to higher ground since the flood of last year".split()


def _text(k: int, n: int) -> str:
    return " ".join(WORDS[(k + j) % len(WORDS)] for j in range(n))


def _main(k: int) -> str:
    """Headings, paragraphs, lists, quotes and links in running text."""
    said = (
        f"<h1>{_text(k, 6)}</h1><p>{_text(k, 30)} <a href='/x'>{_text(k + 3, 2)}</a> {_text(k, 20)}</p>",
        f"<h2>{_text(k, 4)}</h2><h3>{_text(k, 3)}</h3><p>{_text(k, 40)}<br>{_text(k, 9)}</p><ul><li>{_text(k, 12)}</li><li>{_text(k, 9)}</li></ul>",
        f"<blockquote><p>{_text(k, 25)}</p></blockquote><p><b>{_text(k, 5)}</b> {_text(k, 30)} <em>{_text(k, 3)}</em></p>",
        f"<p>{_text(k, 8)}</p><h3>{_text(k, 3)}</h3><h4>{_text(k, 2)}</h4><ol><li>{_text(k, 15)}</li></ol><pre>{_text(k, 10)}</pre><p>{_text(k, 3)}</p>",
    )
    return f"{MARK}{said[k % 4]}{UNMARK}"


def _links(k: int, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/{j}">{_text(k + j, 2)}</a></li>' for j in range(n)) + "</ul>"


def _junk(tag: str, name: str, k: int) -> str:
    inner = (
        _links(k, 6),
        f"<p>{_text(k, 9)}</p>",
        f"{_text(k, 5)}",
        f"<div><h3>{_text(k, 2)}</h3><p>{_text(k, 14)}</p></div>",
        f"<ol><li><article><h2>{_text(k, 2)}</h2><p>{_text(k, 22)}</p></article></li></ol>",
        f"<h1>{_text(k, 2)}</h1><p><b>{_text(k, 3)}</b> <em>{_text(k, 2)}</em> {_text(k, 6)}</p>",
        f"<blockquote><p>{_text(k, 12)}</p></blockquote><pre>{_text(k, 3)}</pre>",
    )[k % 7]
    names = f' class="{name}"' if name and k % 2 else f' id="{name}"' if name else ""
    return f"<{tag}{names}>{inner}</{tag}>"


def _named_sections() -> list[str]:
    """Articles with main text in sections whose ids are also names of boilerplate,
    and with boilerplate whose id is no topic's name."""
    pages = []
    for k, name in enumerate(TOPICS * 2):
        start, end = LAYOUTS[:2][k % 2]
        section = ("section", "div")[k // len(TOPICS)]
        pages.append(f'<body class="{NAMES[k]}">{_junk("nav", "", k)}{start}{_main(k)}<{section} id="{name}">{_main(k + 1)}</{section}>{_main(k + 2)}'
                     f'{_junk("div", NAMES[3 * k], 2 * k + 1)}{end}{_junk("footer", "", k)}</body>')
    for k, name in enumerate(n for n in NAMES if n not in TOPICS):
        start, end = LAYOUTS[:2][k % 2]
        pages.append(f"<body>{start}{_main(k)}{_junk('div', name, 2 * k)}{_main(k + 1)}{end}{_junk('footer', '', k)}</body>")
    return pages


def _long_gaps() -> list[str]:
    """Pages whose boilerplate is long for what it divides: a block inside the
    article, of more words than the part that follows it; an advert before a last
    short list; a menu between a slogan, which no name tells from main text, and
    the article."""
    pages = []
    for k, (start, end) in enumerate(LAYOUTS):
        block = f'<div class="{("comments", "related")[k % 2]}">' + "".join(f"<p>{_text(k + j, 15)}</p>" for j in range(9)) + "</div>"
        pages.append(f"<body>{start}{_main(0)}{_main(1)}{block}{_main(0)}{_main(2)}{end}{_junk('footer', '', k)}</body>")
        advert = f'<div class="advertisement"><p>{_text(k, 10 + k % 3)}</p></div>'
        last = f"{MARK}<ul><li>{_text(k, 2 + k % 2)}</li><li>{_text(k, 2)}</li></ul>{UNMARK}"
        pages.append(f"<body>{start}{_main(k)}{advert}{last}{end}{_junk('footer', '', k)}</body>")
        pages.append(f'<body><div><p>{_text(k, 8 + k)}</p></div><nav>{_links(k, 60 + 10 * k)}</nav>{start}{_main(k)}{_main(k + 1)}{end}</body>')
    return pages


def labelled_pages() -> list[str]:
    """Two pages for each name and element, over all layouts in turn (inside an
    article, a topic's name on boilerplate is a class), and those of named sections and of long gaps."""
    pages = []
    kinds = [("div", n) for n in NAMES] + [("section", n) for n in NAMES[::3]] + [(e, "") for e in ELEMENTS]
    kinds = [kind for kind in kinds for _ in range(2)]
    for k, (tag, name) in enumerate(kinds):
        start, end = LAYOUTS[k % len(LAYOUTS)]
        junk, other = _junk(tag, name, k), _junk(*kinds[(7 * k + 3) % len(kinds)], k + 1)
        inside = junk if k % 3 else _junk(tag, name, k + 2)
        within = other
        if k % len(LAYOUTS) < 2:
            inside, within = (TOPIC_ID.sub(r' class="\1"', x) for x in (inside, other))
        pages.append(f"<html><head><title>{_text(k, 5)}</title></head><body>{junk}{other}{start}{_main(k)}{inside}{_main(k + 1)}{within}{end}"
                     f"{junk}<div>{_links(k, 5)}</div>{_junk('footer', '', k)}</body></html>")
        if k % 8 == 0:  # a heading block of the article itself is main text
            pages.append(f"<body>{_junk('header', '', k)}<article>{MARK}<header><h1>{_text(k, 7)}</h1></header>{UNMARK}{_main(k)}</article></body>")
    return pages + _named_sections() + _long_gaps()
