"""A page as elements and texts: the small reader of HTML under the template operator.

An element has a role, the hash of its path of tags, classes and ids from the root
(inline elements without class or id take the role around them).  Digits in names do
not tell roles apart.  Comments, scripts, styles and other elements without readable
text are skipped; tags that HTML lets an author leave out are closed as HTML does.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import xxhash

# Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp title textarea svg math object canvas audio video select button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag closes the nearest open element of these, unless one of the second set is in between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# What is no article, by element and by words of class, id and role.
SIDE_TAGS = frozenset("nav aside footer form header dialog menu head fieldset label search".split())
SIDE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promotions banner banners
    cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup
    menu menus nav navbar navigation breadcrumb breadcrumbs pager pagination toolbar skip masthead header topbar footer colophon copyright
    sidebar aside complementary widget widgets related recommended recommendations share sharing social
    comment comments commentlist disqus replies reply respond discussion login search contentinfo""".split()
)
#: Of an article element only these words tell that it is not the article.
NOT_THE_ARTICLE = frozenset("comment comments reply replies related recommended sponsored promo".split())
#: Without an end tag these take the rest of the page; others of RAW are then passed over.
_TO_THE_END = frozenset("script style textarea title xmp iframe noembed noframes".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    """Elements in page order (element 0 stands around all) and pieces of text in page order."""

    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    role: list[int] = field(default_factory=lambda: [0])
    side: list[bool] = field(default_factory=lambda: [False])  # named as no article, by itself
    #: (element, text, whether in a link); text "\n" ends a block
    pieces: list[tuple[int, str, bool]] = field(default_factory=list)


def _named(tag: str, attributes: str) -> tuple[str, bool]:
    """Classes and id without digits, and whether a word of them names no article."""
    found = [(k.lower(), a or b or c) for k, a, b, c in _NAMES.findall(attributes)] if "=" in attributes else []
    words = {w.lower() for _, v in found for w in _WORDS.findall(v)}
    telling = frozenset() if tag in ("html", "body", "main") else NOT_THE_ARTICLE if tag == "article" else SIDE_WORDS
    return "".join(sorted(f" {k}={re.sub('[0-9]+', '', v)}" for k, v in found)), not words.isdisjoint(telling)


def read_page(html: str | None) -> Page:
    """The page of an HTML text; a null or empty one has no texts, one without tags a single text."""
    page, html = Page(), html or ""
    stack, at, links = [0], 0, 0  # open elements; links: open <a>

    def say(text: str) -> None:
        if text:
            page.pieces.append((stack[-1], text, links > 0))

    def close(depth: int) -> None:
        nonlocal links
        for e in stack[depth:]:
            links -= page.tag[e] == "a"
            if page.tag[e] not in INLINE:
                page.pieces.append((e, "\n", False))
        del stack[depth:]

    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            say(unescape(html[at:]))
            break
        say(unescape(html[at:start]))
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = len(html) if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), start):
            end = html.find(">", start)
            at = len(html) if end < 0 else end + 1
            continue
        m = _TAG.match(html, start)
        if not m:
            if not re.match("</?[a-zA-Z]", html[start : start + 3]):
                say("<")
                at = start + 1
            else:  # a tag that does not end in the page, or with a quote left open
                end = html.find(">", start)
                at = len(html) if end < 0 else end + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if page.tag[stack[depth]] == name:
                    close(depth)
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
            if end and not m[3].endswith("/"):
                at = html.find(">", end.start()) + 1 or len(html)
            elif not end and name in _TO_THE_END:
                at = len(html)
            continue
        if name in VOID:
            page.pieces.append((stack[-1], "\n", False))
            continue
        if name in CLOSES_P or name in CLOSES:
            of, within = CLOSES.get(name, ({"p"}, {"table", "td", "button"}))
            for depth in range(len(stack) - 1, 0, -1):
                if page.tag[stack[depth]] in of:
                    close(depth)
                    break
                if page.tag[stack[depth]] in within:
                    break
        around = stack[-1]
        names, side = _named(name, m[3]) if m[3] else ("", False)
        if name in INLINE and not names:
            role = page.role[around]
        else:
            role = xxhash.xxh3_64_intdigest(f"{page.role[around]}/{name}{names}") >> 1
        page.tag.append(name)
        page.parent.append(around)
        page.role.append(role)
        page.side.append(name in SIDE_TAGS or side)
        stack.append(len(page.tag) - 1)
        links += name == "a"
        if name not in INLINE:
            page.pieces.append((around, "\n", False))
    return page


def texts_of(page: Page) -> dict[int, str]:
    """Per element that has a role of its own: its text without that of such elements inside, white space as one space."""
    own = list(range(len(page.tag)))
    for e in range(1, len(own)):
        if page.role[e] == page.role[page.parent[e]]:
            own[e] = own[page.parent[e]]
    parts: dict[int, list[str]] = {}
    for e, text, _ in page.pieces:
        parts.setdefault(own[e], []).append(text)
    said = {e: " ".join("".join(of).split()) for e, of in parts.items()}
    return {e: text for e, text in said.items() if text}


def _within(page: Page, e: int, around: int) -> bool:
    while e > around:
        e = page.parent[e]
    return e == around


def main_text(page: Page, constant: set[int], skeleton: set[int], mass: dict[int, float]) -> str:
    """The article: what fills the slots of the main part of the page's template.

    constant: roles that say the same on every page.  skeleton: roles that every page has
    once.  mass: mean length of what a role says on a page of the site.  Without a
    template (skeleton empty) the page stands for its site.
    """
    n = len(page.tag)
    holds = [t in ("article", "main") and not side for t, side in zip(page.tag, page.side)]  # an article, a part of one, or around one
    title, length = [t == "h1" for t in page.tag], [0] * n
    for e, text, linked in page.pieces:
        length[e] += len(text) * (not linked)
    for e in range(n - 1, 0, -1):
        p = page.parent[e]
        holds[p], title[p], length[p] = holds[p] or holds[e], title[p] or title[e], length[p] + length[e]
    inside, out, heading = [False] * n, [False] * n, [False] * n
    for e in range(1, n):
        p, tag = page.parent[e], page.tag[e]
        inside[e] = inside[p] or (tag in ("article", "main") and holds[e])
        heading[e] = heading[p] or tag in HEADINGS
        # what holds the article, or the title and most of the text, is never beside it; of a header inside the article its headings stay
        whole = holds[e] or (tag not in SIDE_TAGS and title[e] and 2 * length[e] > length[0])
        out[e] = out[p] or (page.side[e] and not whole and not (tag == "header" and inside[p]))
        out[e] |= page.role[e] in constant and not holds[e]
    in_header = [False] * n
    for e in range(1, n):
        in_header[e] = in_header[page.parent[e]] or (page.tag[e] == "header" and inside[e])
    kept = [not out[e] and not (in_header[e] and not heading[e]) for e in range(n)]

    found: dict[int, float] = {}
    for e, text, linked in page.pieces:
        if kept[e] and not linked and text != "\n":
            found[e] = found.get(e, 0.0) + len(text)
    if skeleton:  # the site's usual lengths, so that a short article is still the main part
        sharing: dict[int, int] = {}
        for e in found:
            sharing[page.role[e]] = sharing.get(page.role[e], 0) + 1
        found = {e: mass.get(page.role[e], x) / sharing[page.role[e]] for e, x in found.items()}
    weight = [0.0] * n
    for e, x in found.items():
        weight[e] = x
    for e in range(n - 1, 0, -1):
        weight[page.parent[e]] += weight[e]

    part = [False] * n
    tops = [e for e in range(1, n) if page.tag[e] == "article" and not out[e]] or [e for e in range(1, n) if page.tag[e] == "main" and not out[e]]
    if tops:
        for e in tops:
            part[e] = True
        if len(tops) == 1 and page.tag[tops[0]] == "article" and not any(page.tag[e] == "h1" and kept[e] and _within(page, e, tops[0]) for e in range(1, n)):
            for e in range(1, n):  # the title may stand before the article, in the main element around both
                part[e] = part[e] or (page.tag[e] == "h1" and e < tops[0] and any(page.tag[m] == "main" and _within(page, e, m) and _within(page, tops[0], m) for m in range(1, e)))
    else:
        times: dict[int, int] = {}
        for r in page.role:
            times[r] = times.get(r, 0) + 1
        children: dict[int, list[int]] = {}
        for e in range(1, n):
            children.setdefault(page.parent[e], []).append(e)
        e = 0
        while True:  # down the nested template while one element holds nearly all that varies
            best = max((c for c in children.get(e, []) if page.tag[c] in ("html", "body", "div", "section", "center", "table", "tbody", "tr", "td")), key=lambda c: weight[c], default=None)
            fixed = best is not None and (page.role[best] in skeleton if skeleton else times[page.role[best]] == 1)
            if not fixed or weight[best] < MAIN_SHARE * weight[e]:
                break
            if any(page.tag[c] in HEADINGS and kept[c] for c in children[e]):
                break  # the title stands beside it
            e = best
        part[e] = True
    for e in range(1, n):
        part[e] |= part[page.parent[e]]
    return " ".join("".join(" " if text == "\n" else text for e, text, _ in page.pieces if text == "\n" or (kept[e] and part[e])).split())


#: Share of the varying text that an element must hold to be the main part in place of the one around it.
MAIN_SHARE = 0.7
