"""A small HTML reader: text blocks of a page and the tree of block elements they lie in.

It follows browsers where that decides about text: implied end tags, raw text elements, comments, character references without a
semicolon, unquoted ``>`` in attribute values. It reads a page once, in time linear in its length.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
COMMENT_END = re.compile(r"--!?>")

# Fixed values of HTML.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes".split())
CLOSES_P = BLOCK - frozenset("body head html caption td th tr tbody thead tfoot legend li dd dt".split())
#: start tag -> (open elements it ends, elements that keep them open)
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}
P_SCOPE = ("table", "td", "th", "caption", "button", "object", "template")

# Elements, roles and class words that mark what is not the article.
NOISE_TAGS = frozenset("nav aside footer form menu dialog noscript template svg canvas audio video object select button search datalist".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist respond disqus".split())
NOISE_WORDS = COMMENT_WORDS | frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice"
    " notification alert popup modal overlay newsletter subscribe signup login sidebar nav navbar navigation menu breadcrumb breadcrumbs pagination"
    " pager footer masthead topbar toolbar share sharing social related recommended widget".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOT_ARTICLE, OPEN, ARTICLE = 0, 1, 2


@dataclass
class Page:
    """Block elements (label, parent, children's labels; ``#text`` for a run of text) and text blocks in page order."""

    labels: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    children: list[list[str]] = field(default_factory=list)
    blocks: list[tuple[int, int, int, str]] = field(default_factory=list)  # element, place among its children, state, text
    place: list[int] = field(default_factory=list)
    scopes: list[int] = field(default_factory=list)  # nearest declared article around (or at) an element, 0 if none
    declared: bool = False


def _words(value: str) -> set[str]:
    """Lower-case words of class and id names; names such as no-sidebar or hasMenu speak of the page, not of the element."""
    found: set[str] = set()
    for name in value.split():
        parts = re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+", name)
        if parts and parts[0].lower() not in ("no", "has", "with", "without", "is"):
            found.update(p.lower() for p in parts)
    return found


def read_page(html: str, class_words: bool = True, depth: int = 32) -> Page:
    """Elements and blocks of ``html``. Blocks inside menus, forms and the like are left out, those that a page with a declared article
    holds elsewhere are marked ``NOT_ARTICLE``. Elements deeper than ``depth`` count as their ancestor at that depth."""
    page = Page(["#root"], [-1], [[]], [], [0], [0])
    stack: list[tuple[str, int, int, bool]] = []  # tag, element, inside article (2) or main (1), link
    open_tags: Counter = Counter()
    levels = [0]
    noise: tuple[int, bool] | None = None  # stack height below the outermost noise element, whether an article inside it ends it
    pieces: list[str] = []
    linked = True
    element, inside, links = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                state = ARTICLE if inside == 2 else OPEN if inside == 1 or not linked or page.labels[element].partition(".")[0] in HEADINGS else NOT_ARTICLE
                page.children[element].append("#text")
                page.blocks.append((element, len(page.children[element]) - 1, state | (4 if inside else 0), text))
        linked = True

    def pop(height: int) -> None:
        nonlocal element, inside, links, noise
        while len(stack) > height:
            tag, *_ = entry = stack.pop()
            open_tags[tag] -= 1
            if noise is None and tag in BLOCK:
                flush()
            elif noise is not None and len(stack) <= noise[0]:
                noise = None
            links -= entry[3]
            element, inside = (stack[-1][1], stack[-1][2]) if stack else (0, 0)

    def close(tags: tuple[str, ...], keep: tuple[str, ...]) -> None:
        if any(open_tags[t] for t in tags):
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] in tags:
                    return pop(at)
                if stack[at][0] in keep:
                    return None
        return None

    def text(raw: str) -> None:
        nonlocal linked
        if noise is None and raw:
            decoded = unescape(raw) if "&" in raw else raw
            pieces.append(decoded)
            if not links and not decoded.isspace():
                linked = False

    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        text(html[at:lt])
        after = html[lt + 1 : lt + 2]
        if after in ("!", "?") or (after == "/" and not html[lt + 2 : lt + 3].isalpha()):
            if html.startswith("<!--", lt):
                if html.startswith(("<!-->", "<!--->"), lt):
                    at = html.index(">", lt) + 1
                    continue
                stop = COMMENT_END.search(html, lt + 4)
                at = stop.end() if stop else end
            else:
                stop_at = html.find(">", lt)
                at = stop_at + 1 if stop_at >= 0 else end
            continue
        if not ("a" <= after.lower() <= "z" or after == "/"):
            text("<")
            at = lt + 1
            continue
        match = TAG.match(html, lt)
        if match is None:  # the page ends inside a tag
            break
        at = match.end()
        tag = match[2].lower()
        if match[1]:
            if tag == "br":
                text(" ")
            elif open_tags[tag]:
                height = len(stack) - 1
                while stack[height][0] != tag:
                    height -= 1
                pop(height)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in CLOSES_P:
            close(("p",), P_SCOPE)
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in RAW:
            stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            at = html.find(">", stop.start()) + 1 if stop else end
            at = at or end
            continue
        attributes = {}
        if match[3] and not match[3].isspace():
            for name, *values in ATTRIBUTE.findall(match[3]):
                attributes.setdefault(name.lower(), unescape(next((v for v in values if v), "")))
        if tag in VOID or (match[3].endswith("/") and tag in ("svg", "path")):
            if tag == "hr" and noise is None:
                flush()
            continue
        role = attributes.get("role", "").lower()
        names = _words(f"{attributes.get('class', '')} {attributes.get('id', '')}") if attributes else set()
        declared = tag in ("article", "main") or role in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody"
        remark = bool(names & COMMENT_WORDS) and class_words
        if declared and not remark and noise is not None and noise[1]:
            noise = None  # a wrapper named like a menu, or a form around everything
            element, inside = (stack[-1][1], stack[-1][2]) if stack else (0, 0)
        if noise is None:
            worded = class_words and tag not in ("html", "body") and (remark if declared else bool(names & NOISE_WORDS))
            hidden = "hidden" in attributes or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I)
            outer_header = (tag == "header" or (class_words and "header" in names and tag == "div")) and not inside
            if (tag in NOISE_TAGS or role in NOISE_ROLES or worded or hidden or outer_header) and not (declared and not remark):
                if tag in BLOCK:
                    flush()
                    page.children[element].append(f"{tag}!")
                noise = (len(stack), not remark and tag not in ("nav", "aside", "footer") and role not in NOISE_ROLES)
        if noise is None and tag in BLOCK:
            flush()
            if declared and not remark:
                page.declared = True
                inside = max(inside, 1 if tag == "main" or role == "main" else 2)
            level = levels[element] + 1
            if level <= depth:
                label = tag + "".join("." + n for n in sorted(set(attributes.get("class", "").split())))
                page.children[element].append(label)
                page.labels.append(label)
                page.parents.append(element)
                page.place.append(len(page.children[element]) - 1)
                page.children.append([])
                levels.append(level)
                page.scopes.append(len(page.labels) - 1 if declared and not remark else page.scopes[element])
                element = len(page.labels) - 1
        link = tag == "a" and noise is None
        links += link
        stack.append((tag, element, inside, link))
        open_tags[tag] += 1
    pop(0)
    flush()
    page.blocks = [(e, k, state & 3 if state & 4 or not page.declared else NOT_ARTICLE, t) for e, k, state, t in page.blocks]
    if class_words and not any(state for _, _, state, _ in page.blocks):
        return read_page(html, False, depth)
    return page


def _key(*parts: object) -> int:
    return int.from_bytes(blake2b(repr(parts).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def keyed(page: Page, host: str | None) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[int, int, str]]]:
    """Nodes (node, parent, style of the parent that it lies in, depth, own style, article around it) and blocks (node, state, text).

    A style is the sequence of an element's children with runs of equal ones taken as one. A node is known by its host, its parent, the
    parent's style and its place in it, so that equal positions of a site's pages get one key. A leaf of text has style 0.
    """
    keys, depths, styles, places = [_key(host)], [0], [], []
    nodes = []
    for e, children in enumerate(page.children):
        runs, place = [], []
        for label in children:
            if not runs or runs[-1] != label:
                runs.append(label)
            place.append(len(runs) - 1)
        places.append(place)
        styles.append(_key(*runs) or 1)
        if e:
            parent = page.parents[e]
            keys.append(_key(keys[parent], styles[parent], places[parent][page.place[e]]))
            depths.append(depths[parent] + 1)
        nodes.append((keys[e], keys[page.parents[e]] if e else 0, styles[page.parents[e]] if e else 0, depths[e], styles[e], 0))
    blocks = []
    for e, k, state, text in page.blocks:
        leaf = _key(keys[e], styles[e], places[e][k], "#text")
        nodes.append((leaf, keys[e], styles[e], depths[e] + 1, 0, keys[page.scopes[e]]))
        blocks.append((leaf, state, text))
    return list(dict.fromkeys(nodes)), blocks
