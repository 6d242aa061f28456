"""Leaf blocks of a page's DOM, and what is known of each."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S
)
_ATTR = re.compile(r"(class|id|role|style|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_TOKEN = re.compile(r"[a-z]+")

#: What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr area base col embed link meta param source track".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split()
)
#: Which open element a start tag ends, and what hides it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Names that pages give to their parts.
NAMES = {
    "ad": "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion dfp adslot",
    "nav": "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager toc tabs",
    "side": "sidebar side aside widget widgets rail complementary",
    "foot": "footer foot copyright contentinfo legal imprint colophon",
    "head": "header masthead topbar logo branding sitename",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay dialog toast announcement paywall",
    "form": "form login signin signup register search subscribe subscription newsletter contact",
    "comment": "comment comments reply replies respond disqus discussion reviews",
    "share": "share sharing social follow like tweet",
    "related": "related recommended recommendations more also popular trending teaser teasers links",
    "main": "article content main post entry story body text maincontent articlebody postcontent",
}
_GROUP = {name: group for group, names in NAMES.items() for name in names.split()}
_BY_TAG = {
    "nav": "nav", "menu": "nav", "header": "head", "footer": "foot", "aside": "side", "form": "form",
    "fieldset": "form", "button": "form", "select": "form", "label": "form", "dialog": "notice",
    "article": "main", "main": "main",
}
_KNOWN = frozenset(
    "p h1 h2 h3 h4 h5 h6 li div td th blockquote pre figcaption dt dd section article main header footer nav aside "
    "form a span table ul ol button option label body address summary".split()
)


class Block:
    __slots__ = ("text", "features", "linked")

    def __init__(self, text: str, features: list[str], linked: int):
        self.text, self.features, self.linked = text, features, linked


def _marks(tag: str, attrs: str) -> tuple[str, ...]:
    """Groups that an element's tag and names say it belongs to, the most telling first."""
    found = []
    if attrs:
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
                found.append("hidden")
            elif name != "style":
                found.extend(_GROUP[t] for t in _TOKEN.findall(value) if t in _GROUP)
    if tag in _BY_TAG:
        found.append(_BY_TAG[tag])
    if "main" in found and len(set(found)) > 1:  # "comment-body", "header content"
        found = [g for g in found if g != "main"]
    return tuple(dict.fromkeys(found))


def blocks(html: str | None) -> list[Block]:
    """The page's non-empty leaf blocks, in page order.

    A block is the text between two block boundaries. Character references are
    decoded, line breaks and other white space are one blank. Scripts, styles, titles,
    comments and the like are no text.
    """
    if not html:
        return []
    out: list[Block] = []
    # (tag, groups of it and its ancestors, the innermost group, known tags)
    stack: list[tuple] = [("", frozenset(), "", frozenset())]
    is_open: Counter = Counter()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                own = next((e[0] for e in reversed(stack) if e[0] not in INLINE), "")
                _, groups, inner, tags = stack[-1]
                f = [f"own:{own if own in _KNOWN else 'other'}", f"inner:{inner}"]
                f += [f"in:{g}" for g in groups]
                f += [f"tag:{t}" for t in tags]
                out.append(Block(text, f, linked))
            parts.clear()
        linked = 0

    def pop_to(tag: str) -> None:
        while stack[-1][0] != tag:
            is_open[stack.pop()[0]] -= 1
        is_open[stack.pop()[0]] -= 1

    def say(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = unescape(text)
        if is_open["a"]:
            linked += len(text)
        parts.append(text)

    at, search = 0, _TAG.search
    while m := search(html, at):
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:  # an end tag
            if tag not in INLINE and tag != "br":
                flush()
            if tag == "br":
                parts.append(" ")
            elif is_open[tag]:
                pop_to(tag)
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if tag in CLOSES_P and is_open["p"]:
            pop_to("p")
        if tag in ENDS:
            ended, hides = ENDS[tag]
            for e in reversed(stack):
                if e[0] in ended:
                    pop_to(e[0])
                    break
                if e[0] in hides:
                    break
        if tag in VOID:
            continue
        if tag == "a" and is_open["a"]:
            pop_to("a")
        _, groups, inner, tags = stack[-1]
        marks = _marks(tag, m[3])
        if marks:
            groups, inner = groups | set(marks), marks[0]
        if tag in _KNOWN and tag not in tags:
            tags = tags | {tag}
        stack.append((tag, groups, inner, tags))
        is_open[tag] += 1
    if at < len(html):
        say(html[at:])
    flush()
    return out
