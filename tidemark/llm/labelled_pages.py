"""Labelled web pages of many layouts, made up, to train and test extraction on."""

from __future__ import annotations

import random
from collections.abc import Iterator

_SYLLABLES = (
    "ka lo mi ra te sun ver dal pre con ing tion ed er an re st ou ble eau ment que ó ción ez ñ ä ü sch keit "
    "ung ich ha no wi pa zu ша ко ли 学 国"
).split()


class _Page:
    """Writes one page; what it writes as main text is noted."""

    def __init__(self, r: random.Random):
        self.r, self.main, self.html = r, set(), []

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.choice((1, 2, 2, 3, 4))))

    def phrase(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi))).capitalize()

    def prose(self, lo: int, hi: int) -> str:
        return " ".join(self.phrase(2, 18) + self.r.choice("...!?") for _ in range(self.r.randint(lo, hi)))

    def put(self, *html: str) -> None:
        self.html.extend(html)

    def named(self, tag: str, names: list[str]) -> tuple[str, str]:
        """An element with a class, an id, a role or nothing from ``names``."""
        name = self.r.choice(names)
        extra = self.r.choice(("", "", f" {self.word()}"))
        how = self.r.choice((f' class="{name}{extra}"', f" class='{name}'", f' id="{name}"'))
        return f"<{tag}{how if name else ''}>", f"</{tag}>"

    def say(self, tag: str, text: str, main: bool) -> None:
        if main:
            self.main.add(" ".join(text.split()))
        shown = text.replace("&", "&amp;")
        words = shown.split(" ")
        if len(words) > 4 and self.r.random() < 0.3:
            i = self.r.randrange(len(words) - 1)
            inline = self.r.choice(("b", "em", "i", "span", "strong", 'a href="/x"'))
            words[i] = f"<{inline}>{words[i]}</{inline.split()[0]}>"
        shown = " ".join(words)
        if tag == "p" and self.r.random() < 0.08:
            self.put(f"<p><b>{shown}<br>")
        else:
            self.put(f"<{tag}>", shown, f"</{tag}>" if tag != "p" or self.r.random() < 0.9 else "")

    def links(self, lo: int, hi: int) -> None:
        items = [f'<a href="/{self.word()}">{self.phrase(1, 4)}</a>' for _ in range(self.r.randint(lo, hi))]
        kind = self.r.random()
        if kind < 0.6:
            self.put("<ul>", *(f"<li>{x}</li>" for x in items), "</ul>")
        elif kind < 0.8:
            self.put(*(f"<div>{x}</div>" for x in items))
        else:
            self.put(self.r.choice((" | ", " ", " · ")).join(items))

    def part(self, kind: str) -> None:
        """Something that is not the article."""
        r = self.r
        if kind == "nav":
            a, z = r.choice((("<nav>", "</nav>"), self.named("div", ["nav", "menu", "navbar", "breadcrumbs"])))
            self.put(a)
            self.links(2, 9)
        elif kind == "header":
            a, z = r.choice((("<header>", "</header>"), self.named("div", ["header", "masthead", "topbar"])))
            self.put(a)
            self.say(r.choice(("div", "p", "h2", "a")), self.phrase(1, 5), False)
            if r.random() < 0.5:
                self.say("p", self.prose(1, 1), False)
            if r.random() < 0.6:
                self.links(2, 6)
        elif kind == "footer":
            a, z = r.choice((("<footer>", "</footer>"), self.named("div", ["footer", "site-footer", "copyright"])))
            self.put(a)
            if r.random() < 0.5:
                self.links(1, 6)
            if r.random() < 0.8:
                self.put("&copy; ", self.phrase(1, 3), " &middot; ", self.prose(1, 1))
            for _ in range(r.randint(0, 2)):
                self.say("p", self.prose(1, 3), False)
        elif kind == "side":
            a, z = r.choice((("<aside>", "</aside>"), self.named("div", ["sidebar", "side", "widget", "right-rail"])))
            self.put(a)
            for _ in range(r.randint(1, 3)):
                self.say(r.choice(("h3", "h4", "p")), self.phrase(1, 4), False)
                if r.random() < 0.6:
                    self.links(1, 6)
                else:
                    self.say("p", self.prose(1, 3), False)
        elif kind == "ad":
            a, z = self.named(r.choice(("div", "div", "section", "aside", "p")), ["ad", "ads", "advert", "sponsored", "ad-slot", "banner", "promo"])
            self.put(f"<!-- ad {r.randint(0, 99)} -->" if r.random() < 0.4 else "", a)
            if a.startswith("<p") or r.random() < 0.6:
                self.put(self.prose(1, 3))
            else:
                self.say("p", self.prose(1, 3), False)
        elif kind == "notice":
            a, z = self.named(r.choice(("div", "section", "dialog")), ["notice", "cookie-banner", "consent", "alert", "popup", "cookie-notice"])
            self.put(a)
            self.say("p", self.prose(1, 4), False)
            if r.random() < 0.6:
                self.say("button", self.phrase(1, 2), False)
        elif kind == "form":
            a, z = r.choice((("<form>", "</form>"), ('<form action="/s" class="newsletter">', "</form>")))
            self.put(a)
            if r.random() < 0.6:
                self.say(r.choice(("p", "h3", "label")), self.prose(1, 2), False)
            self.put("<label>", self.phrase(1, 2), "</label><input name=q>")
            if r.random() < 0.3:
                self.put("<select>", *(f"<option>{self.word()}" for _ in range(3)), "</select>")
            self.say("button", self.phrase(1, 2), False)
        elif kind == "comments":
            a, z = self.named(r.choice(("section", "div")), ["comments", "comment-list", "reader-comments", "discussion"])
            self.put(a)
            if r.random() < 0.7:
                self.say("h3", self.phrase(1, 3), False)
            for _ in range(r.randint(1, 5)):
                if r.random() < 0.6:
                    self.put('<div class="comment">')
                    self.say(r.choice(("b", "div", "span")), self.phrase(1, 2), False)
                    self.say("p", self.prose(1, 5), False)
                    self.put("</div>")
                else:
                    self.say(r.choice(("p", "li")), self.prose(1, 5), False)
        else:
            a, z = self.named(r.choice(("div", "section", "aside")), ["related", "share", "social", "recommended", "more-links"])
            self.put(a)
            self.say(r.choice(("h3", "p")), self.phrase(1, 3), False)
            self.links(2, 6)
        self.put(z)

    def article(self) -> None:
        r = self.r
        if r.random() < 0.85:
            if r.random() < 0.15:
                self.put("<header>")
                self.say("h1", self.phrase(2, 12), True)
                self.put("</header>")
            else:
                self.say("h1", self.phrase(2, 12), True)
        plain = r.random() < 0.15  # paragraphs as bare div elements
        for _ in range(r.choice((1, 2, 3, 5, 8, 13))):
            kind = r.random()
            if kind < 0.72:
                self.say("div" if plain else "p", self.prose(1, r.choice((1, 2, 5, 12))), True)
            elif kind < 0.80:
                self.say(r.choice(("h2", "h3")), self.phrase(1, 6), True)
            elif kind < 0.87:
                tag = r.choice(("ul", "ol"))
                self.put(f"<{tag}>")
                for _ in range(r.randint(2, 5)):
                    self.say("li", self.phrase(2, 12) + r.choice((".", "")), True)
                self.put(f"</{tag}>")
            elif kind < 0.90:
                self.say(r.choice(("blockquote", "pre")), self.prose(1, 3), True)
            elif kind < 0.92:
                self.put("<table>")
                for _ in range(r.randint(1, 3)):
                    self.put("<tr>")
                    for _ in range(2):
                        self.say("td", self.phrase(1, 4), True)
                    self.put("</tr>")
                self.put("</table>")
            else:
                self.part(r.choice(("ad", "ad", "side", "form", "related", "notice")))
        if r.random() < 0.25:
            self.part(r.choice(("comments", "related", "form")))

    def page(self) -> str:
        r = self.r
        title = self.phrase(2, 10)
        self.put('<!DOCTYPE html><html lang="xx"><head><meta charset="utf-8"><title>', title, "</title>")
        self.put("<style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
        for kind, p in (("notice", 0.2), ("header", 0.5), ("nav", 0.7), ("form", 0.15), ("ad", 0.4), ("side", 0.2)):
            if r.random() < p:
                self.part(kind)
        wrap = r.random()
        if wrap < 0.45:
            open_, close = "<article>", "</article>"
        elif wrap < 0.6:
            open_, close = "<main>", "</main>"
        elif wrap < 0.9:
            open_, close = self.named("div", ["content", "article-body", "post", "entry-content", "story", "main", "text"])
        else:
            open_, close = "<div>", "</div>"
        if r.random() < 0.3:
            self.put("<div class=\"wrapper\">")
        self.put(open_)
        self.article()
        self.put(close)
        for kind, p in (("comments", 0.3), ("related", 0.25), ("side", 0.3), ("ad", 0.2), ("form", 0.15), ("footer", 0.8)):
            if r.random() < p:
                self.part(kind)
        self.put("</body></html>")
        return "".join(self.html)


def labelled_pages(n: int, seed: int) -> Iterator[tuple[str, set[str]]]:
    """``n`` pages and, for each, the texts of its main blocks."""
    r = random.Random(seed)
    for _ in range(n):
        p = _Page(r)
        yield p.page(), p.main
