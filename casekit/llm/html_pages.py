"""Labelled pages for training: layouts drawn at random, whose nodes are content or not by
construction (attribute ``data-y``). No page of any table is used."""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ren tas vel on dri sha pe cu bor ig nal tu fe os wi ma ler".split()
_INLINE = ("b", "i", "em", "strong", "span")

AD = ("ad", "ads", "advert", "ad-slot", "sponsor", "promo", "banner-ad", "advertisement", "adsbox", "sponsored-link")
MENU = ("menu", "nav", "navbar", "breadcrumb", "breadcrumbs", "pagination", "toc", "site-nav", "topnav", "tabs")
SIDE = ("sidebar", "widget", "related", "related-posts", "share", "social", "aside", "tags", "recommend", "trending", "author-box")
NOTICE = ("notice", "cookie", "cookie-banner", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "alert", "paywall", "disclaimer")
COMMENT = ("comments", "comment", "comment-list", "reply", "disqus", "responses", "discussion", "user-comments")
FOOT = ("footer", "site-footer", "copyright", "legal", "colophon", "bottom")
HEAD = ("header", "site-header", "masthead", "logo", "topbar", "branding")
BODY = ("content", "article", "post", "entry", "entry-content", "story", "main", "article-body", "text", "post-body", "page-content", "markdown")
NEUTRAL = ("", "", "", "row", "col", "wrapper", "container", "box", "inner", "x1", "section", "block")


class _Page:
    def __init__(self, seed: int, unknown: float = 0.2):
        self.r = random.Random(seed)
        #: Share of the parts whose name says nothing: pages of other makers have their own
        #: names, so that tags, links, lengths and neighbours must do.
        self.unknown = unknown
        self.names: dict[str, str] = {}

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 3))) for _ in range(r.randint(low, high))]
        if r.random() < 0.5:
            out[-1] += "."
        return " ".join(out)

    def node(self, tag: str, y: int, inner: str, name: str = "", extra: str = "") -> str:
        if name and tag != "article" and self.r.random() < self.unknown:
            name = self.names.setdefault(name, "".join(self.r.choices(_SYLLABLES, k=2)) + "-" + self.r.choice(_SYLLABLES))
        if name and self.r.random() < 0.3:
            name = f"{self.r.choice(('c', 'm', 'js'))}-x {name}"
        key = "id" if self.r.random() < 0.25 else "class"
        attr = f' {key}="{name}"' if name else ""
        return f'<{tag}{attr}{extra} data-y="{y}">{inner}</{tag}>'

    def text(self, low: int, high: int) -> str:
        out = self.words(low, high)
        if self.r.random() < 0.3:
            t = self.r.choice(_INLINE)
            out += f" <{t}>{self.words(1, 4)}</{t}> {self.words(1, 6)}"
        if self.r.random() < 0.15:
            out += f' <a href="/x">{self.words(1, 3)}</a> {self.words(1, 8)}'
        return out

    def links(self, y: int) -> str:
        r = self.r
        n = r.randint(1, 9)
        if r.random() < 0.7:
            tag = r.choice(("ul", "ul", "ol"))
            return self.node(tag, y, "".join(self.node("li", y, f'<a href="/a">{self.words(1, 3)}</a>') for _ in range(n)))
        return " ".join(f'<a href="/a">{self.words(1, 3)}</a>' for _ in range(n))

    def blocks(self, y: int, most: int = 9) -> str:
        r, out = self.r, []
        for _ in range(r.randint(1, most)):
            kind = r.random()
            if kind < 0.68:
                out.append(self.node("p", y, self.text(1, r.choice((3, 12, 60, 240)))))
            elif kind < 0.78:
                out.append(self.node(r.choice(("h2", "h3", "h4")), y, self.words(1, 7)))
            elif kind < 0.86:
                out.append(self.node(r.choice(("ul", "ol")), y, "".join(self.node("li", y, self.text(1, 15)) for _ in range(r.randint(1, 5)))))
            elif kind < 0.91:
                out.append(self.node("blockquote", y, self.node("p", y, self.text(3, 30))))
            elif kind < 0.94:
                out.append(self.node("pre", y, self.words(2, 20)))
            elif kind < 0.97:
                row = lambda: self.node("tr", y, "".join(self.node("td", y, self.words(1, 3)) for _ in range(3)))
                out.append(self.node("table", y, "".join(row() for _ in range(r.randint(1, 3)))))
            else:
                out.append(self.node("figure", y, self.node("figcaption", y, self.words(2, 10))))
            if r.random() < 0.03:
                out[-1] = self.node(r.choice(("ins", "del")), y, out[-1])
        return "".join(out)

    def boiler(self, inside: bool) -> str:
        r = self.r
        kind = r.choice(("ad", "menu", "side", "notice", "comment", "form"))
        if kind == "ad":
            return self.node(r.choice(("div", "div", "aside", "ins", "section")), 0, r.choice((self.words(2, 15), self.node("p", 0, self.words(3, 20)), self.links(0))), r.choice(AD))
        if kind == "menu":
            return self.node("nav", 0, self.links(0), r.choice((*MENU, ""))) if r.random() < 0.6 else self.node("div", 0, self.links(0), r.choice(MENU))
        if kind == "side":
            title = self.node("h3", 0, self.words(1, 3)) if r.random() < 0.6 else ""
            body = r.choice((self.links(0), self.node("p", 0, self.text(3, 25))))
            return self.node("aside", 0, title + body, r.choice((*SIDE, "", ""))) if r.random() < 0.5 else self.node("div", 0, title + body, r.choice(SIDE))
        if kind == "notice":
            body = r.choice((self.words(3, 25), self.node("p", 0, self.text(3, 30)) + self.node("button", 0, self.words(1, 2))))
            return self.node(r.choice(("div", "div", "section", "aside")), 0, body, r.choice(NOTICE), r.choice(("", "", ' role="alert"', ' role="dialog"')))
        if kind == "comment":
            one = lambda t, names: self.node(t, 0, self.node("p", 0, self.text(2, r.choice((50, 50, 150)))), r.choice(names))
            kinds = (("div", ("comment", "reply", "comment-body", "")), ("li", ("comment", "")), ("article", ("comment", "reply")))
            head = self.node("h3", 0, self.words(1, 3)) if r.random() < 0.5 else ""
            return self.node(r.choice(("section", "div", "ol")), 0, head + "".join(one(*r.choice(kinds)) for _ in range(r.randint(1, 4))), r.choice(COMMENT))
        fields = self.node("label", 0, self.words(1, 3)) + r.choice(("<input>", self.node("button", 0, self.words(1, 2)), self.node("select", 0, self.node("option", 0, self.words(1, 2)))))
        return self.node("form", 0, r.choice(("", self.node("p", 0, self.words(2, 12)))) + fields, r.choice(("", "search", "login", "subscribe")))

    def mixed(self, inside: bool, most: int) -> str:
        return "".join(self.boiler(inside) for _ in range(self.r.randint(0, most)))

    def article(self) -> str:
        r = self.r
        title = self.node("h1", 1, self.words(1, 12)) if r.random() < 0.8 else ""
        parts = self.blocks(1, r.choice((1, 1, 9, 9)))
        if r.random() < 0.6:
            parts += (self.mixed(True, 2) if r.random() < 0.7 else "") + (self.blocks(1) if r.random() < 0.8 else "")
        if r.random() < 0.15:
            parts += self.mixed(True, 1)
        kind = r.random()
        if kind < 0.55:
            return self.node("article", 1, title + parts, r.choice((*BODY, "", "", "")))
        if kind < 0.7:
            return self.node("main", 1, title + parts, r.choice((*BODY, "")))
        if kind < 0.9:
            return self.node(r.choice(("div", "div", "section")), 1, title + parts, r.choice(BODY))
        return self.node("article", 1, title + self.node(r.choice(("div", "section")), 1, parts, r.choice((*BODY, *NEUTRAL))))

    def make(self) -> str:
        r = self.r
        header = self.node("header", 0, self.node(r.choice(("div", "h1", "h1", "p")), 0, self.words(1, 4), r.choice((*HEAD, "", ""))) + (self.node("nav", 0, self.links(0)) if r.random() < 0.5 else ""), r.choice((*HEAD, ""))) if r.random() < 0.45 else ""
        if header and r.random() < 0.3:
            header = self.node("div", 0, self.words(1, 6), r.choice(HEAD))
        footer = self.node("footer", 0, r.choice((self.words(3, 15), self.node("p", 0, self.words(3, 20)), self.links(0), self.words(1, 4) + self.node("p", 0, self.words(1, 9)))), r.choice((*FOOT, "")))
        if r.random() < 0.3:
            footer = self.node("div", 0, self.words(3, 15), r.choice(FOOT))
        core = self.article()
        for _ in range(r.choice((0, 0, 1, 2))):
            core = self.node("div", 0, self.mixed(False, 1) + core + self.mixed(False, 1), r.choice(NEUTRAL))
        if r.random() < 0.06:
            return self.node("body", 1, self.node("h1", 1, self.words(1, 6)) + self.blocks(1))
        if r.random() < 0.12:
            return core  # a page that is cut, or has no body tag
        page = header + self.mixed(False, 2) + core + self.mixed(False, 2) + (footer if r.random() < 0.85 else "")
        return self.node("body", 0, page)


def labelled_pages(n: int, seed: int = 5, unknown: float = 0.2) -> list[str]:
    """``n`` bodies of pages with a ``data-y`` on every element but inline ones; ``unknown``
    is the share of names that say nothing."""
    return [_Page(seed * 1_000_003 + i, unknown).make() for i in range(n)]
