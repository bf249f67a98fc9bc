"""Labelled pages made by rule, to train the extractor: invented words in many page layouts."""

from __future__ import annotations

import random

PLACES = {
    "menu": (("nav",), ("nav", "menu", "main-nav", "site-navigation", "breadcrumb", "topbar")),
    "head": (("header", "div"), ("header", "site-header", "masthead", "page-head", "logo")),
    "foot": (("footer", "div"), ("footer", "site-footer", "copyright", "bottom", "page-foot")),
    "side": (("aside", "div", "section"), ("sidebar", "side", "related", "widget", "rail", "recommended")),
    "notice": (("div", "section", "aside"), ("cookie-notice", "notice", "alert", "consent", "privacy-popup")),
    "advert": (("div", "aside", "section"), ("ad", "ads", "advert", "sponsored", "promo", "ad-slot")),
    "form": (("form",), ("search", "newsletter", "subscribe", "login-form", "contact")),
    "comments": (("section", "div", "ol"), ("comments", "comment-list", "reader-comments", "replies", "respond")),
    "share": (("div", "ul"), ("share", "social", "share-tools", "follow")),
}
BODIES = (
    ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "post"),
    ("div", "entry-content"), ("section", "story"), ("div", "main"), ("div", "page-text"), ("div", ""),
)


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = "etaoinshrdlucmfwypvbg"
        self.words = ["".join(self.r.choice(letters) for _ in range(self.r.randint(1, 9))) for _ in range(600)]

    def sentence(self, low: int = 3, high: int = 22) -> str:
        row = [self.r.choice(self.words) for _ in range(self.r.randint(low, high))]
        if len(row) > 6 and self.r.random() < 0.6:
            row[len(row) // 2] += ","
        return " ".join(row).capitalize() + self.r.choice("...!?")

    def prose(self, most: int = 8) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def few(self, most: int = 3) -> str:
        return " ".join(self.r.choice(self.words) for _ in range(self.r.randint(1, most)))

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.choice(self.words)}">{text}</a>'

    def wrap(self, tag: str, name: str, inner: str) -> str:
        how = self.r.choice(('class="{}"', "class='{}'", 'id="{}"', 'class="x1 {}"')) if name else ""
        return f"<{tag}{' ' if name else ''}{how.format(name)}>{inner}</{tag}>"

    def links(self) -> str:
        rows = [self.link(self.few()) for _ in range(self.r.randint(2, 9))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in rows) + "</ul>"
        return self.r.choice((" | ", " ", "\n")).join(rows)

    def aside_text(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            return self.links()
        if kind == "head":
            return r.choice((f"<h1>{self.few()}</h1>", f"<p>{self.few(6)}</p>", self.few(4), self.link(self.few())))
        if kind == "foot":
            said = r.choice(("&copy; 2024 ", "© ", "", "(c) ")) + r.choice((self.prose(2), self.few(5)))
            return said + r.choice(("", self.links()))
        if kind == "side":
            return f"<h3>{self.few()}</h3>" + r.choice((self.links(), f"<p>{self.prose(4)}</p>"))
        if kind == "form":
            return f'<label>{self.few()}</label><input type="text"><p>{self.sentence()}</p><button>{self.few(2)}</button>'
        if kind == "comments":
            rows = [f"<b>{self.few(2)}</b> <p>{self.prose(6)}</p>" for _ in range(r.randint(1, 6))]
            return "".join(self.wrap("li" if r.random() < 0.3 else "div", r.choice(("comment", "reply", "")), x) for x in rows)
        if kind == "share":
            return self.links()
        return r.choice((self.prose(2), f"<p>{self.prose(4)}</p>", self.link(self.sentence()), f"<p>{self.sentence()}</p>"))

    def boiler(self, kind: str) -> str:
        tags, names = PLACES[kind]
        tag = self.r.choice(tags)
        bare = tag in ("nav", "header", "footer", "aside", "form") and self.r.random() < 0.5
        return self.wrap(tag, "" if bare else self.r.choice(names), self.aside_text(kind))

    def inside(self) -> list[str]:
        r = self.r
        rows = []
        for _ in range(r.choice((0, 1, 1, 2, 4, 8, 14))):
            x = r.random()
            text = self.prose()
            if x < 0.1:
                text = text.replace(" ", f" {self.link(self.few())} ", 1)
            if x < 0.72:
                rows.append(f"<p>{text}</p>")
            elif x < 0.78:
                rows.append(f"<p><b>{text}<br>")
            elif x < 0.84:
                rows.append(f"<h2>{self.few(5)}</h2>")
            elif x < 0.9:
                rows.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif x < 0.95:
                rows.append(f"<blockquote>{text}</blockquote>")
            elif x < 0.98:
                rows.append(f"<div>{text}</div>")
            else:
                rows.append(f"<table><tr><td>{self.few()}</td><td>{self.few()}</td></tr></table>")
        return rows or [f"<p>{self.few(4)}</p>"]

    def page(self) -> list[tuple[str, bool | None]]:
        """Pieces of a page with whether they are main text; None for what lies round them."""
        r = self.r
        out: list[tuple[str, bool | None]] = [(f"<html><head><title>{self.few()}</title></head><body>", None)]
        before = [k for k in ("head", "menu", "notice", "advert", "side", "share") if r.random() < 0.45]
        after = [k for k in ("side", "comments", "share", "advert", "form", "notice", "menu", "foot") if r.random() < 0.45]
        r.shuffle(before)
        out += [(self.boiler(k), False) for k in before]
        outer = r.random() < 0.3
        if outer:
            out.append((r.choice(('<div id="wrap">', "<main>", '<div class="container">')), None))
        tag, name = r.choice(BODIES)
        out.append((self.wrap(tag, name, "")[: -len(f"</{tag}>")], None))
        title = f"<h1>{r.choice((self.few(6), self.sentence()))}</h1>"
        if r.random() < 0.8:
            out.append((f"<header>{title}</header>" if r.random() < 0.15 else title, True))
        for row in self.inside():
            out.append((row, True))
            if r.random() < 0.06:
                out.append((self.boiler(r.choice(("advert", "share", "side", "form", "notice"))), False))
        if r.random() < 0.1:
            out.append((self.boiler("comments"), False))
        out.append((f"</{tag}>", None))
        if outer and r.random() < 0.5:
            out.append(("</div></main>", None))
        out += [(self.boiler(k), False) for k in after]
        out.append(("</body></html>", None))
        return out


# Characters no page of the maker holds: they carry the label of a text run through the parser.
MAIN, OTHER = chr(0xE000), chr(0xE001)


def labelled_pages(count: int, seed: int) -> list[str]:
    """Pages whose text runs end in ``MAIN`` or ``OTHER``."""
    import re

    maker = Maker(seed)
    text = re.compile(r">([^<]+)(?=<)|^([^<]+)")
    pages = []
    for _ in range(count):
        parts = []
        for piece, main in maker.page():
            if main is not None:
                mark = MAIN if main else OTHER
                piece = text.sub(lambda m, k=mark: m[0] + k if m[0].strip(">").strip() else m[0], piece)
            parts.append(piece)
        pages.append("".join(parts))
    return pages
