"""Labelled pages for the extractor's training: many layouts, filled with made-up words.

Every block is marked as main text or not when it is written, so the labels are exact. Layouts cover
semantic tags, plain containers told apart by class or id only, and tables, with menus, headers,
footers, sidebars, notices, adverts, forms, sharing, related links and reader comments around, between
and inside the main text.
"""

from __future__ import annotations

import random

SYLLABLES = "the an re on er in st nd at en ti es or ha ou ing ly ed sh lo mi ka ru ve so pa".split()


class Page:
    """Collects markup and the blocks' labels."""

    def __init__(self, rng: random.Random):
        self.rng, self.out, self.labels = rng, [], []

    def words(self, low: int, high: int) -> str:
        r = self.rng
        n = r.randint(low, high)
        out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
        for i in range(n):
            if r.random() < 0.1:
                out[i] += r.choice(".,")
            if r.random() < 0.1:
                out[i] = out[i].capitalize()
        return " ".join(out)

    def block(self, tag: str, text: str, main: bool, attr: str = "") -> None:
        close = f"</{tag}>" if tag != "p" or self.rng.random() < 0.8 else ""
        self.out.append(f"<{tag}{attr}>{text}{close}")
        self.labels.append(int(main))

    def open(self, tag: str, name: str = "") -> str:
        key = self.rng.choice(("class", "class", "id"))
        self.out.append(f'<{tag} {key}="{name}">' if name else f"<{tag}>")
        return f"</{tag}>"

    def links(self, low: int, high: int) -> None:
        self.out.append("<ul>")
        for _ in range(self.rng.randint(low, high)):
            self.block("li", f'<a href="/x">{self.words(1, 4)}</a>', False)
        self.out.append("</ul>")


def _menu(p: Page) -> None:
    r = p.rng
    end = r.choice([lambda: p.open("nav"), lambda: p.open("nav", "main-nav"), lambda: p.open("div", r.choice(
        ("menu", "navbar", "nav-links", "breadcrumbs", "topmenu", "navigation"))), lambda: p.open("ul", "menu")])()
    p.links(2, 9)
    p.out.append(end)


def _header(p: Page) -> None:
    end = p.rng.choice([lambda: p.open("header"), lambda: p.open("div", p.rng.choice(("header", "site-header", "masthead", "topbar")))])()
    p.block(p.rng.choice(("h1", "div", "p")), p.words(1, 5), False)
    if p.rng.random() < 0.5:
        p.block("p", p.words(3, 10), False)
    if p.rng.random() < 0.4:
        _menu(p)
    p.out.append(end)


def _footer(p: Page) -> None:
    r = p.rng
    end = r.choice([lambda: p.open("footer"), lambda: p.open("footer"), lambda: p.open("div", r.choice(
        ("footer", "site-footer", "copyright", "legal")))])()
    mark = r.choice(("&copy; ", "&copy; 2024 ", "Copyright ", ""))
    text = f"{mark}{p.words(1, 2)} &middot; {p.words(3, 30)}"
    if r.random() < 0.5:
        p.out.append(text)
        p.labels.append(0)
    else:
        p.block("p", text, False)
    if r.random() < 0.4:
        p.links(2, 5)
    p.out.append(end)


def _side(p: Page) -> None:
    r = p.rng
    end = r.choice([lambda: p.open("aside"), lambda: p.open("div", r.choice(
        ("sidebar", "side", "widget", "related", "related-posts", "popular", "right-column", "recommended")))])()
    if r.random() < 0.7:
        p.block(r.choice(("h2", "h3", "h4")), p.words(1, 4), False)
    if r.random() < 0.6:
        p.links(2, 6)
    for _ in range(r.randint(0, 2)):
        p.block("p", p.words(4, 60), False)
    p.out.append(end)


def _advert(p: Page) -> None:
    r = p.rng
    end = p.open(r.choice(("div", "div", "section", "aside")), r.choice(
        ("ad", "ads", "advert", "advertisement", "ad-banner", "sponsored", "promo", "banner", "adbox")))
    text = p.words(3, 40)
    if r.random() < 0.6:
        p.out.append(text)
        p.labels.append(0)
    else:
        p.block("p", text, False)
    p.out.append(end)


def _notice(p: Page) -> None:
    r = p.rng
    end = p.open("div", r.choice(("cookie", "cookie-notice", "cookie-banner", "consent", "notice", "alert", "gdpr", "popup", "warning", "message")))
    if r.random() < 0.5:
        p.out.append(p.words(5, 40))
        p.labels.append(0)
    else:
        p.block("p", p.words(5, 40), False)
    if r.random() < 0.6:
        p.block("button", p.words(1, 2), False)
    p.out.append(end)


def _form(p: Page) -> None:
    r = p.rng
    wrap = p.open("div", r.choice(("newsletter", "subscribe", "signup", "login", "search"))) if r.random() < 0.5 else ""
    p.out.append('<form action="/go">')
    if r.random() < 0.6:
        p.block(r.choice(("p", "label", "legend")), p.words(1, 20), False)
    p.out.append('<input type="text" value="x">')
    if r.random() < 0.4:
        p.out.append("<select>")
        for _ in range(3):
            p.block("option", p.words(1, 2), False)
        p.out.append("</select>")
    p.block("button", p.words(1, 2), False)
    p.out.append("</form>" + wrap)


def _comments(p: Page) -> None:
    r = p.rng
    outer = p.open(r.choice(("section", "div", "div", "ol")), r.choice(
        ("comments", "comment-list", "commentlist", "discussion", "reader-comments", "responses", "replies", "user-comments")))
    if r.random() < 0.7:
        p.block(r.choice(("h2", "h3", "h4")), p.words(1, 3), False)
    for _ in range(r.randint(1, 5)):
        tag = r.choice(("div", "li", "article", "p"))
        if tag == "p":
            p.block("p", p.words(5, 80), False)
            continue
        inner = p.open(tag, r.choice(("comment", "comment-body", "reply", "")) or "")
        if r.random() < 0.5:
            p.block("span" if r.random() < 0.1 else "div", p.words(1, 3), False)
        for _ in range(r.randint(1, 2)):
            p.block("p", p.words(5, 80), False)
        p.out.append(inner)
    p.out.append(outer)


EXTRAS = (_side, _advert, _notice, _form, _menu)


def _main(p: Page) -> None:
    r = p.rng
    ends = []
    shape = r.random()
    if shape < 0.5:
        if r.random() < 0.4:
            ends.append(p.open("main"))
        ends.append(p.open("article", r.choice(("", "", "post", "entry"))))
    elif shape < 0.6:
        ends.append(p.open("main"))
    else:
        for name in r.choice((["content"], ["main", "post"], ["container", "entry-content"], ["article-body"],
                              ["page", "story"], ["post-content"], ["main-content", "text"])):
            ends.append(p.open(r.choice(("div", "div", "section")), name))
    if r.random() < 0.8:
        wrap = p.open("header") if shape < 0.5 and r.random() < 0.15 else ""
        p.block(r.choice(("h1", "h1", "h2")), p.words(2, 12), True)
        p.out.append(wrap)
    for _ in range(r.randint(1, 8)):
        kind = r.random()
        if kind < 0.72:
            text = p.words(1, 120)
            if r.random() < 0.2:
                text = f"<b>{text}<br>"
            elif r.random() < 0.25:
                text = f'{p.words(1, 20)} <a href="/y">{p.words(1, 3)}</a> {text}'
            p.block("p", text, True)
        elif kind < 0.8:
            p.block(r.choice(("h2", "h3", "h4")), p.words(1, 7), True)
        elif kind < 0.88:
            tag = r.choice(("ul", "ol"))
            p.out.append(f"<{tag}>")
            for _ in range(r.randint(2, 5)):
                p.block("li", p.words(1, 25), True)
            p.out.append(f"</{tag}>")
        elif kind < 0.94:
            p.block(r.choice(("blockquote", "pre", "figcaption")), p.words(3, 50), True)
        else:
            p.out.append("<table>")
            for _ in range(r.randint(1, 3)):
                p.out.append("<tr>")
                for _ in range(2):
                    p.block("td", p.words(1, 8), True)
                p.out.append("</tr>")
            p.out.append("</table>")
        if r.random() < 0.08:
            r.choice(EXTRAS)(p)
    if r.random() < 0.12:
        _comments(p)
    p.out += ends[::-1]


def page(seed: int) -> tuple[str, list[int]]:
    """Markup of one page and the labels of its blocks, in order."""
    r = random.Random(seed)
    p = Page(r)
    p.out.append('<!DOCTYPE html><html><head><meta charset="utf-8"><title>x</title><script>var t="</p>";</script></head><body>')
    if r.random() < 0.4:
        _header(p)
    for part in (_menu, _notice, _advert, _form, _side):
        if r.random() < 0.4:
            part(p)
    _main(p)
    for part in (_comments, _side, _advert, _form, _menu, _notice):
        if r.random() < 0.3:
            part(p)
    if r.random() < 0.8:
        _footer(p)
    if r.random() < 0.9:
        p.out.append("</body></html>")
    return "".join(p.out), p.labels
