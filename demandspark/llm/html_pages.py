"""Labelled pages for the DOM model: layouts written by rule, each part marked as main text or not.

``data-main`` holds for an element and all inside it until another mark. The layouts vary in their containers, names
and order, so that the model learns tags, names, text amounts and the ties between an element and the one around it.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

PAGES = 800
_SYLLABLES = "an be co da el fi go hu in ka lo me na or pe qui ra so tu ve".split()


class _Writer:
    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def pick(self, *choices: str) -> str:
        return self.random.choice(choices)

    def chance(self, share: float) -> bool:
        return self.random.random() < share

    def words(self, low: int, high: int) -> str:
        r = self.random
        return " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def links(self, low: int, high: int, item: str = "li") -> str:
        return "".join(f'<{item}><a href="/x">{self.words(1, 3)}</a></{item}>' for _ in range(self.random.randint(low, high)))

    def named(self, *names: str) -> str:
        return f'{self.pick("class", "class", "id")}="{self.pick(*names)}"'

    def unknown(self) -> str:
        """Names no page has twice, or none: what bears them must be told by its place."""
        return self.pick("", f'class="{self.words(1, 2).replace(" ", "")}"')

    def sentences(self, most: int) -> str:
        """One to ``most`` paragraphs, as long as those of an article."""
        return "".join(f"<p>{self.words(4, 60)}</p>" for _ in range(self.random.randint(1, most)))

    def paragraph(self) -> str:
        text = self.words(1, 8) if self.chance(0.2) else self.words(15, 120)
        if self.chance(0.3):
            text = f"<b>{text}<br>"
        if self.chance(0.3):
            text += f' <a href="/y">{self.words(1, 4)}</a> ' + self.words(5, 20)
        return f"<p>{text}" + ("</p>" if self.chance(0.9) else "")

    def article(self) -> str:
        if self.chance(0.1):
            return f"<p>{self.words(1, 6)}</p>"
        parts = [f"<h1>{self.words(2, 10)}</h1>"] if self.chance(0.7) else []
        for _ in range(self.random.randint(0, 9)):
            kind = self.random.random()
            if kind < 0.7:
                parts.append(self.paragraph())
            elif kind < 0.78:
                parts.append(f"<h2>{self.words(1, 6)}</h2>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{self.words(2, 25)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote><p>{self.words(5, 40)}</p></blockquote>")
            elif kind < 0.94:
                parts.append(f"<table><tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr></table>")
            elif kind < 0.97:
                parts.append(f"<pre>{self.words(5, 30)}</pre><figure><figcaption>{self.words(3, 12)}</figcaption></figure>")
            else:
                parts.append(f"<div>{self.words(10, 60)}</div>")
        if self.chance(0.25):
            parts.insert(self.random.randint(0, len(parts)), self.other_inside())
        if not parts or self.chance(0.05):
            parts.append(self.words(5, 60))
        return "".join(parts)

    def other_inside(self) -> str:
        return self.pick(
            f'<div {self.named("share", "social-links", "sharing")} data-main="0"><ul>{self.links(2, 5)}</ul></div>',
            f'<div {self.named("ad", "ads", "advert", "advertisement", "ad-slot")} data-main="0">{self.words(3, 30)}</div>',
            f'<aside {self.named("related", "related-posts", "promo")} data-main="0"><h3>{self.words(1, 3)}</h3><ul>{self.links(2, 6)}</ul></aside>',
            f'<aside {self.unknown()} data-main="0">{self.sentences(8)}</aside>',
            f'<form action="/s" data-main="0"><label>{self.words(1, 3)}</label><input name="e"><p>{self.words(3, 12)}</p></form>',
            self.comments(),
        )

    def comments(self) -> str:
        tag = self.pick("div", "section", "ol", "aside")
        inner = self.pick("div", "article", "li") if tag != "ol" else "li"
        each = "".join(
            f'<{inner} class="{self.pick("comment", "comment-body", "reply", "comment depth")}"><p>{self.words(3, 60)}</p></{inner}>'
            for _ in range(self.random.randint(1, 5))
        )
        if self.chance(0.4):  # nothing but the place tells
            name = self.unknown()
            each = "".join(f"<div {name}><p>{self.words(3, 60)}</p></div>" for _ in range(self.random.randint(1, 5)))
            return f'<section {self.unknown()} data-main="0"><h3>{self.words(1, 2)}</h3>{each}</section>'
        return f'<{tag} {self.named("comments", "commentlist", "comment-list", "disqus-thread comments", "reader-comments")} data-main="0"><h3>{self.words(1, 2)}</h3>{each}</{tag}>'

    def other(self) -> str:
        top = self.pick("nav", "nav", "header", "div")
        return self.pick(
            f'<{top} {self.named("nav", "menu", "navbar", "main-navigation", "topbar")} data-main="0"><ul>{self.links(3, 10)}</ul></{top}>',
            f'<nav data-main="0"><ul>{self.links(2, 9)}</ul></nav>',
            f'<header data-main="0"><div {self.named("logo", "brand", "site-title")}>{self.words(1, 4)}</div></header>',
            f'<div {self.named("header", "masthead", "site-header", "banner")} data-main="0">{self.words(1, 12)}</div>',
            f'<aside {self.unknown()} data-main="0"><h3>{self.words(1, 3)}</h3>{self.sentences(12)}</aside>',
            f'<aside {self.unknown()} data-main="0">{self.pick("<div>|</div>", "|").replace("|", self.sentences(12))}</aside>',
            f'<div {self.named("sidebar", "side-bar", "widget", "widget-area")} data-main="0"><h4>{self.words(1, 3)}</h4>{self.sentences(6)}<ul>{self.links(2, 8)}</ul></div>',
            f'<div {self.named("ad", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad")} data-main="0">{self.words(2, 40)}</div>',
            f'<div {self.named("cookie-notice", "cookie-banner", "notice", "consent", "newsletter", "popup", "gdpr", "alert")} data-main="0"><p>{self.words(4, 40)}</p></div>',
            f'<form {self.named("search", "search-form", "login", "subscribe")} data-main="0"><label>{self.words(1, 4)}</label><input name="q"><p>{self.words(2, 20)}</p></form>',
            f'<div {self.named("breadcrumb", "breadcrumbs", "pagination", "tags")} data-main="0"><ul>{self.links(2, 5)}</ul></div>',
        )

    def footer(self) -> str:
        tag = self.pick("footer", "footer", "div")
        name = "" if tag == "footer" and self.chance(0.6) else self.named("footer", "site-footer", "page-footer", "copyright")
        return f'<{tag} {name} data-main="0">&copy; {self.words(2, 40)}</{tag}>'

    def page(self) -> str:
        bare = self.random.random()
        if bare < 0.06:  # a fragment: the root itself is the text
            return f'<html data-main="1">{self.pick(self.words(5, 200), self.article())}</html>'
        if bare < 0.12:  # no container
            others = [self.other() for _ in range(self.random.randint(0, 3))]
            return f'<html><body data-main="1">{"".join(others[:1])}{self.article()}{"".join(others[1:])}{self.footer()}</body></html>'
        before = "".join(self.other() for _ in range(self.random.randint(1, 4)))
        after = "".join(self.other() for _ in range(self.random.randint(0, 2)))
        comments = self.comments() if self.chance(0.5) else ""
        opening, closing = self.pick(
            "<article>|</article>", "<article>|</article>", "<main>|</main>", "<main><article>|</article></main>",
            f'<div {self.named("content", "main", "main-content", "post", "entry-content", "article-body", "story")}>|</div>',
            f'<section {self.named("content", "article", "post", "entry")}>|</section>',
            f'<div {self.named("wrapper", "container", "page")} data-main="0"><article data-main="1">|</article></div>',
            f"<article {self.unknown()}>|</article>", f"<div {self.unknown()}>|</div>",
            '<div>|</div>', '<div role="main">|</div>',
        ).split("|")
        if "data-main" not in opening:
            opening = opening.replace(">", ' data-main="1">', 1)
        body = f"{before}{opening}{self.article()}{closing}{comments}{after}{self.footer()}"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title></head><body>{body}</body></html>"


def labelled_pages(count: int = PAGES) -> Iterator[str]:
    for seed in range(count):
        yield _Writer(seed).page()
