"""Labelled pages for fitting the extractor: layouts that differ in tags, class names,
order and faults, filled with made-up words. Labels belong to leaf blocks; content is
what an article has without the furniture around and inside it."""

from __future__ import annotations

import random

_SYLLABLES = "ba ce di fo gu ha jo ki la mer nos pa qui ras sen tor ul vi wan xe yor zin".split()


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.other = random.Random(-seed)
        self.labels: list[int] = []

    def word(self):
        return "".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, low, high):
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentences(self, low, high):
        made = []
        for _ in range(self.r.randint(low, high)):
            made.append(self.words(1, 25).capitalize() + self.r.choice([".", ".", ".", "?", "!"]))
        return " ".join(made)

    def text(self, label: int, text: str):
        """A leaf block of text; every call makes exactly one block."""
        self.labels.append(label)
        return text

    def pick(self, *options):
        return self.r.choice(options)

    def maybe(self, share: float, make):
        return make() if self.r.random() < share else ""

    # Furniture -----------------------------------------------------------
    def links(self, low=2, high=8):
        return "".join(f'<li><a href="/{self.word()}">{self.text(0, self.words(1, 3))}</a></li>'
                       for _ in range(self.r.randint(low, high)))

    def menu(self):
        name = self.pick("", ' class="menu"', ' id="nav"', ' class="main-nav navbar"', ' role="navigation"')
        tag = "nav" if not name or self.r.random() < 0.5 else "div"
        return f"<{tag}{name}><ul>{self.links()}</ul></{tag}>"

    def top(self):
        inner = f"<h2>{self.text(0, self.words(1, 4))}</h2>" + self.maybe(
            0.5, lambda: f"<p>{self.text(0, self.words(2, 9))}</p>") + self.maybe(0.4, self.menu)
        return self.pick(f"<header>{inner}</header>", f'<div class="site-header">{inner}</div>',
                         f'<div id="header" role="banner">{inner}</div>')

    def bottom(self):
        inner = f"<p>{self.text(0, '&copy; ' + self.words(1, 3) + ' &middot; ' + self.sentences(1, 2))}</p>" + self.maybe(
            0.4, lambda: f"<ul>{self.links(1, 4)}</ul>")
        if self.r.random() < 0.4:
            inner = inner.replace("<p>", "", 1).replace("</p>", "", 1)
        return self.pick(f"<footer>{inner}</footer>", f'<div class="footer">{inner}</div>',
                         f'<div id="site-footer">{inner}</div>')

    def side(self):
        inner = f"<h3>{self.text(0, self.words(1, 3))}</h3>" + self.pick(
            lambda: f"<ul>{self.links()}</ul>", lambda: f"<p>{self.text(0, self.sentences(1, 4))}</p>")()
        return self.pick(f"<aside>{inner}</aside>", f'<div class="sidebar">{inner}</div>',
                         f'<div class="widget related-posts">{inner}</div>', f'<section class="related">{inner}</section>')

    def advert(self):
        name = self.pick("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner-ad")
        tag = self.pick("div", "div", "section", "aside")
        paragraph = self.r.random() < 0.4
        body = self.text(0, self.sentences(1, 3))
        return f'<{tag} class="{name}">{f"<p>{body}</p>" if paragraph else body}</{tag}>'

    def notice(self):
        name = self.pick("cookie-notice", "notice", "consent", "alert", "gdpr-banner", "popup", "cookie", "modal")
        body = self.text(0, self.sentences(1, 2))
        button = self.maybe(0.5, lambda: f"<button>{self.text(0, self.words(1, 2))}</button>")
        key = self.pick("class", "id")
        return f'<div {key}="{name}"><p>{body}</p>{button}</div>'

    def form(self):
        name = self.pick("", ' class="newsletter"', ' class="search"', ' id="login"')
        return (f"<form{name}><label>{self.text(0, self.words(1, 4))}</label><br>"
                f"<input name='a'><button>{self.text(0, self.words(1, 2))}</button></form>")

    def comments(self):
        made = []
        for _ in range(self.r.randint(1, 4)):
            who = self.maybe(0.6, lambda: f"<b>{self.text(0, self.word())}</b><br>")
            inner = f"{who}<p>{self.text(0, self.sentences(1, 4))}</p>"
            made.append(self.pick(f'<div class="comment">{inner}</div>', f"<li>{inner}</li>",
                                  f'<article class="comment">{inner}</article>'))
        head = ""
        if self.r.random() < 0.6:
            self.labels.insert(len(self.labels) - self._count("".join(made)), 0)
            head = f"<h3>{self.words(1, 3)}</h3>"
        return self.pick(
            f'<section class="comments">{head}{"".join(made)}</section>',
            f'<div id="comments">{head}{"".join(made)}</div>',
            f'<ol class="comment-list">{head}{"".join(made)}</ol>',
            f'<div class="reader-comments">{head}{"".join(made)}</div>')

    @staticmethod
    def _count(markup):
        from millrace.llm.html_blocks import blocks

        return len(blocks(markup))

    def share(self):
        return f'<div class="{self.pick("share", "social", "tags", "byline", "meta")}">{self.text(0, self.words(1, 6))}</div>'

    def unscripted(self, share: float, label: int):
        """A block for browsers without scripts, from draws of its own."""
        self.r, self.other = self.other, self.r
        made = self.maybe(share, lambda: "<noscript>" + self.pick("<p>{}</p>", "<div>{}</div>", "{}").format(
            self.text(label, self.sentences(1, 3))) + "</noscript>")
        self.r, self.other = self.other, self.r
        return made

    # Content -------------------------------------------------------------
    def paragraph(self):
        kind = self.r.random()
        if kind < 0.62:
            tag = self.pick("p", "p", "p", "p", "div")
            return f"<{tag}>{self.text(1, self.inline(self.sentences(1, 6)))}</{tag}>"
        if kind < 0.70:
            return f"<p><b>{self.text(1, self.sentences(1, 4))}<br>"
        if kind < 0.80:
            return f"<h{self.r.randint(2, 4)}>{self.text(1, self.words(1, 7))}</h2>"
        if kind < 0.86:
            items = "".join(f"<li>{self.text(1, self.sentences(1, 2))}</li>" for _ in range(self.r.randint(1, 4)))
            return f"<ul>{items}</ul>"
        if kind < 0.90:
            return f"<blockquote><p>{self.text(1, self.sentences(1, 3))}</p></blockquote>"
        if kind < 0.93:
            rows = "".join(f"<tr><td>{self.text(1, self.words(1, 3))}</td><td>{self.text(1, self.words(1, 3))}</td></tr>"
                           for _ in range(self.r.randint(1, 3)))
            return f"<table>{rows}</table>"
        if kind < 0.96:
            return f"<pre>{self.text(1, self.words(3, 20))}</pre>"
        return f"<figure><img src='x'><figcaption>{self.text(1, self.words(2, 9))}</figcaption></figure>"

    def inline(self, text):
        kind = self.r.random()
        if kind < 0.7:
            return text
        cut = text.split(" ")
        i = self.r.randrange(len(cut))
        tag = self.pick("b", "i", "em", "strong", "span", "a href='/x'")
        cut[i] = f"<{tag}>{cut[i]}</{tag.split()[0]}>"
        return " ".join(cut)

    def article(self):
        parts = []
        title = self.r.random()
        if title < 0.85:
            markup = f"<h1>{self.text(1, self.words(1, 12))}</h1>"
            parts.append(f"<header>{markup}</header>" if title < 0.12 else markup)
        if self.r.random() < 0.15:
            parts.append(self.share())
        for _ in range(self.pick(1, 2, 3, 4, 6, 9, 14)):
            parts += [self.paragraph(), self.unscripted(0.03, 1)]
            if self.r.random() < 0.05:
                parts.append(self.pick(self.advert, self.side, self.form, self.notice)())
        if self.r.random() < 0.12:
            parts.append(self.share())
        if self.r.random() < 0.25:
            parts.append(self.pick(self.comments, self.side, self.form)())
        inner = "".join(parts)
        return self.pick(
            f"<article>{inner}</article>", f"<article>{inner}</article>", f"<article>{inner}</article>",
            f'<article class="post">{inner}</article>', f"<main>{inner}</main>",
            f"<main><article>{inner}</article></main>", f'<div class="content">{inner}</div>',
            f'<div id="main-content">{inner}</div>', f'<div class="article-body">{inner}</div>',
            f'<div class="post-content entry">{inner}</div>', f'<section class="story">{inner}</section>')

    def page(self) -> str:
        parts = [self.unscripted(0.3, 0), self.maybe(0.5, self.notice), self.maybe(0.5, self.top), self.maybe(0.7, self.menu),
                 self.maybe(0.5, self.advert), self.maybe(0.2, self.side), self.article(),
                 self.maybe(0.2, self.advert), self.maybe(0.3, self.comments), self.maybe(0.3, self.side),
                 self.maybe(0.2, self.form), self.maybe(0.9, self.bottom)]
        head = f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>"
        end = self.pick("</body></html>", "</body></html>", "")
        return head + "".join(parts) + end


def labelled_pages(count: int, seed: int = 1):
    """(html, labels of its leaf blocks)."""
    for i in range(count):
        page = _Page(seed * 100_003 + i)
        markup = page.page()
        yield markup, page.labels
