"""Labelled pages to learn from: layouts drawn at random, whose blocks are known to be article or not.

Block labels come with the page: boilerplate is written by one function, article blocks by another. The words are random
letters, so that only structure and shape of text can be learned. The number of pages and the seed are parameters.
"""

from __future__ import annotations

import random

#: Names that sites give to parts of pages, by part.
PARTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc topnav mainmenu submenu tabs links skip",
    "header": "header masthead banner topbar branding logo sitetitle tagline site head",
    "footer": "footer copyright legal bottom colophon sitemap credits foot imprint",
    "sidebar": "sidebar aside related recommended popular trending widget rail recent archive tagcloud tags more teaser",
    "notice": "notice cookie cookies consent gdpr alert popup modal newsletter subscribe paywall disclaimer message overlay warning subscription privacy",
    "advert": "ad ads advert advertisement adverts sponsored sponsor promo promotion banner adsense commercial dfp",
    "form": "form search login signup contact register searchbox",
    "comments": "comments comment replies reply disqus discussion respond feedback reactions commentlist reader responses",
    "social": "share social follow sharing buttons",
}
ARTICLE = "content article post entry story body text main articlebody page single news blog post-content entry-content document prose"
_TAGS = {"menu": ["nav", "ul", "div"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "notice": ["div", "section", "p", "dialog", "aside"], "advert": ["div", "aside", "section", "p"], "form": ["form", "div"], "comments": ["section", "div", "ol"], "social": ["div", "ul"]}


class Pages:
    def __init__(self, seed: int = 0):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice("aeiounrstldmhcé") for _ in range(self.r.randint(1, 10)))

    def words(self, low: int, high: int, end: str = "") -> str:
        n = self.r.randint(low, high)
        out = [self.word() + ("," if self.r.random() < 0.08 else self.r.choice(["###", "&amp;", "!!", "%", "***"]) if self.r.random() < 0.02 else "") for _ in range(n)]
        text = " ".join(out)
        if self.r.random() < 0.06:
            text = text.upper()
        if self.r.random() < 0.05:
            text = " | ".join(out)
        return text[:1].upper() + text[1:] + end

    def name(self, part: str) -> str:
        w = self.r.choice((ARTICLE if part == "article" else PARTS[part]).split())
        extra = self.r.choice(["", "", "", "-wrap", "-box", "_inner", " block", "-1", " " + self.word()])
        return f' {self.r.choice(["class", "class", "id"])}="{w}{extra}"'

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def boilerplate(self, part: str, out: list[tuple[str, bool]]) -> str:
        r = self.r
        tag = r.choice(_TAGS[part])
        plain = tag in ("nav", "footer", "header", "aside", "form") and r.random() < 0.5
        open_, close = f"<{tag}{'' if plain else self.name(part)}>", f"</{tag}>"

        def leaf(text: str) -> str:
            out.append((text, False))
            return text

        if part in ("menu", "social"):
            items = [leaf(self.words(1, 3)) for _ in range(r.randint(2, 8))]
            if tag == "ul":
                return open_ + "".join(f"<li>{self.link(t)}</li>" for t in items) + close
            return open_ + "<ul>" + "".join(f"<li>{self.link(t)}</li>" for t in items) + "</ul>" + close
        if part == "header":
            inner = f"<{r.choice(['h1', 'div', 'p', 'h2'])}>{self.link(leaf(self.words(1, 4)))}</div>" if r.random() < 0.5 else f"<h1>{leaf(self.words(1, 6))}</h1>"
            if r.random() < 0.5:
                inner += f"<p>{leaf(self.words(3, 10))}</p>"
            if r.random() < 0.4:
                inner += self.boilerplate("menu", out)
            return open_ + inner + close
        if part == "footer":
            text = leaf(r.choice(["© ", "", "Copyright "]) + self.words(2, 14, r.choice([".", ""])))
            more = "".join(f"<p>{leaf(self.words(4, 30, '.'))}</p>" for _ in range(r.randint(0, 2)))
            return open_ + (f"<p>{text}</p>" if r.random() < 0.5 else text) + more + close
        if part == "sidebar":
            inner = f"<h3>{leaf(self.words(1, 4))}</h3>" if r.random() < 0.7 else ""
            if r.random() < 0.6:
                inner += "<ul>" + "".join(f"<li>{self.link(leaf(self.words(2, 9)))}</li>" for _ in range(r.randint(1, 6))) + "</ul>"
            else:
                inner += "".join(f"<p>{leaf(self.words(4, 60, '.'))}</p>" for _ in range(r.randint(1, 3)))
            return open_ + inner + close
        if part == "form":
            return open_ + f"<label>{leaf(self.words(1, 5))}</label><br><input type='text'><p>{leaf(self.words(2, 16))}</p><button>{leaf(self.words(1, 2))}</button>" + close
        if part == "comments":
            inner = f"<h3>{leaf(self.words(1, 3))}</h3>"
            for _ in range(r.randint(1, 5)):
                t = r.choice(["div", "li", "article", "section"])
                inner += f"<{t}{self.name('comments') if r.random() < 0.7 else ''}><p>{leaf(self.words(1, 3))}</p><p>{leaf(self.words(4, 70, '.'))}</p></{t}>"
            return open_ + inner + close
        if tag == "p" or r.random() < 0.5:
            return open_ + leaf(self.words(3, 50, r.choice([".", "."]))) + close
        return open_ + "".join(f"<p>{leaf(self.words(3, 50, '.'))}</p>" for _ in range(r.randint(1, 3))) + close

    def article(self, out: list[tuple[str, bool]]) -> str:
        r = self.r
        style = r.random()
        open_, close = ("<article>", "</article>") if style < 0.35 else (f"<article{self.name('article')}>", "</article>") if style < 0.5 else ("<main>", "</main>") if style < 0.6 else (f"<main{self.name('article')}><article>", "</article></main>") if style < 0.7 else (f"<div{self.name('article')}>", "</div>") if style < 0.92 else (f"<section{self.name('article')}>", "</section>")

        def leaf(text: str) -> str:
            out.append((text, True))
            return text

        html = ""
        if r.random() < 0.85:
            h = f"<h1>{leaf(self.words(1, 16, r.choice(['', '.'])))}</h1>"
            html += f"<header>{h}</header>" if r.random() < 0.15 and "article" in open_ else h
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            k = r.random()
            if k < 0.72:
                text = leaf(self.words(*r.choice([(1, 4), (4, 20), (20, 80), (60, 200)]), r.choice([".", ".", ".", ""])))
                html += f"<p>{text}</p>" if r.random() < 0.85 else f"<p><b>{text}<br>"
            elif k < 0.8:
                html += f"<{(h := r.choice(['h2', 'h3', 'h4']))}>{leaf(self.words(1, 8))}</{h}>"
            elif k < 0.86:
                html += "<ul>" + "".join(f"<li>{leaf(self.words(1, 20))}</li>" for _ in range(r.randint(1, 4))) + "</ul>"
            elif k < 0.9:
                html += f"<blockquote><p>{leaf(self.words(5, 40, '.'))}</p></blockquote>"
            elif k < 0.93:
                html += f"<pre>{leaf(self.words(3, 20))}</pre>"
            elif k < 0.96:
                html += "<table><tr>" + "".join(f"<td>{leaf(self.words(1, 4))}</td>" for _ in range(r.randint(1, 4))) + "</tr></table>"
            else:
                html += f"<div>{leaf(self.words(5, 60, '.'))}</div>"
            if r.random() < 0.06:
                html += self.boilerplate(r.choice(["advert", "notice", "sidebar", "social", "form"]), out)
        if r.random() < 0.15:
            html += self.boilerplate("comments", out)
        return open_ + html + close

    def page(self) -> tuple[str, list[tuple[str, bool]]]:
        """A page and its blocks with labels, in page order."""
        r, out = self.r, []
        html = "<!DOCTYPE html><html><head><title>" + self.words(1, 9) + "</title><style>p{margin:0}</style></head><body>"
        for part in r.choice([["menu"], ["header"], ["header", "menu"], ["notice", "header"], ["menu", "advert"], ["form", "menu"], []]):
            html += self.boilerplate(part, out)
        if r.random() < 0.35:
            html += self.boilerplate(r.choice(["advert", "notice", "sidebar", "social"]), out)
        html += self.article(out)
        for part in r.sample(["comments", "sidebar", "advert", "form", "notice", "social", "menu"], r.choice([0, 1, 1, 2, 3])):
            html += self.boilerplate(part, out)
        if r.random() < 0.8:
            html += self.boilerplate("footer", out)
        return html + "</body></html>", out


def labelled_pages(n: int, seed: int = 0) -> list[tuple[str, list[tuple[str, bool]]]]:
    pages = Pages(seed)
    return [pages.page() for _ in range(n)]
