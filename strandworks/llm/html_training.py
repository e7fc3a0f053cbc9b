"""Labelled pages for the model of ``html_extract``, made here from a fixed seed.

Each page is a list of pieces of HTML, marked as article or not. The marks go
into the pages as an attribute ``data-y`` that the parser turns into labels;
real pages have no such attribute.
"""

from __future__ import annotations

import random

PAGES, SEED = 1200, 7

#: Class and id names that pages use for each kind of block.
NAMES = {
    "nav": ["nav", "menu", "main-menu", "navbar", "navigation", "breadcrumbs", "topnav", "site-nav", "pagination", "toc-links"],
    "header": ["header", "site-header", "masthead", "topbar", "page-header", "banner", "branding"],
    "footer": ["footer", "site-footer", "foot", "bottom", "copyright", "colophon", "footer-links"],
    "aside": ["sidebar", "aside", "widget", "related", "related-posts", "side-column", "recommended", "trending", "popular", "more-stories"],
    "notice": ["cookie-notice", "cookie-banner", "notice", "consent", "gdpr", "alert", "popup", "modal", "warning", "disclaimer", "privacy-notice"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "adbox", "adsbygoogle", "ad-slot", "banner-ad", "promotion", "sponsor"],
    "form": ["newsletter", "subscribe", "signup", "search-form", "login", "contact-form", "search", "subscription"],
    "comments": ["comments", "comment-list", "comment-section", "replies", "responses", "discussion", "disqus_thread", "reader-comments", "user-comments"],
    "share": ["share", "social", "share-buttons", "tags", "toolbar", "follow-us"],
    "article": ["article", "content", "post", "entry-content", "story", "article-body", "main-content", "post-body", "text", "entry", "story-body", "main"],
}
#: Elements that pages use for each kind of block.
TAGS = {
    "nav": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "aside": ["aside", "aside", "div", "section"],
    "notice": ["div", "div", "section", "aside"], "ad": ["div", "div", "aside", "section", "ins"], "form": ["form", "form", "div"], "comments": ["section", "div", "div", "ol"],
    "share": ["div", "ul"], "article": ["article", "article", "div", "section", "main"],
}


class _Page:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.parts = rng.sample(["an", "er", "to", "li", "mon", "ca", "sel", "vi", "dra", "que", "ung", "os", "tor", "pe", "ra", "ist", "el", "no", "bu", "ken"], 12)

    def words(self, low: int, high: int) -> str:
        r = self.rng
        out = ["".join(r.choices(self.parts, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        text = " ".join(w + ("," if r.random() < 0.06 else ". " + "".join(r.choices(self.parts, k=2)).capitalize() if r.random() < 0.12 else "") for w in out)
        return text.capitalize() + r.choice(["", ".", "."])

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/x">{self.words(low, high)}</a>'

    def open(self, kind: str, y: int) -> tuple[str, str]:
        r = self.rng
        tag, name = r.choice(TAGS[kind]), r.choice(NAMES[kind])
        self_told = tag == kind or tag in ("article", "main", "form")
        how = r.random()
        attr = "" if self_told and how < 0.6 else f' class="{name}"' if how < 0.8 else f' id="{name}" class="box"' if how < 0.9 else f' id="{name}"'
        return f'<{tag}{attr} data-y="{y}">', f"</{tag}>"

    def links(self) -> str:
        r = self.rng
        if r.random() < 0.75:
            return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>"
        return " ".join(self.link() for _ in range(r.randint(2, 8)))

    def junk(self, kind: str) -> str:
        r = self.rng
        a, b = self.open(kind, 0)
        if kind == "nav":
            inner = self.links()
        elif kind == "header":
            inner = r.choice([f"<h1>{self.words(1, 4)}</h1>", self.link(), f"<p>{self.words(2, 9)}</p>", self.words(1, 9), self.words(1, 9)]) + (self.junk("nav") if r.random() < 0.5 else "")
        elif kind == "footer":
            inner = r.choice([f"&copy; {self.words(1, 5)} &middot; {self.words(1, 25)}", f"<p>&copy; 2024 {self.words(2, 12)}</p>", self.links(), self.words(3, 30), f"<p>{self.words(4, 40)}</p>"])
        elif kind == "aside":
            inner = r.choice(["", f"<h3>{self.words(1, 3)}</h3>"]) + r.choice([self.links(), f"<p>{self.words(5, 50)}</p>", self.words(4, 40), "".join(f"<div><h4>{self.link()}</h4><p>{self.words(4, 20)}</p></div>" for _ in range(r.randint(1, 4)))])
        elif kind in ("notice", "ad"):
            inner = r.choice([self.words(2, 45), f"<p>{self.words(3, 45)}</p>", f"<p>{self.words(3, 25)}</p><button>{self.words(1, 2)}</button>", f"{self.words(2, 20)} {self.link()}", f"<h4>{self.words(1, 5)}</h4><p>{self.words(3, 30)}</p>"])
        elif kind == "form":
            inner = r.choice(["", f"<p>{self.words(3, 30)}</p>"]) + f'<label>{self.words(1, 2)}</label><input name="q"><button>{self.words(1, 2)}</button>' + r.choice(["", f"<p>{self.words(3, 20)}</p>"])
        elif kind == "comments":
            tag = "li" if a.startswith("<ol") else r.choice(["div", "article", "li", "div"])
            name = r.choice([' class="comment"', ' class="reply"', "", ' class="comment-body"'])
            inner = r.choice(["", f"<h2>{self.words(1, 3)}</h2>"]) + "".join(f'<{tag}{name}>{r.choice(["", "<b>" + self.words(1, 2) + "</b> "])}<p>{self.words(3, 60)}</p></{tag}>' for _ in range(r.randint(1, 5)))
        else:
            inner = self.links()
        return a + inner + b

    def prose(self) -> str:
        r = self.rng
        kind = r.random()
        if kind < 0.68:
            text = self.words(2, 120)
            if r.random() < 0.2:
                text += " " + self.link(1, 3) + " " + self.words(2, 30)
            if r.random() < 0.2:
                text = "<b>" + text + r.choice(["</b>", "", "<br>"])
            return r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<div>{text}</div>"])
        if kind < 0.8:
            return f"<h{r.randint(2, 4)}>{self.words(1, 8)}</h2>".replace("</h2>", "</h3>") if r.random() < 0.05 else f"<h2>{self.words(1, 8)}</h2>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{self.words(2, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if kind < 0.93:
            return f"<blockquote><p>{self.words(5, 50)}</p></blockquote>"
        if kind < 0.96:
            return f'<figure><img src="x.png"><figcaption>{self.words(2, 15)}</figcaption></figure>'
        return "<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>"

    def article(self, boxed: bool = True) -> str:
        r = self.rng
        a, b = self.open("article", 1) if boxed else ("", "")
        body = [f"<h1>{self.words(2, 12)}</h1>" if r.random() < 0.7 else ""] + [self.prose() for _ in range(r.randint(1, 14))]
        for _ in range(r.choice([0, 0, 1, 2])):
            body.insert(r.randint(1, len(body)), self.junk(r.choice(["ad", "share", "aside", "form", "notice"])))
        if r.random() < 0.2:
            body.append(self.junk("comments"))
        if r.random() < 0.15:
            body.insert(0, f'<header data-y="1"><h1>{self.words(2, 9)}</h1></header>')
        if boxed and r.random() < 0.3:
            c, d = self.open("article", 1)
            return a + c + "".join(body) + d + b
        return a + "".join(body) + b

    def html(self) -> str:
        r = self.rng
        some = lambda kind, p: self.junk(kind) if r.random() < p else ""
        before = [some("header", 0.6), some("nav", 0.6), some("notice", 0.35), some("ad", 0.4), some("form", 0.15), some("aside", 0.15)]
        after = [some("aside", 0.45), some("comments", 0.4), some("ad", 0.3), some("form", 0.25), some("nav", 0.15), some("notice", 0.15)]
        r.shuffle(after)
        if r.random() < 0.06:  # text alone, or only paragraphs
            return '<html data-y="1">' + r.choice([self.words(3, 200), self.article(False), '<body data-y="1">' + self.article(False)])
        if r.random() < 0.1:  # an article straight in the body
            return f'<!DOCTYPE html><html data-y="1"><head><title>{self.words(2, 9)}</title></head><body data-y="1">' + "".join(before) + self.article(False) + "".join(after) + some("footer", 0.85) + "</body></html>"
        main = self.article()
        if r.random() < 0.3:
            main = f'<div class="{r.choice(["container", "wrapper", "page", "row", "layout"])}" data-y="0">' + some("ad", 0.2) + main + "".join(after[:2]) + "</div>" + "".join(after[2:])
        else:
            main += "".join(after)
        return f'<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title><style>p{{}}</style></head><body data-y="0">' + "".join(before) + main + some("footer", 0.85) + r.choice(["</body></html>", ""])


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[str]:
    rng = random.Random(seed)
    return [_Page(rng).html() for _ in range(n)]
