"""Made-up pages with known main text, to train the page model of :mod:`html_extract`.

Every page is drawn from a seeded generator: nested wrappers, semantic tags or named blocks, an
article of headings, paragraphs, lists, quotes, tables and code, and around and inside it menus,
headers, footers, sidebars, notices, adverts, forms, buttons and comments. Words are random
letters, so the model can learn nothing from language. Main text is wrapped in marks that the
labeller reads.
"""

from __future__ import annotations

import random

#: Marks around main text; private-use characters that no page part holds otherwise.
OPEN, CLOSE = "", ""

# Names that page authors give to blocks (fixed values).
MAIN_NAMES = ["content", "article", "post", "entry", "main", "story", "body", "text", "article-body", "post-content", "entry-content", "page-content", "main-content", "prose"]
PLAIN_NAMES = ["wrapper", "container", "row", "col", "inner", "page", "site", "layout", "section", "block", "grid", "wrap"]
NOISE_NAMES = {
    "menu": ["nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "navigation", "topbar", "tabs", "pagination", "toc"],
    "header": ["header", "site-header", "masthead", "banner", "top", "logo", "branding"],
    "footer": ["footer", "site-footer", "copyright", "bottom", "legal", "colophon"],
    "sidebar": ["sidebar", "side", "aside", "widget", "related", "recommended", "popular", "trending", "tags", "author-box", "rail"],
    "notice": ["notice", "cookie", "cookies", "consent", "alert", "gdpr", "popup", "modal", "overlay", "paywall", "toast"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner-ad", "adsbox"],
    "form": ["form", "search", "newsletter", "subscribe", "signup", "login", "contact-form", "poll"],
    "comments": ["comments", "comment", "comment-list", "discussion", "replies", "disqus", "responses", "respond"],
    "share": ["share", "social", "sharing", "follow", "buttons", "toolbar", "meta-links"],
}
NOISE_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = []
        for _ in range(r.randint(low, high)):
            w = "".join(r.choice("aeioubcdfghklmnprstvwz") for _ in range(r.randint(1, 11)))
            out.append(w + r.choice(["", "", "", "", "", ",", ".", "", "!", "?", ":", ";"][: r.choice([7, 7, 12])]))
        text = " ".join(out)
        return text[0].upper() + text[1:] + r.choice([".", ".", ""])

    def prose(self) -> str:
        return self.words(*self.r.choice([(1, 3), (4, 12), (10, 30), (30, 90), (60, 200)]))

    def tag(self, name: str, inner: str, names: list[str] | None = None) -> str:
        attr = ""
        if names:
            attr = f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}"'
        return f"<{name}{attr}>{inner}</{name}>"

    def links(self) -> str:
        return self.tag(self.r.choice(["ul", "ul", "div"]), "".join(f'<li><a href="/{k}">{self.words(1, 3)}</a></li>' for k in range(self.r.randint(1, 9))))

    def noise(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            inner = self.links() if r.random() < 0.8 else " ".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(r.randint(2, 8)))
        elif kind == "comments":
            inner = (f"<h3>{self.words(1, 3)}</h3>" if r.random() < 0.6 else "") + "".join(self.tag("div", self.tag("p", self.prose()), ["comment", "reply", "comment-body"]) for _ in range(r.randint(1, 5)))
        elif kind == "form":
            inner = f"<label>{self.words(1, 4)}</label><input type='text'>" + (f"<p>{self.words(3, 20)}</p>" if r.random() < 0.4 else "") + f"<button>{self.words(1, 2)}</button>"
        elif kind == "sidebar":
            inner = (f"<h3>{self.words(1, 4)}</h3>" if r.random() < 0.7 else "") + r.choice([self.links, lambda: f"<p>{self.prose()}</p>"])()
        elif kind in ("header", "share"):
            inner = r.choice([f'<a href="/">{self.words(1, 4)}</a>', f"<p>{self.words(2, 8)}</p>", self.links()])
        elif kind == "footer":
            inner = r.choice([f"&copy; {self.words(2, 20)}", f"<p>&copy; {self.words(2, 30)}</p>", self.links() + f"<p>{self.words(4, 20)}</p>", f"<small>&copy; {self.words(1, 3)}</small> {self.prose()}"])
        else:  # notices and adverts may be any prose
            inner = r.choice([self.prose(), f"<p>{self.prose()}</p>", f"<p>{self.prose()}</p><a href='#'>{self.words(1, 3)}</a>"])
        name = NOISE_TAGS.get(kind)
        if name and r.random() < 0.6:
            return self.tag(name, inner, NOISE_NAMES[kind] if r.random() < 0.5 else None)
        return self.tag(r.choice(["div", "div", "section", "aside" if kind in ("ad", "notice") else "div"]), inner, NOISE_NAMES[kind])

    def main(self, text: str) -> str:
        return f"{OPEN}{text}{CLOSE}"

    def piece(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.62:
            text = self.prose()
            if r.random() < 0.25:
                text += f' <a href="#">{self.words(1, 4)}</a> {self.words(1, 8)}'
            if r.random() < 0.15:  # end tags of paragraphs may be left out
                return f"<p>{self.main(text)}"
            return self.tag("p", self.main(text))
        if kind < 0.74:
            return self.tag(r.choice(["h2", "h3"]), self.main(self.words(1, 9)))
        if kind < 0.82:
            return self.tag(r.choice(["ul", "ol"]), "".join(self.tag("li", self.main(self.words(1, 25))) for _ in range(r.randint(1, 7))))
        if kind < 0.87:
            return self.tag("blockquote", self.tag("p", self.main(self.prose())))
        if kind < 0.92:
            return self.tag("table", "".join(self.tag("tr", "".join(self.tag("td", self.main(self.words(1, 4))) for _ in range(3))) for _ in range(r.randint(1, 4))))
        if kind < 0.95:
            return self.tag("pre", self.main(self.words(3, 30)))
        if kind < 0.97:
            return self.tag("figure", self.tag("figcaption", self.main(self.words(2, 12))))
        return self.tag("div", self.main(self.prose()))

    def page(self) -> str:
        r = self.r
        parts = [self.piece() for _ in range(r.choice([0, 1, 2, 4, 8, 14]))]
        if r.random() < 0.85:
            parts.insert(0, self.tag("h1", self.main(self.words(1, 14))))
        if not parts:
            parts = [self.tag("p", self.main(self.prose()))]
        for kind in ("ad", "share", "sidebar", "form", "comments", "notice"):
            if r.random() < 0.12:
                parts.insert(r.randint(min(1, len(parts)), len(parts)), self.noise(kind))
        if r.random() < 0.2:
            parts = [self.tag(r.choice(["div", "section"]), "".join(parts), r.choice([None, MAIN_NAMES, PLAIN_NAMES]))]
        style = r.random()
        if style < 0.45:
            body = self.tag("article", "".join(parts), MAIN_NAMES if r.random() < 0.3 else None)
        elif style < 0.6:
            body = self.tag("main", "".join(parts), MAIN_NAMES if r.random() < 0.3 else None)
        elif style < 0.9:
            body = self.tag(r.choice(["div", "div", "section"]), "".join(parts), MAIN_NAMES)
        else:
            body = self.tag("div", "".join(parts), r.choice([None, PLAIN_NAMES]))
        if r.random() < 0.25 and style < 0.45:
            body = self.tag("main", body)
        around = {k: [self.noise(k) for _ in range(r.choice([0, 1, 1, 2]))] for k in ("menu", "ad", "notice", "sidebar", "header", "form")}
        before = [x for k in ("menu", "header", "ad", "notice") for x in around[k]]
        after = [x for k in ("sidebar", "form") for x in around[k]]
        r.shuffle(before)
        if r.random() < 0.35:
            after.insert(0, self.noise("comments"))
        if r.random() < 0.3:
            after.append(self.noise("share"))
        if r.random() < 0.3:  # a column of the article and its side
            body = self.tag("div", body + "".join(after), r.choice([None, PLAIN_NAMES]))
            after = []
        if r.random() < 0.85:
            after.append(self.noise("footer"))
        inner = "".join(before) + body + "".join(after)
        for _ in range(r.choice([0, 0, 1, 2])):
            inner = self.tag("div", inner, r.choice([None, PLAIN_NAMES]))
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 9)}</title></head><body>{inner}</body></html>"
