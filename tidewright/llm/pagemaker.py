"""Labelled pages for the page classifier, made by rule.

Each page is drawn from many layouts: landmark elements or plain containers,
with telling, vague or no class names; an article of headings, paragraphs,
lists, quotes and tables, with adverts, notices, forms and boxes inside or
around it; comments that look like prose. Every leaf's text begins with a mark
that tells whether it is part of the article, so that labels follow from the
parsed page.
"""

from __future__ import annotations

import random

MAIN, REST = "①", "②"
_SYLLABLES = "ba ce di fo gu ha ki lo mu ne or pa qui re sa ti un va we xo yan zu el tion ment sch ent ar is".split()
# Names that pages give to their parts.
NAMES = {
    "nav": "nav menu navbar navigation main-menu top-nav site-nav menu-list breadcrumb breadcrumbs pagination toc links tabs".split(),
    "header": "header masthead site-header top topbar branding logo banner-top page-header hero".split(),
    "footer": "footer site-footer bottom colophon copyright foot legal page-footer credits".split(),
    "aside": "sidebar aside widget related recommended side right-rail left-column trending popular most-read more-stories see-also secondary".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner adsbygoogle ad-slot dfp commercial partner".split(),
    "notice": "notice cookie cookie-banner consent gdpr alert popup modal overlay message warning toast paywall disclaimer privacy".split(),
    "form": "form search login newsletter subscribe signup contact-form search-box sign-in register feedback".split(),
    "comment": "comments comment comment-list replies discussion disqus responses reader-comments commentlist reply user-comments thread".split(),
    "share": "share social sharing share-buttons follow tags tag-list meta byline post-meta author-box tools".split(),
    "main": "content article post entry main story body post-content entry-content article-body text main-content page-content article-text".split(),
    "none": "box wrapper container inner block row col module grid section item wrap layout x1 c2 panel".split(),
}
_TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comment": "section", "main": "article"}


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def prose(self, low: int, high: int) -> str:
        r, out = self.r, []
        for i in range(r.randint(low, high)):
            w = "".join(r.choices(_SYLLABLES, k=r.randint(1, 3)))
            out.append(w.capitalize() if i == 0 or out[-1].endswith(".") else w + r.choice(["", "", "", "", "", ",", "."]))
        return " ".join(out).rstrip(",.") + r.choice([".", ".", ".", ""])

    def attributes(self, kind: str, telling: float) -> str:
        r = self.r
        if r.random() < telling:
            names = r.sample(NAMES[kind], 1) + (r.sample(NAMES["none"], 1) if r.random() < 0.3 else [])
        elif r.random() < 0.5:
            names = r.sample(NAMES["none"], 1)
        else:
            return ""
        if r.random() < 0.2:
            return f' id="{names[0]}"'
        return f' class="{" ".join(names)}"' + (f' id="{r.choice(names)}{r.randint(1, 9)}"' if r.random() < 0.2 else "")

    def wrap(self, kind: str, inner: str, landmark: float = 0.5, telling: float = 0.7) -> str:
        r = self.r
        use = r.random() < landmark and kind in _TAGS
        tag = _TAGS[kind] if use else r.choice(["div", "div", "div", "section"])
        # what neither a landmark nor a name tells apart is article; menus show by their links
        named = 1.0 if kind == "comment" else 0.4 * telling if use else telling if kind in ("main", "nav") else 1.0
        return f"<{tag}{self.attributes(kind, named)}>{inner}</{tag}>"

    def link(self, words: str) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{words}</a>'

    def loose(self, words: str) -> str:
        """The words with inline elements that may never end, end twice or hold a line break."""
        r, parts = self.r, words.split(" ")
        for _ in range(r.randint(1, 3)):
            tag = r.choice(["b", "i", "em", "strong", "span", "u", "small", "code"])
            parts.insert(r.randint(0, len(parts)), r.choice([f"<{tag}>", f"</{tag}>", "<br>", f"<{tag}></{tag}>"]))
        return " ".join(parts) + r.choice(["", "</p>", "</p></p>"])

    def menu(self, mark: str) -> str:
        r = self.r
        items = [self.link(mark + self.prose(1, 3)) for _ in range(r.randint(2, 12))]
        style = r.random()
        if style < 0.65:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return (" | " if style < 0.8 else "").join(items) if style < 0.9 else "".join(f"<div>{i}</div>" for i in items)

    def rest(self, kind: str, telling: float = 0.95) -> str:
        """A part that is not article; inside an article only its names tell it apart."""
        r, m = self.r, REST
        if kind == "nav":
            inner = self.menu(m)
        elif kind == "header":
            inner = r.choice([f"<h1>{m}{self.prose(1, 4)}</h1>", f"<div>{m}{self.prose(1, 5)}</div>", f"<p>{m}{self.prose(2, 8)}</p>", f"{m}{self.prose(1, 6)}"]) + (self.menu(m) if r.random() < 0.4 else "")
        elif kind == "footer":
            inner = r.choice([f"{m}&copy; {self.prose(2, 15)}", f"<p>{m}&copy; {r.randint(1999, 2030)} {self.prose(3, 25)}</p>", f"{m}{self.prose(3, 15)} &middot; {self.prose(2, 8)}", f"<p>{m}{self.prose(3, 15)}</p>"]) + (self.menu(m) if r.random() < 0.4 else "")
        elif kind == "aside":
            inner = (f"<h{r.randint(2, 4)}>{m}{self.prose(1, 4)}</h2>" if r.random() < 0.6 else "") + r.choice([self.menu(m), f"<p>{m}{self.prose(5, 30)}</p>", "".join(f"<p>{m}{self.link(self.prose(3, 8))}</p>" for _ in range(r.randint(1, 5))), f"{m}{self.prose(4, 20)}"])
        elif kind == "ad":
            inner = r.choice([f"{m}{self.prose(2, 20)}", f"<p>{m}{self.prose(3, 25)}</p>", m + self.link(self.prose(2, 8))])
        elif kind == "notice":
            inner = r.choice([f"<p>{m}{self.prose(5, 35)}</p>", f"{m}{self.prose(5, 30)}"]) + ("<button>ok</button>" if r.random() < 0.3 else "")
        elif kind == "form":
            label = f"<label>{m}{self.prose(1, 5)}</label>"
            inner = r.choice([label, f"<p>{m}{self.prose(2, 12)}</p>{label}", f"{m}{self.prose(1, 6)} "]) + '<input type="text" name="q"><input type="submit">'
            if r.random() < 0.8 or telling == 1:
                return f'<form action="/f"{self.attributes("form", 0.5)}>{inner}</form>'
        elif kind == "comment":
            every = []
            for _ in range(r.randint(1, 6)):
                who = f"<{'b' if r.random() < 0.5 else 'span'}>{m}{self.prose(1, 2)}</b> " if r.random() < 0.3 else ""
                body = f"<p>{who}{m}{self.prose(4, 60)}</p>" if r.random() < 0.7 else f"{who}{m}{self.prose(4, 50)}"
                tag = r.choice(["div", "div", "li", "article"])
                every.append(f"<{tag}{self.attributes('comment', 0.6)}>{body}</{tag}>")
            inner = (f"<h3>{m}{self.prose(1, 3)}</h3>" if r.random() < 0.5 else "") + "".join(every)
        else:
            inner = r.choice([self.menu(m), f"<p>{m}{self.prose(1, 8)}</p>", f"<span>{m}{self.prose(1, 4)}</span>"])
        return self.wrap(kind, inner, 0.5, telling)

    def article(self) -> str:
        r, m = self.r, MAIN
        out = [f"<h1>{m}{self.prose(2, 10)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14])):
            x = r.random()
            if x < 0.68:
                words = self.prose(r.choice([1, 3, 12, 20]), r.choice([20, 60, 120]))
                if r.random() < 0.25:
                    words += " " + self.link(self.prose(1, 4)) + " " + self.prose(2, 10)
                out.append(r.choice([f"<p>{m}{words}</p>", f"<p>{m}{words}</p>", f"<p>{m}{words}</p>", f"<p>{m}{self.loose(words)}", f"<div>{m}{words}</div>", f"<p>{m}{words}"]))
            elif x < 0.78:
                out.append(f"<h{r.randint(2, 3)}>{m}{self.prose(1, 8)}</h2>")
            elif x < 0.85:
                out.append("<ul>" + "".join(f"<li>{m}{self.prose(2, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.9:
                out.append(f"<blockquote>{r.choice(['', '<p>'])}{m}{self.prose(6, 40)}</blockquote>")
            elif x < 0.93:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{m}{self.prose(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif x < 0.95:
                out.append(f"<pre>{m}{self.prose(3, 30)}</pre>")
            else:
                out.append(f"<figure><img src=x><figcaption>{m}{self.prose(2, 12)}</figcaption></figure>")
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            out.insert(r.randint(1, len(out)), self.rest(r.choice(["ad", "ad", "share", "aside", "notice", "form", "nav"]), 1.0))
        if r.random() < 0.12:
            out.append(self.rest("comment", 1.0))
        return self.wrap("main", "".join(out), 0.55, 0.6)

    def page(self) -> str:
        r = self.r
        before = [k for k in ("notice", "header", "nav", "form", "ad", "share") if r.random() < 0.5]
        after = [k for k in ("share", "ad", "comment", "aside", "nav", "form", "notice") if r.random() < 0.45]
        r.shuffle(before)
        r.shuffle(after)
        end = ["footer"] if r.random() < 0.85 else []
        middle = "".join(self.rest(k) for k in before[2:]) + self.article() + "".join(self.rest(k) for k in after)
        for _ in range(r.choice([0, 0, 1, 2])):
            middle = r.choice(["<div{}>{}</div>", "<main{}>{}</main>", "<section{}>{}</section>"]).format(self.attributes("none", 0.6), middle)
        return "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(self.rest(k) for k in before[:2]) + middle + "".join(self.rest(k) for k in end) + "</body></html>"
