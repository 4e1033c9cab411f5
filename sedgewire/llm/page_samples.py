"""Made-up pages with known main text, from which the extraction model learns. Everything follows from the seed."""

from __future__ import annotations

import random

_SYLLABLES = "an ba co de el fi ga ho in ka lo mi no or pe qu ra sa ti un ve wi xa yo zu th er on st".split()
# Words that pages call their parts by; names are made of them with and without something before or behind.
_OUTSIDE = {
    "nav": "nav navbar navigation menu topbar toc breadcrumb breadcrumbs".split(),
    "header": "header masthead topbar banner branding".split(),
    "footer": "footer copyright legal contentinfo privacy colophon".split(),
    "aside": "sidebar aside rail related recommended trending popular widget complementary recirc".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog banner".split(),
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion".split(),
    "form": "form login signin signup search subscribe newsletter contact".split(),
    "comments": "comment comments reply replies respond discussion disqus".split(),
    "share": "share sharing social tags toolbar pagination pager skip byline".split(),
}
_INSIDE = "article content post entry main body story text page prose markdown blog hentry maincontent articlebody richtext".split()
_BEFORE, _BEHIND = ["", "", "", "", "site-", "main-", "page-", "js-", "c-", "top ", "blog_"], ["", "", "", "", "-wrapper", "-block", "-container", "-list", "__inner", "Box", " row", "-area"]


class _Maker:
    def __init__(self, seed: int, mute: float) -> None:
        self.r = random.Random(seed)
        self.share = mute
        self.known = ["".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4))) for _ in range(6000)]
        self.mute = False  # whether the names of this page say nothing

    def words(self, low: int, high: int) -> str:
        r = self.r
        chance = r.random
        return " ".join([w + "," if chance() < 0.08 else w for w in r.choices(self.known, k=r.randint(low, high))]).capitalize()

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(2, 16).rstrip(",") + "." for _ in range(self.r.randint(low, high)))

    def name(self, words: list[str]) -> str:
        r = self.r
        if self.mute:
            return r.choice(["x", "c", "css-", "sc-", "v", "jsx-", "b"]) + str(r.randint(1, 99999))
        return r.choice(_BEFORE) + r.choice(words) + r.choice(_BEHIND)

    def named(self, tag: str, words: list[str], body: str, mark: str = "", bare: float = 0.2) -> str:
        name = "" if self.r.random() < bare else self.name(words)
        kind = self.r.choice(["class", "class", "class", "id", "role"]) if name else ""
        return f"<{tag}{f' {kind}={chr(34)}{name}{chr(34)}' if name else ''}{mark}>{body}</{tag}>"

    def links(self, low: int, high: int) -> str:
        r = self.r
        items = [f'<a href="/{k}">{self.words(1, 4)}</a>' for k in range(r.randint(low, high))]
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return r.choice([" | ", " ", ""]).join(items)

    def outside(self, kind: str) -> str:
        r = self.r
        names = _OUTSIDE[kind]
        tag = kind if kind in ("nav", "header", "footer", "aside", "form") and r.random() < 0.65 else "div"
        if kind == "nav":
            body = self.links(3, 9)
        elif kind == "header":
            body = r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 4)}</div>", f"<p>{self.words(3, 8)}</p>"]) + (self.links(2, 6) if r.random() < 0.5 else "")
        elif kind == "footer":
            body = r.choice(["&copy; ", "Copyright ", ""]) + self.words(2, 5) + " &middot; " + self.sentences(1, 3) + (self.links(2, 6) if r.random() < 0.5 else "")
        elif kind == "aside":
            body = f"<h3>{self.words(1, 3)}</h3>" + r.choice([self.links(3, 8), f"<p>{self.sentences(1, 4)}</p>"])
        elif kind == "notice":
            body = r.choice([f"<p>{self.sentences(1, 3)}</p>", self.sentences(1, 2)]) + r.choice(["", "<button>OK</button>", f"<a href='#'>{self.words(1, 2)}</a>"])
        elif kind == "advert":
            body = r.choice([self.sentences(1, 2), f"<p>{self.sentences(1, 3)}</p>", f"<a href='/x'>{self.words(3, 9)}</a>", f"<div>{self.words(4, 12)}.</div>"])
        elif kind == "form":
            body = f"<label>{self.words(1, 4)}</label><input type='text'><p>{self.words(3, 10)}</p>" + r.choice(["<button>Go</button>", ""])
            body = body if tag == "form" else f"<form>{body}</form>"
        elif kind == "comments":
            body = f"<h3>{self.words(1, 3)}</h3>" + "".join(r.choice(["<div class='comment'><p>{}</p></div>", "<li class='comment'>{}</li>", "<div><b>{}</b></div>", "<p class='reply'>{}</p>"]).format(self.sentences(1, 5)) for _ in range(r.randint(1, 6)))
            if self.mute:
                said = lambda: r.choice(["<div><b>{0}</b> <p>{1}</p></div>", "<div><span>{0}</span><div>{1}</div></div>", "<li>{0}: {1}</li>", "<div><p>{0}</p><p>{1}</p></div>"]).format(self.words(1, 2), self.sentences(1, 4))
                body = r.choice([f"<h3>{r.randint(1, 90)} {self.words(1, 1)}</h3>", f"<h2>{self.words(1, 2)} ({r.randint(1, 90)})</h2>", f"<h3>{self.words(1, 1)}</h3>"]) + "".join(said() for _ in range(r.randint(2, 7)))
            tag = r.choice(["div", "section", "aside"])
        else:
            body = self.links(2, 6)
        if r.random() < 0.06:
            body += r.choice(["<select><option>A<option>B</select>", "<button>Send", "<button type='button'>More</button>"])
        return self.named(tag, names, body, " data-out", 0 if tag in ("div", "section") else 0.2)

    def embedded(self) -> str:
        """What isn't text of the page: something shown only if something else can't be."""
        r = self.r
        tag = r.choice(["noscript", "video", "object", "canvas", "template", "svg"])
        inner = self.words(2, 9)
        return f"<{tag} data-out>{r.choice(['{}', '<p>{}</p>', '<div>{}.</div>']).format(inner) if tag in ('noscript', 'template', 'object') else inner}</{tag}>"

    def article(self) -> str:
        r = self.r
        parts = []
        title = f"<h{r.choice([1, 1, 1, 2])}>{self.words(3, 14)}</h1>".replace("</h1>", "</h1>")
        title = title if title.startswith("<h1") else title.replace("</h1>", "</h2>")
        if r.random() < 0.85:
            head = self.name(_INSIDE) + r.choice(["-header", "-title", "__head", " header"])
            parts.append(r.choice([f"<header>{title}</header>", f"<header class='{head}'>{title}</header>", f"<div class='{head}'>{title}</div>"]) if r.random() < 0.3 else title)
        for _ in range(r.choices([0, 1, 3, 8, 20], [1, 2, 4, 4, 2])[0]):
            x = r.random()
            text = self.sentences(1, 12)
            if x < 0.7:
                parts.append(r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p><b>{}<br></p>", "<p><b>{}<br>", "<p>{}", "<div>{}</div>", "<p><a href='/y'>x</a> {}</p>"]).format(text))
            elif x < 0.78:
                parts.append(f"<h{r.choice([2, 3])}>{self.words(2, 8)}</h2>".replace("<h3", "<h2"))
            elif x < 0.86:
                parts.append("<ul>" + "".join(f"<li>{self.words(3, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.9:
                parts.append(f"<blockquote>{r.choice(['<p>{}</p>', '{}']).format(text)}</blockquote>")
            elif x < 0.93:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(3)) + "</table>")
            elif x < 0.95:
                parts.append(f"<pre>{text}</pre>")
            elif x < 0.97:
                parts.append(f"<figure><figcaption>{self.words(3, 12)}</figcaption></figure>")
            elif x < 0.99:
                parts.append(self.outside(r.choice(["advert", "share", "aside", "form"])))
            else:
                parts.append(self.embedded())
        if r.random() < 0.15:
            parts.append(self.outside("share"))
        body = "".join(parts)
        if r.random() < 0.15:
            body = f"<div>{body}</div>"
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        if tag == "article" and r.random() < 0.6:
            return f"<article data-in>{body}</article>"
        return self.named(tag, _INSIDE, body, " data-in", 0.3)

    def loose_article(self) -> str:
        """A main part without an element around it: text runs directly in the body, with blocks or rules between them."""
        r = self.r
        parts = [f"<h1 data-in>{self.words(3, 14)}</h1>"] if r.random() < 0.6 else []
        runs = r.choices([1, 2, 3, 6], [4, 3, 2, 1])[0]
        for k in range(runs):
            if k:
                parts.append(r.choice(["<hr>", f"<h2 data-in>{self.words(2, 8)}</h2>", f"<p data-in>{self.sentences(1, 8)}</p>", self.outside(r.choice(["advert", "share", "aside"]))]))
            text = r.choice(["<br>", "<br><br>", "<br />\n", " <b>x</b> "]).join(self.sentences(1, 8) for _ in range(r.choice([1, 2, 4, 9])))
            tag = r.choice(["span", "font", "b", "tt"])
            run = f"<{tag}{f' class={chr(34)}{self.name(_INSIDE)}{chr(34)}' if r.random() < 0.2 else ''} data-in>{text}</{tag}>"
            parts.append(f"<x-text>{run}</x-text>" if r.random() < 0.1 else run)
        return "".join(parts)

    def loose_outside(self) -> str:
        """A run directly in the body that isn't main text, between rules."""
        r = self.r
        body, name = r.choice(
            [
                (r.choice(["&copy; ", "Copyright ", "&copy; 2024 "]) + self.words(2, 5) + " &middot; " + self.sentences(0, 2), ""),
                (r.choice([" | ", " ", " &raquo; "]).join(f'<a href="/{k}">{self.words(1, 4)}</a>' for k in range(r.randint(1, 8))), ""),
                (self.sentences(1, 3), self.name(_OUTSIDE["advert"])),
                (self.words(2, 8), self.name(_OUTSIDE["header"] + _OUTSIDE["notice"] + _OUTSIDE["share"])),
            ]
        )
        return f"<hr><span{f' class={chr(34)}{name}{chr(34)}' if name else ''} data-out>{body}</span><hr>"

    def page(self) -> str:
        r = self.r
        self.mute = self.share > 0 and r.random() < self.share
        above = [k for k, p in (("header", 0.5), ("nav", 0.75), ("notice", 0.3), ("advert", 0.5), ("share", 0.2), ("form", 0.2)) if r.random() < p]
        below = [k for k, p in (("comments", 0.35), ("advert", 0.3), ("aside", 0.4), ("form", 0.25), ("nav", 0.2), ("footer", 0.8), ("notice", 0.15)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(above)
        loose = r.random() < 0.25
        content = self.loose_article() if loose else self.article()
        if r.random() < (0.5 if loose else 0.25):
            loose, at = True, r.choice([above, below])
            at.insert(r.randint(0, len(at)), "loose")
        if not loose and r.random() < 0.2:
            content = f"<main>{content}{self.outside('comments') if r.random() < 0.4 else ''}</main>"
        beside = lambda kind: self.loose_outside() if kind == "loose" else self.outside(kind)
        first, last = [*map(beside, above)], [*map(beside, below)]
        if r.random() < 0.12:
            first.insert(r.randint(0, len(first)), self.embedded())
        body = "".join(first) + content + "".join(last)
        if not loose and r.random() < 0.06:  # the layout of a table
            side = self.outside(r.choice(["nav", "aside"]))
            body = "".join(first) + "<table><tr>" + f"<td>{side}</td><td>{content}</td>" + "</tr></table>" + "".join(last)
        for _ in range(r.choice([0, 0, 0, 1, 1, 2, 3]) if not loose else 0):
            body = f"<div class='{r.choice(['wrapper', 'container', 'page', 'site', 'row', 'col', 'app', 'root', 'layout', 'grid'])}'>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>{body}</body></html>"


def sample_pages(n: int, seed: int, mute: float = 0.0) -> list[str]:
    """Pages whose main part is marked data-in and whose other parts are marked data-out; the marks are no input of the model. mute: the share of pages whose names say nothing."""
    maker = _Maker(seed, mute)
    return [maker.page() for _ in range(n)]
