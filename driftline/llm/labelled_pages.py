"""Pages with labelled blocks, made by a rule: what a model of main text is trained and tested on.

An element's data-label says whether its text is main text; the nearest one counts.
"""

from __future__ import annotations

import random

SYLLABLES = "ba ce di fo gu la me ni or pu ra se ti ur va wen xi yo zan the ing est ment ion der en au ci".split()
# Names that page authors give to the parts of a page.
MAIN = "content main article post entry story body text articleBody post-content entry-content article-body main-content page-content post-body story-body".split()
PARTS = {
    "header": "header site-header masthead top-bar banner branding page-header topbar".split(),
    "nav": "nav menu navigation navbar main-menu breadcrumb breadcrumbs site-nav toc pagination pager".split(),
    "notice": "notice cookie-notice consent cookie-banner alert gdpr message privacy-notice cookies disclaimer announcement".split(),
    "ad": "ad ads advert advertisement ad-banner ad-slot sponsored promo adsense promotion sponsor".split(),
    "side": "sidebar side-bar widget secondary related rail aside related-posts more recommended popular trending teaser".split(),
    "share": "share social sharing share-buttons follow social-links tags".split(),
    "form": "form newsletter subscribe search login signup subscription contact-form search-form".split(),
    "comments": "comments comment comment-list commentlist replies responses discussion comment-body reply respond reviews feedback".split(),
    "footer": "footer site-footer colophon bottom copyright page-footer legal".split(),
}
TAGS = {
    "header": ["header", "header", "div"], "nav": ["nav", "nav", "div", "ul"], "notice": ["div", "section", "p", "aside", "div"],
    "ad": ["div", "div", "aside", "section", "ins"], "side": ["aside", "aside", "div", "section"], "share": ["div", "ul", "p"],
    "form": ["form", "form", "div", "section"], "comments": ["section", "div", "ol", "ul", "div"], "footer": ["footer", "footer", "div"],
}
NEUTRAL = "container wrap row col inner box outer wrapper grid section block clearfix left right page site layout column group item".split()
#: Parts whose tag needs no class to be known.
TELLING = frozenset("header nav footer aside form".split())


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentences(self, n: int) -> str:
        out = []
        while n > 0:
            k = min(n, self.r.randint(1, 14))
            out.append(self.words(k).capitalize() + self.r.choice("....?!"))
            n -= k
        return " ".join(out)

    def prose(self) -> str:
        text = self.sentences(self.r.choice([1, 2, 4, 8, 15, 30, 60, 120]))
        if self.r.random() < 0.25:
            text += f' <a href="/{self.word()}">{self.words(2)}</a> {self.sentences(3)}'
        if self.r.random() < 0.2:
            text = f"<b>{self.words(2)}</b> {text}"
        return text

    def attributes(self, names: list[str], often: float = 1.0) -> str:
        if self.r.random() >= often:
            return ""
        chosen = [self.r.choice(names)] + ([self.r.choice(NEUTRAL)] if self.r.random() < 0.2 else [])
        return f' {self.r.choice(["class", "class", "id"])}="{" ".join(chosen)}"'

    def links(self) -> str:
        items = [f'<a href="/{self.word()}">{self.words(self.r.randint(1, 3))}</a>' for _ in range(self.r.randint(2, 7))]
        form = self.r.randrange(3)
        if form == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return (" | " if form == 1 else " ").join(items)

    def texts(self) -> str:
        return "".join(f"<p>{self.prose()}</p>" if self.r.random() < 0.7 else f"<div>{self.prose()}</div>" for _ in range(self.r.randint(1, 3)))

    def part(self, kind: str) -> str:
        """A part of the page that is no main text."""
        tag = self.r.choice(TAGS[kind])
        plain = self.r.random() < 0.4
        if kind == "header":
            inner = self.r.choice([f"<h1>{self.words(2)}</h1>", f"<div>{self.words(3)}</div>", f"<p>{self.sentences(5)}</p>"]) + (self.links() if self.r.random() < 0.5 else "")
        elif kind in ("nav", "share"):
            inner = self.links()
        elif kind == "form":
            inner = f"<label>{self.words(2)}</label><input name='q'><p>{self.sentences(8)}</p><button>{self.word()}</button>"
        elif kind == "comments":
            inner = "".join(
                f"<{'li' if tag in ('ol', 'ul') else 'div'}{self.attributes(PARTS[kind])}><p>{self.prose()}</p></{'li' if tag in ('ol', 'ul') else 'div'}>"
                for _ in range(self.r.randint(1, 5))
            )
            if self.r.random() < 0.5:
                inner = f"<h{(level := self.r.randint(2, 4))}>{self.words(2)}</h{level}>" + inner
        elif kind == "footer":
            inner = f"&copy; {self.words(2)} &middot; {self.sentences(4)}" if self.r.random() < 0.5 else f"<p>{self.sentences(12)}</p>{self.links()}"
        else:
            inner = self.sentences(self.r.choice([2, 8, 20, 40])) if plain or tag == "p" else self.texts() + (self.links() if kind == "side" else "")
        often = 0.5 if tag in TELLING else 1.0
        return f'<{tag}{self.attributes(PARTS[kind], often)} data-label="0">{inner}</{tag}>'

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            title = f"<h1>{self.words(r.randint(1, 10))}</h1>"
            out.append(f"<header>{title}</header>" if r.random() < 0.15 else title)
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.56:
                out.append(f"<p>{self.prose()}</p>")
            elif kind < 0.62:
                out.append(f"<p><b>{self.prose()}<br>")
            elif kind < 0.69:
                level = r.randint(2, 4)
                out.append(f"<h{level}>{self.words(r.randint(1, 6))}</h{level}>")
            elif kind < 0.75:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{self.prose()}" for _ in range(r.randint(1, 5))) + f"</{tag}>")
            elif kind < 0.80:
                out.append(f"<blockquote>{self.texts()}</blockquote>")
            elif kind < 0.83:
                out.append(f"<pre>{self.words(r.randint(3, 30))}</pre>")
            elif kind < 0.87:
                out.append("<table>" + "".join(f"<tr><td>{self.word()}</td><td>{self.words(3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.90:
                out.append(f"<figure><img src='x'><figcaption>{self.sentences(8)}</figcaption></figure>")
            elif kind < 0.93:
                out.append(f"<div{self.attributes(NEUTRAL, 0.5)}>{self.prose()}</div>")
            else:
                out.append(self.part(r.choice(["ad", "notice", "share", "form", "side", "nav", "comments"])))
        if r.random() < 0.2:
            out.append(self.part("comments"))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        if r.random() < 0.05:
            return f'<body data-label="1">{self.words(r.randint(1, 9)) if r.random() < 0.5 else self.prose()}'
        text = self.article()
        form = r.random()
        if form < 0.35:
            text = f'<article{self.attributes(MAIN, 0.3)} data-label="1">{text}</article>'
        elif form < 0.5:
            text = f'<main{self.attributes(MAIN, 0.3)} data-label="1">{text}</main>'
        elif form < 0.85:
            text = f'<{(tag := r.choice(["div", "div", "section"]))}{self.attributes(MAIN)} data-label="1">{text}</{tag}>'
        else:
            text = f'<div{self.attributes(NEUTRAL, 0.5)} data-label="1">{text}</div>'
        before = [self.part(k) for k, p in (("notice", 0.3), ("header", 0.6), ("nav", 0.7), ("form", 0.15), ("ad", 0.4), ("side", 0.2)) if r.random() < p]
        after = [self.part(k) for k, p in (("share", 0.2), ("ad", 0.3), ("comments", 0.4), ("side", 0.4), ("form", 0.3), ("notice", 0.15), ("footer", 0.8)) if r.random() < p]
        r.shuffle(before)
        body = "".join(before) + text + "".join(after)
        if r.random() < 0.4:
            body = f"<div{self.attributes(NEUTRAL)}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(3)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{body}</body></html>"


def labelled_pages(count: int, seed: int) -> list[str]:
    maker = Maker(seed)
    return [maker.page() for _ in range(count)]
