"""Generated pages of many layouts, with their main text marked, to train and test block labelling.

Each page draws its own structure: which boilerplate it has, where, in which elements, under which names or
none at all, and how carelessly its tags are closed.  Prose, short lines, junk and cue words stand in main
text and boilerplate alike, so that no word decides by itself.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Comments that begin boilerplate and main text.
MARKS = ("rest", "main")
SYLLABLES = "an at be con de di en er es fi ge ha in ing ja ka la le ma mi na no on or pa qui ra re sa se sh st ta te ti to un ve vi wo ä é ç ñ ou".split()
LETTERS = "abcdefghiklmnoprstuvw"
#: Words that pages use around their main text, in four languages.
CUES = (
    "home menu login register search subscribe newsletter cookies privacy policy terms contact about imprint copyright advertisement sponsored share tweet follow "
    "related comments reply posted comment loading previous next archive categories tags rss sitemap accept decline settings signup email anmelden suche startseite "
    "impressum datenschutz werbung anzeige kommentare antworten accueil connexion recherche publicité partager commentaires répondre mentions inicio buscar entrar "
    "publicidad anuncio compartir comentarios responder suscribirse aviso"
).split()
#: Class and id names of parts of pages; a page may also give none, or names that say nothing.
NAMES = {
    "menu": "nav navbar menu main-menu topnav navigation site-nav breadcrumbs breadcrumb pagination tabs",
    "header": "header site-header masthead top banner page-head branding topbar",
    "footer": "footer site-footer bottom page-foot colophon copyright legal",
    "sidebar": "sidebar side rail widget widgets aside right-col secondary related recommended popular trending",
    "notice": "notice cookie cookie-banner consent gdpr alert popup modal overlay paywall announcement warning",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsense google-ad outbrain",
    "form": "form search login signup subscribe newsletter contact-form poll",
    "comments": "comments comment-list discussion replies responses disqus reader-comments respond thread",
    "share": "share social share-buttons toolbar tools actions like-bar tags post-meta",
    "main": "content article post entry story main main-content article-body post-content entry-content text body-text page-content single",
}
NAMES = {part: names.split() for part, names in NAMES.items()}
TAGS = {
    "menu": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "sidebar": ["aside", "aside", "div", "section"],
    "notice": ["div", "div", "section", "aside", "p"], "advert": ["div", "div", "aside", "ins", "section", "p"], "form": ["form"], "comments": ["section", "div", "div", "ol", "aside"],
    "share": ["div", "ul", "p"], "main": ["article", "article", "article", "main", "div", "div", "section", "td"],
}
ROLES = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "main": "main", "form": "search"}


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.sloppy = self.r.random() < 0.4
        self.named = self.r.random()  # how likely parts without an element of their own have a telling name
        self.junk = self.r.random() < 0.15
        self.inside = False

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def word(self) -> str:
        w = "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))
        return w + self.r.choice(("***", "###", "%%%", "$$$", "&amp;&amp;")) if self.junk and self.chance(0.7) else w

    def name(self) -> str:
        """A class name that says nothing."""
        return "-".join("".join(self.r.choices(LETTERS, k=self.r.randint(3, 8))) for _ in range(self.r.randint(1, 2)))

    def words(self, n: int, cues: float = 0.01) -> str:
        return " ".join(self.r.choice(CUES) if self.chance(cues) else self.word() for _ in range(n))

    def sentences(self, most: int = 6, cues: float = 0.01) -> str:
        return " ".join(self.words(self.r.choice((1, 2, 4, 8, 12, 20)), cues).capitalize() + self.r.choice((".", ".", ".", "!", "?")) for _ in range(self.r.randint(1, most)))

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for _ in range(self.r.randint(0, 2)):
            tag, at = self.r.choice(("b", "i", "em", "strong", "span", "a href='/x'", "code")), self.r.randrange(len(words))
            words[at] = f"<{tag}>{words[at]}" + ("" if self.sloppy and self.chance(0.3) and tag[0] != "a" else f"</{tag.split()[0]}>")
        return " ".join(words).replace(" ", "&nbsp;" if self.chance(0.03) else " ", 1)

    def attributes(self, part: str, tag: str) -> str:
        plain = tag in ("div", "p", "ul", "ol", "td", "section", "ins")
        out = ""
        if self.inside and part != "main" or self.chance(0.9 if plain and self.named > 0.12 else 0.35):  # within main text only a name tells
            extra = [f"c{self.r.randint(1, 99)}"] if self.chance(0.2) else []
            out += f' {self.r.choice(("class", "class", "id"))}="{" ".join([self.r.choice(NAMES[part]), *extra])}"'
        elif self.chance(0.3):
            out += f' class="{self.r.choice("abcdefgh")}{self.r.randint(1, 99)}"'
        if self.chance(0.15):
            out = out.replace('"', f'"{self.name()} ', 1) if out else f' class="{self.name()}"'
        if part in ROLES and self.chance(0.12):
            out += f' role="{ROLES[part]}"'
        return out

    def part(self, part: str, inner: str, tag: str | None = None) -> str:
        tag = tag or self.r.choice(TAGS[part])
        inner = f"<li>{inner}</li>" if tag in ("ul", "ol") and "<li" not in inner else inner
        return f"<{tag}{self.attributes(part, tag)}>{inner}</{tag}>"

    def links(self, most: int = 9) -> str:
        items = [f'<a href="/{i}">{self.words(self.r.randint(1, 3), 0.3)}</a>' for i in range(self.r.randint(1, most))]
        style = self.r.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{x}" + ("" if self.sloppy else "</li>") for x in items) + "</ul>"
        return self.r.choice((" | ", " ", " &middot; ")).join(items)

    def menu(self) -> str:
        return self.part("menu", self.links())

    def header(self) -> str:
        name = f"<{(tag := self.r.choice(('div', 'p', 'h1', 'h2', 'span')))}>{self.words(self.r.randint(1, 4), 0.1)}</{tag}>"
        return self.part("header", name + (self.menu() if self.chance(0.5) else "") + (self.form() if self.chance(0.3) else ""))

    def form(self) -> str:
        fields = self.words(self.r.randint(1, 3), 0.6) + f"<input name='q'><button>{self.words(1, 0.7)}</button>"
        return self.part("form", (f"<p>{self.sentences(2, 0.2)}</p>" if self.chance(0.5) else "") + (f"<label>{fields}</label>" if self.chance(0.5) else f"<div>{fields}</div>"))

    def advert(self) -> str:
        body = self.sentences(3, 0.1) if self.chance(0.7) else self.words(3, 0.6)
        return self.part("advert", self.r.choice((body, f"<p>{body}</p>", f"<a href='/ad'>{body}</a>", f"<h3>{self.words(3)}</h3><p>{body}</p>")))

    def notice(self) -> str:
        body = self.sentences(3, 0.15)
        return self.part("notice", self.r.choice((body, f"<p>{body}</p>", f"{body} <button>{self.words(1, 0.7)}</button>", f"<h4>{self.words(2, 0.4)}</h4><p>{body}</p>")))

    def sidebar(self) -> str:
        boxes = [f"<h3>{self.words(2, 0.3)}</h3>" + (self.links(6) if self.chance(0.6) else f"<p>{self.sentences(3, 0.05)}</p>") for _ in range(self.r.randint(1, 3))]
        return self.part("sidebar", "".join(boxes))

    def share(self) -> str:
        return self.part("share", self.links(4))

    def comments(self) -> str:
        tag = self.r.choice(("div", "li", "article", "p"))
        said = [f"<{tag} class='{self.r.choice(('comment', 'reply', 'c'))}'><b>{self.words(2)}</b> {self.r.choice(('', '<p>'))}{self.sentences(4)}</{tag}>" for _ in range(self.r.randint(1, 5))]
        title = f"<h3>{self.words(2, 0.6)}</h3>" if self.chance(0.6) else ""
        form = self.form() if self.chance(0.3) else ""
        outer = self.r.choice([t for t in TAGS["comments"] if t != "ol" or tag == "li"])
        inner = title + "".join(said) + form
        named = f"<{outer} {self.r.choice(('class', 'id'))}='{self.r.choice(NAMES['comments'])}'>{inner}</{outer}>"
        return named

    def footer(self) -> str:
        line = f"&copy; {self.words(2)} " + (f"&middot; {self.sentences(1, 0.2)}" if self.chance(0.6) else str(self.r.randint(1999, 2025)))
        return self.part("footer", self.r.choice((line, f"<p>{line}</p>", f"<div>{line}</div>")) + (self.links(5) if self.chance(0.4) else "") + (f"<address>{self.words(5)}</address>" if self.chance(0.15) else ""))

    def paragraph(self) -> str:
        kind, text = self.r.random(), self.inline(self.sentences(self.r.choice((1, 2, 6, 15)), self.r.choice((0.02, 0.02, 0.02, 0.3))))
        if self.chance(0.06):
            text = f"{self.words(self.r.randint(1, 3), 0.1)} " * self.r.choice((3, 20, 200))
        if kind < 0.62:
            return f"<p>{text}" + ("" if self.sloppy and self.chance(0.5) else "</p>")
        if kind < 0.70:
            return f"<p><b>{text}<br>"
        if kind < 0.76:
            return f"<div>{text}</div>"
        if kind < 0.82:
            return f"<{(tag := self.r.choice(('h2', 'h3', 'h4')))}>{self.words(self.r.randint(1, 6))}</{tag}>"
        if kind < 0.88:
            tag = self.r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{self.sentences(2)}" + ("" if self.sloppy else "</li>") for _ in range(self.r.randint(1, 5))) + f"</{tag}>"
        if kind < 0.92:
            return f"<blockquote>{self.r.choice((text, f'<p>{text}</p>'))}</blockquote>"
        if kind < 0.95:
            return f"<pre>{self.words(8)}\n  {self.words(4)}</pre>"
        if kind < 0.97:
            return "<table>" + "".join(f"<tr><td>{self.words(2)}</td><td>{self.words(1)}</td></tr>" for _ in range(2)) + "</table>"
        return f"<figure><img src='x.png'><figcaption>{self.sentences(1)}</figcaption></figure>"

    def main(self) -> str:
        rest, main = (f"<!--{m}-->" for m in MARKS)
        title = f"<{(tag := self.r.choice(('h1', 'h1', 'h2')))}>{self.words(self.r.randint(1, 9))}</{tag}>"
        out = [main + (title if self.chance(0.85) else "")]
        inner = (self.advert, self.share, self.form, self.notice, lambda: self.part("sidebar", self.links(4), "aside"))
        count, same = self.r.choice((1, 1, 2, 3, 5, 8, 12, 12, 30, 90)), self.paragraph() if self.chance(0.12) else ""
        for _ in range(count):
            out.append(same or self.paragraph())
            if self.chance(0.7 / count):
                self.inside = True
                out.append(rest + self.r.choice(inner)() + main)
                self.inside = False
        if self.chance(0.12):
            out.append(rest + self.comments())
        body = "".join(out) + rest
        tag = self.r.choice(TAGS["main"])
        if tag == "td":
            return f"<table><tr>{f'<td>{self.links(5)}</td>' if self.chance(0.5) else ''}<td{self.attributes('main', 'td')}>{body}</td></tr></table>"
        whole = f"<{tag}{self.attributes('main', tag)}>{body}</{tag}>"
        return f"<div{self.attributes('main', 'div')}>{whole}</div>" if self.chance(0.3) else whole

    def html(self) -> str:
        some = lambda p, *makers: "".join(make() for make in makers if self.chance(p))
        before = some(0.45, self.notice, self.header) + some(0.55, self.menu) + some(0.2, self.form, self.advert) + some(0.45, self.advert) + some(0.2, self.sidebar)
        after = some(0.3, self.sidebar, self.share) + some(0.35, self.comments) + some(0.2, self.advert, self.form, self.notice)
        head = f'<head><meta charset="utf-8"><title>{self.words(4)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
        end = "" if self.sloppy else "</body></html>"
        wrap = self.r.choice((("", ""), ("", ""), ('<div class="wrapper">', "</div>"), ('<div id="page"><div class="container">', "</div></div>"), (f'<div class="{self.name()}">', "</div>")))
        body = self.r.choice(("", "", f' class="{self.name()} {self.name()}"', f' id="{self.r.choice(CUES)}"', ' class="home page"'))
        return f"<!DOCTYPE html><html>{head}<body{body}>{wrap[0]}<!--{MARKS[0]}-->{before}{self.main()}{after}{some(0.85, self.footer)}{wrap[1]}{end}"


def generate(count: int, seed: int) -> Iterator[str]:
    """``count`` pages; equal arguments give equal pages."""
    for number in range(count):
        yield _Page(seed * 1_000_003 + number).html()
