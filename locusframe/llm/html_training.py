"""Labelled pages for the extraction model, made by rule from a seed.

Each page is composed of parts whose blocks are known to be main text or not:
page headers, menus, notices, adverts, sidebars, articles in several mark-ups,
forms, share bars, related links, reader comments and footers.  Words are
invented, so the model learns from structure and not from a vocabulary.
"""

from __future__ import annotations

import random

from locusframe.llm.html_blocks import Block, leaf_blocks

SYLLABLES = "an be co da el fi go hu is jo ka lo mi no os pa qui ra se ti un vo wa xe yo zu ché ñar ös üb".split()
MAIN_NAMES = "content main post entry article story body text page-content post-content entry-content article-body story-body post-body markdown-body".split()
#: What holds no main text, and the names that such elements go by.
PARTS = {
    "header": ("site-header header masthead top-bar topbar banner branding logo page-header", ("header", "div", "section")),
    "menu": ("nav navbar menu navigation main-menu breadcrumb breadcrumbs tabs toolbar skip-links pagination pager toc", ("nav", "div", "ul", "menu")),
    "notice": ("notice alert cookie cookies cookie-banner consent gdpr privacy-notice banner popup modal overlay announcement message disclaimer warning paywall", ("div", "section", "aside", "dialog")),
    "advert": ("ad ads advert advertisement adsense ad-slot adbox banner-ad sponsor sponsored sponsors promo promotion promoted commercial dfp", ("div", "aside", "section")),
    "sidebar": ("sidebar side-bar aside widget widgets widget-area rail right-rail secondary complementary", ("aside", "div", "section")),
    "related": ("related related-posts recommended recommendations more-stories read-more also-like popular trending latest tags tag-list teaser", ("div", "section", "aside", "ul")),
    "share": ("share sharing social social-links share-buttons follow byline-tools actions buttons print-tools", ("div", "ul", "section")),
    "form": ("form search search-form newsletter subscribe signup sign-up login contact-form subscription poll survey", ("form", "div", "section")),
    "comments": ("comments comment comment-list comments-area respond reply replies discussion disqus reader-comments responses feedback", ("section", "div", "ol", "aside")),
    "footer": ("footer site-footer bottom copyright legal colophon credits page-footer", ("footer", "div", "section")),
}


#: Private characters that carry a label through the mark-up.
MAIN, REST = "\ue000", "\ue001"


class PageMaker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        out = [self.word() for _ in range(self.r.randint(lo, hi))]
        return (" ".join(out)).capitalize()

    def sentences(self, lo: int, hi: int) -> str:
        return " ".join(self.words(3, 16) + self.r.choice(".....?!") for _ in range(self.r.randint(lo, hi)))

    def names(self, choices: str) -> str:
        if self.r.random() < 0.12:
            return ""
        name = self.r.choice(choices.split())
        if self.r.random() < 0.3:
            name += " " + self.r.choice(["clearfix", "container", "row", "col-4", "wrap", "block", self.word()])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def inline(self, text: str) -> str:
        x = self.r.random()
        if x < 0.1:
            cut = len(text) // 2
            return f'{text[:cut]}<a href="/{self.word()}">{text[cut : cut + 12]}</a>{text[cut + 12 :]}'
        return f"<b>{text}" + "</b>" * (self.r.random() < 0.6) if x < 0.2 else text

    def mark(self, text: str, main: bool) -> str:
        """The label travels in the text, as a first character that is taken off again."""
        return (MAIN if main else REST) + text

    def boiler(self, kind: str) -> str:
        r, (names, tags) = self.r, PARTS[kind]
        tag = r.choice(tags)
        attributes = self.names(names)
        if tag in ("div", "section", "ul", "ol") and not attributes:
            attributes = f' class="{r.choice(names.split())}"'
        m = lambda t: self.mark(t, False)
        link = lambda: f'<a href="/{self.word()}">{m(self.words(1, 3))}</a>'
        if kind in ("menu", "share", "related"):
            items = "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 8)))
            inner = items if tag in ("ul", "menu", "ol") else (f"<h3>{m(self.words(1, 3))}</h3>" * (kind == "related")) + f"<ul>{items}</ul>"
        elif kind == "form":
            inner = f"<label>{m(self.words(1, 4))}</label><input name=q><button>{m(self.words(1, 2))}</button>" + f"<p>{m(self.sentences(1, 2))}</p>" * (r.random() < 0.5)
            if r.random() < 0.3:
                inner += "<select>" + "".join(f"<option>{m(self.word())}" for _ in range(3)) + "</select>"
        elif kind == "comments":
            inner = f"<h{r.randint(2, 4)}>{m(self.words(1, 3))}</h3>"
            for _ in range(r.randint(1, 5)):
                body = m(self.sentences(1, 5))
                inner += r.choice([f'<div class="comment"><span>{m(self.word())}</span><p>{body}</p></div>', f"<li><p>{body}</p></li>", f'<article class="comment"><p>{body}</p></article>', f"<article><p>{body}</p></article>", f"<section><p>{body}</p></section>", f"<p>{body}</p>"])
        elif kind == "sidebar":
            inner = f"<h3>{m(self.words(1, 3))}</h3>" + r.choice([f"<p>{m(self.sentences(1, 4))}</p>", f"<ul>{''.join(f'<li>{link()}</li>' for _ in range(4))}</ul>", f"<div>{m(self.sentences(1, 3))}</div>"])
        elif kind == "header":
            links = " | ".join(link() for _ in range(r.randint(1, 4)))
            inner = r.choice([links, f"<table><tr><td>{links}</td></tr></table>", f"<h1>{m(self.words(1, 4))}</h1>", f"<a href=/>{m(self.words(1, 3))}</a>", f"<p>{m(self.words(2, 8))}</p>", f"<h2>{m(self.words(1, 4))}</h2><nav>{link()} {link()}</nav>"])
        elif kind == "footer":
            inner = r.choice([f"{m('&copy; 2020 ' + self.words(1, 4))} &middot; {self.sentences(1, 2)}", f"<p>{m('&copy; ' + self.words(2, 8))}</p>", f"<ul><li>{link()}<li>{link()}</ul><p>{m(self.sentences(1, 3))}</p>"])
        else:
            inner = r.choice([m(self.sentences(1, 3)), f"<p>{m(self.sentences(1, 4))}</p>", f"<p>{m(self.sentences(1, 2))}</p><button>{m(self.word())}</button>", f"<h4>{m(self.words(1, 3))}</h4>{m(self.sentences(1, 2))}"])
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def main_blocks(self) -> list[str]:
        r, m = self.r, lambda t: self.mark(t, True)
        out = []
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 14])):
            x = r.random()
            shut = "</p>" * (r.random() < 0.85)
            if x < 0.72:
                out.append(f"<p>{self.inline(m(self.sentences(1, 7)))}{r.choice(['', '', '<br>'])}{shut}")
            elif x < 0.78:
                out.append(f"<p>{m(self.words(1, 5))}{shut}")
            elif x < 0.85:
                h = r.randint(2, 4)
                out.append(f"<h{h}>{m(self.words(1, 7))}</h{h}>")
            elif x < 0.9:
                kind = r.choice(["ul", "ol"])
                out.append(f"<{kind}>{''.join(f'<li>{m(self.words(2, 12))}' + '</li>' * r.randint(0, 1) for _ in range(r.randint(2, 5)))}</{kind}>")
            elif x < 0.93:
                out.append(f"<blockquote>{m(self.sentences(1, 3))}</blockquote>")
            elif x < 0.95:
                out.append(f"<pre>{m(self.words(3, 20))}</pre>")
            elif x < 0.97:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{m(self.words(1, 4))}</td>" for _ in range(2)) + "</tr>" for _ in range(3)) + "</table>")
            else:
                out.append(f"<figure><img src=x><figcaption>{m(self.words(3, 10))}</figcaption></figure>")
        return out

    def page(self) -> str:
        r = self.r
        bare = r.random() < 0.2  # a page that is little but its main text
        chance = lambda p, kind: self.boiler(kind) if r.random() < p * (0.1 if bare else 1) else ""
        blocks = self.main_blocks()
        title = f"<h1>{self.mark(self.words(2, 12), True)}</h1>"
        if r.random() < 0.15:
            title = f"<header>{title}</header>"
        for kind in ("advert", "related", "share", "notice", "form", "sidebar"):
            if blocks and r.random() < 0.13:
                blocks.insert(r.randint(0, len(blocks)), self.boiler(kind))
        body = (title if r.random() < 0.85 else "") + "".join(blocks)
        if not blocks and "h1" not in body:
            body = f"<p>{self.mark(self.sentences(1, 3), True)}</p>"
        wrap = r.random()
        if wrap < 0.12:  # parts of the main text in elements of their own
            cut = r.randint(0, len(blocks))
            body = body[: len(body) - sum(map(len, blocks[cut:]))] + "".join(f"<{t}>{b}</{t}>" for b in blocks[cut:] for t in [r.choice(["section", "div"])])
        elif wrap < 0.16:
            body = f"<section>{body}</section>"
        tail = chance(0.2, "share") + chance(0.15, "comments")
        style = r.random()
        if style < 0.55:
            main = f"<article{self.names(' '.join(MAIN_NAMES)) if r.random() < 0.4 else ''}>{body}{tail}</article>"
        elif style < 0.7:
            main = f"<main>{body}{tail}</main>"
        elif style < 0.92:
            main = f'<div {r.choice(["class", "id"])}="{r.choice(MAIN_NAMES)}">{body}{tail}</div>'
        elif style < 0.96:
            main = f"<div>{body}</div>{tail}"
        elif style < 0.985:
            main = body
        else:
            main = self.mark(self.sentences(1, 5), True)
        if r.random() < 0.25:
            main = f'<div class="{r.choice(["container", "wrapper", "row", "layout", "page", "site"])}">{main}</div>'
        return (
            f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
            + chance(0.25, "notice") + chance(0.45, "header") + chance(0.7, "menu") + "<!-- x -->" * r.randint(0, 1) + chance(0.4, "advert") + chance(0.15, "sidebar")
            + main
            + chance(0.25, "comments") + chance(0.25, "related") + chance(0.3, "sidebar") + chance(0.2, "form") + chance(0.2, "advert") + chance(0.75, "footer") + chance(0.1, "notice")
            + "</body></html>" * (r.random() < 0.8)
        )


def labelled_pages(n: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels (1: main text) of ``n`` pages."""
    maker, out = PageMaker(seed), []
    while len(out) < n:
        blocks = leaf_blocks(maker.page())
        labels = [int(MAIN in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(MAIN, "").replace(REST, "")
        if blocks:
            out.append((blocks, labels))
    return out
