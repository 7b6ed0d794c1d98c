"""Leaf blocks of an HTML page, with their ancestors.

A tolerant scanner in linear time: end tags that nothing opens are ignored,
elements whose end tags may be left out are closed by what follows, inline
elements are transparent, comments, scripts, styles and other raw text are
skipped.  A ``<`` that no ``>`` follows before the next ``<`` outside quotes is
text.  An unclosed comment or raw text runs to the page's end, as in HTML;
embedded content (pictures, players, objects) is skipped where it is closed
and transparent where it isn't.  Blocks deeper than ``DEPTH`` elements have the
features of the ``DEPTH`` outermost ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html"
    " label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Their content is no markup; without an end tag they run to the page's end.
RAW = frozenset("script style iframe xmp title noembed noframes textarea".split())
#: Skipped with their content if an end tag follows, else transparent.
SKIPPED = frozenset("noscript template object svg math head canvas audio video".split())
DEPTH = 128
VOID = frozenset(["hr"])
#: A start tag closes an open element of these, up to the nearest of the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: An end tag doesn't close elements beyond these.
SCOPE = frozenset(["table", "td", "th", "article", "body"])

NAMED = re.compile(r"/?([a-zA-Z][^\s/<>]*)")
STOP = re.compile("[<>\"']")
ANGLE = re.compile("[<>]")
ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW | SKIPPED}
LONG_REFERENCE = re.compile("&#(?:([xX])([0-9a-fA-F]{9,})|([0-9]{9,}));?")
ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Block:
    """A run of text between block-level tags."""

    text: str
    path: tuple[str, ...]  # features of the ancestors, outermost first
    own: str
    linked: float  # share of the characters that lie in links


def element_features(tag: str, attributes: str) -> tuple[str, ...]:
    """``t:`` tag, and ``c:`` the lower-case names in class, id, role and itemprop."""
    out = [f"t:{tag}"]
    if attributes:
        for m in ATTR.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "style":
                if HIDDEN.search(value):
                    out.append("hidden")
            elif name == "hidden" or name == "aria-hidden":
                if value.lower() not in ("false", "no"):
                    out.append("hidden")
            else:
                out += [f"c:{x.lower()}" for x in NAME.findall(value)]
    return tuple(out)


class Tags:
    """Finds where tags end, in time linear in the page.

    What a quote opens is looked for up to the page's end.  Where that leads
    nowhere the tag ends at the next ``>`` that comes before a ``<``; once the
    characters looked at in vain exceed a few times the page, quotes no longer count.
    """

    def __init__(self, html: str):
        self.html, self.size = html, len(html)
        self.last = html.rfind(">")
        self.vain, self.most = 0, 4 * len(html) + 65_536

    def end(self, at: int) -> int:
        """The position of the ``>`` of a tag whose name ends at ``at``, or -1 if it is no tag."""
        if at > self.last:
            return -1
        html, i, quoted = self.html, at, False
        while self.vain <= self.most:
            m = STOP.search(html, i)
            if m is None:
                break
            c, i = m[0], m.end()
            if c == ">":
                return i - 1
            if c == "<":
                if not quoted:
                    return -1
                break
            quoted = True
            shut = html.find(c, i)
            if shut < 0:
                self.vain += self.size - i
                break
            i = shut + 1
        self.vain += i - at
        m = ANGLE.search(html, at)
        return m.start() if m and m[0] == ">" else -1


def decoded(raw: str) -> str:
    """``raw`` with its character references decoded; numbers beyond the last code point give U+FFFD."""

    def small(m: re.Match) -> str:
        digits = (m[2] or m[3]).lstrip("0")
        return "\ufffd" if len(digits) > 8 else f"&#{m[1] or ''}{digits or 0};"

    return unescape(LONG_REFERENCE.sub(small, raw)) if "&" in raw else raw


def leaf_blocks(html: str) -> list[Block]:
    """All blocks of a page that hold text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # tag, features of it and its ancestors
    beyond = 0  # open elements that are deeper than DEPTH
    parts: list[str] = []
    linked = total = 0
    in_link = False
    tags, missing = Tags(html), set()
    at, begin, size = 0, 0, len(html)

    def close() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join(decoded("".join(parts)).split())
            if text:
                tag, path = stack[-1] if stack else ("body", ())
                out.append(Block(text, path, tag, linked / max(1, total)))
            parts.clear()
        linked = total = 0

    def take(piece: str) -> None:
        nonlocal linked, total
        parts.append(piece)
        n = len(piece.strip())
        total += n
        if in_link:
            linked += n

    while True:
        lt = html.find("<", at)
        if lt < 0 or lt + 1 == size:
            break
        m = None
        if html[lt + 1] in "!?":
            comment = html.startswith("!--", lt + 1)
            stop = html.find("-->", lt + 2) if comment else html.find(">", lt + 2) if lt < tags.last else -1
            if stop < 0 and not comment:
                at = lt + 1
                continue
            after = size if stop < 0 else stop + (3 if comment else 1)
        else:
            m = NAMED.match(html, lt + 1)
            stop = tags.end(m.end()) if m else -1
            if stop < 0:
                at = lt + 1
                continue
            after = stop + 1
        if lt > begin:
            take(html[begin:lt])
        at = begin = after
        if m is None:
            continue
        ending, tag, attributes = html[lt + 1] == "/", m[1].lower(), html[m.end() : stop]
        if tag in ENDS:
            if not ending and not attributes.rstrip().endswith("/"):
                found = None if tag in missing else ENDS[tag].search(html, at)
                shut = html.find(">", found.end()) if found else -1
                if shut >= 0:
                    at = begin = shut + 1
                else:
                    missing.add(tag)
                    if tag in RAW:
                        at = begin = size
                if tag == "textarea":
                    close()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag == "a":
            in_link = not ending
            continue
        if tag not in BLOCK:
            continue
        close()
        in_link = False
        if ending:
            if beyond:
                beyond -= 1
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in SCOPE and tag not in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "main", "html"):
                    break
            continue
        if not beyond:
            if stack and stack[-1][0] == "p":
                stack.pop()
            elif stack and re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", stack[-1][0]):
                stack.pop()
            if tag in CLOSES:
                shut_by, scope = CLOSES[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in scope:
                        break
                    if stack[k][0] in shut_by:
                        del stack[k:]
                        break
        if tag not in VOID:
            if len(stack) < DEPTH and not beyond:
                stack.append((tag, (stack[-1][1] if stack else ()) + element_features(tag, attributes)))
            else:
                beyond += 1
    if begin < size:
        take(html[begin:])
    close()
    return out
