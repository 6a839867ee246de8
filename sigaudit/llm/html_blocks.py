"""Text blocks of a page, read from tags alone, with what is known of each block's place in the document."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

#: Elements that begin and end a block, elements without content, and elements whose content is never text (fixed values).
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript svg math iframe object canvas audio video textarea select title".split())
#: Elements, roles and words in class or id names that mark a page's frame, or its main part (fixed values).
FRAME_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
FRAME_WORDS = frozenset(
    "nav navbar navigation menu header masthead topbar footer foot bottom copyright sidebar side aside rail ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social follow comment comments comentario kommentar kommentare commentaires disqus reply replies respond discussion related recommended recommendations breadcrumb breadcrumbs crumbs pagination pager widget widgets toolbar search form tags tagcloud disclaimer skip".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article articlebody content maincontent post postbody entry story storybody main text prose".split())
_NOT = frozenset("with no has without free".split())

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One attribute: its name, and its value if it has one; a quote that nothing closes is part of an unquoted value.
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]+|=)?(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDES = re.compile(r"display\s*:\s*none", re.I)
_NUMBER = re.compile(r"&#(?:x0*+[0-9a-f]{7,}|0*+[0-9]{8,})", re.I)
_ENDS: dict[str, re.Pattern] = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in HIDDEN}


@dataclass(eq=False)
class Element:
    """part: how the element and those around it are marked: "" (not at all), "main", "frame", or "mixed": a main part in a frame. sure:
    that mark is of a tag, role or attribute, not of a word in a name."""

    tag: str
    parent: Element | None
    depth: int
    part: str = ""
    sure: bool = False


@dataclass
class Block:
    text: str
    linked: int
    element: Element


@dataclass
class Tag:
    name: str
    closing: bool
    attributes: dict[str, str]


def _marks(tag: Tag, parent: Element) -> tuple[bool, bool, bool]:
    """Whether an element marks frame, main part; and whether its tag, role or attributes say the same without the words in its names."""
    name = tag.name
    frame, main = name in FRAME_TAGS, name in MAIN_TAGS
    if name == "header" and parent.part != "main":
        frame = True
    given = tag.attributes
    role = given.get("role", "").lower()
    frame, main = frame or role in FRAME_ROLES, main or role in ("main", "article")
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or _HIDES.search(given.get("style", "")):
        frame = True
    sure = (frame, main and not frame)
    for one in f"{given.get('class', '')} {given.get('id', '')} {given.get('itemprop', '')}".split():
        words = {x.lower() for x in _NAME.findall(one)}
        if words & _NOT or name in ("html", "body"):
            continue
        if words & FRAME_WORDS and name != "main":
            frame = True
        elif words & MAIN_WORDS:
            main = True
    return frame, main, sure == (frame, main and not frame)


def _part(tag: Tag, parent: Element) -> tuple[str, bool]:
    """The nearest mark holds, but a main part does not leave the frame that it is in: what it is remains open."""
    frame, main, sure = _marks(tag, parent)
    if frame:
        return "frame", sure
    if main and parent.part != "main":
        return ("mixed" if parent.part else "main"), sure
    if main and sure:
        return "main", True
    return parent.part, parent.sure


def tokens(html: str) -> Iterator[str | Tag]:
    """Texts and tags of a page in order. Every character is read a bounded number of times, however broken the page is: comments,
    declarations and tags that nothing closes run to the page's end, as in browsers."""
    at, size = 0, len(html)
    while at < size:
        open_ = html.find("<", at)
        if open_ < 0:
            yield html[at:]
            return
        following = html[open_ + 1 : open_ + 2]
        closing = following == "/"
        name = _TAG_NAME.match(html, open_ + 1 + closing)
        if not name and following not in ("!", "?", "/"):
            yield html[at : open_ + 1]
            at = open_ + 1
            continue
        if open_ > at:
            yield html[at:open_]
        if not name:
            end = "-->" if html.startswith("<!--", open_) else "]]>" if html.startswith("<![CDATA[", open_) else ">"
            close = html.find(end, open_ + 2)
            at = close + len(end) if close >= 0 else size
            continue
        attributes: dict[str, str] = {}
        at = name.end()
        while True:
            one = _ATTRIBUTE.match(html, at)
            at = one.end()
            if one[1]:
                attributes.setdefault(one[1].lower(), next((x for x in one.groups()[1:] if x is not None), ""))
            elif one.start() == one.end() or at >= size or html[at] == ">":
                break
        if at >= size:
            return
        at += 1
        tag = Tag(name[0].lower(), closing, attributes)
        if tag.name in HIDDEN and not closing:
            if html[at - 2] == "/" and tag.name in ("svg", "math"):
                continue
            end = _ENDS[tag.name].search(html, at)
            at = end.start() if end else size
            continue
        yield tag


def _plain(held: list[str]) -> str:
    """Decoded text with white space as one space; numbers beyond any character become the replacement character."""
    text = "".join(held)
    if "&" in text:
        text = unescape(_NUMBER.sub("&#xfffd", text))
    return " ".join(text.split())


def blocks(html: str) -> list[Block]:
    """The non-empty text blocks in page order: white space is one space, character references are decoded. Unclosed and stray tags
    are taken as browsers do, roughly: a new p, li, row or cell ends the open one, and a stray end tag ends nothing."""
    here = Element("", None, 0)
    opened: Counter[str] = Counter()
    out: list[Block] = []
    held: list[str] = []
    linked, in_link = 0, False

    def close() -> None:
        nonlocal linked
        if held:
            text = _plain(held)
            if text:
                out.append(Block(text, min(linked, len(text)), here))
            held.clear()
        linked = 0

    def leave() -> None:
        nonlocal here
        opened[here.tag] -= 1
        here = here.parent

    for token in tokens(html):
        if isinstance(token, str):
            held.append(token)
            linked += len(token) if in_link else 0
            continue
        tag = token.name
        if tag == "a":
            in_link = not token.closing
        elif tag == "br":
            held.append(" ")
        if tag not in BLOCK:
            continue
        close()
        in_link = False
        if token.closing:
            if opened[tag] > 0:
                while here.tag != tag:
                    leave()
                leave()
        elif tag not in EMPTY:
            if here.tag == "p" or (here.tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                leave()
            here = Element(tag, here, here.depth + 1, *_part(token, here))
            opened[tag] += 1
    close()
    return out
