"""Blocks of a web page: its text in page order, with what the markup says of each block.

A tolerant single pass over the tags, as pages are rarely well-formed: end
tags that are missing are implied by the next block or the end of the parent,
stray ones are ignored, an unfinished tag at the end of a cut page is dropped,
and scripts and styles end at their own end tag only.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: what the markup says of a block
OUTSIDE, ARTICLE, FURNITURE = 0, 1, 2

_NAME = r"([a-zA-Z][^\s/>]*+)"
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(/?){_NAME}((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    rf"|<(/?){_NAME}([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^a-z0-9]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes xmp".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
             "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
             "ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
SPACED = {"br", "td", "th"}
#: elements that end an open one of their own kind within the given parents
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "option": ("select",)}
HEAD = set("head title meta link script style base noscript template".split())
#: never part of the main text
DROPPED = set("head nav footer aside form button select dialog menu noscript template object svg canvas "
              "audio video datalist search".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
#: words of a class or id that name page furniture
FURNITURE_WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar cookie cookies consent gdpr "
    "notice alert popup modal overlay newsletter subscribe subscription ad ads advert adverts advertisement "
    "advertisements sponsor sponsored promo promotion banner comment comments disqus replies respond share sharing "
    "social related recommended recommendations widget widgets pagination pager login signin signup copyright "
    "toolbar".split())
#: the same, unless they stand in the article
HEADER_WORDS = {"header"}
NEGATED = set("no has with without is not".split())
UNFLAGGED = {"html", "body", "main"}


def _is_furniture(name: str, attributes: str, in_article: bool) -> bool:
    if name in DROPPED or name == "header" and not in_article:
        return True
    if name in UNFLAGGED or not attributes.strip():
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key == "role" and value in DROPPED_ROLES:
            return True
        if key in ("class", "id"):
            for name_ in value.split():
                words = _WORD.split(name_)
                for i, w in enumerate(words):
                    if (w in FURNITURE_WORDS or w in HEADER_WORDS and not in_article) \
                            and not (i and words[i - 1] in NEGATED):
                        return True
    return False


def blocks(page: str) -> Iterator[tuple[str, int]]:
    """(text, OUTSIDE / ARTICLE / FURNITURE) of every block with text, in page order.

    Character references are decoded, white space becomes one space, ends are trimmed.
    """
    stack: list[tuple[str, int]] = []       # open elements: name, what they make of their text
    parts: list[tuple[str, int]] = []       # text of the block so far, and the state it stands in
    at, end = 0, len(page)

    def state() -> int:
        return stack[-1][1] if stack else OUTSIDE

    def close(index: int) -> None:
        del stack[index:]

    def opened(name: str, stop: tuple[str, ...] = ()) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                return i
            if stack[i][0] in stop:
                break
        return -1

    def add(text: str) -> None:
        parts.append((text, state()))

    def lines() -> list[tuple[str, int]]:
        """The block that ends here; furniture within its line is a block of its own behind it."""
        out = []
        for of in sorted({s for _, s in parts}):
            line = _SPACE.sub(" ", "".join(t for t, s in parts if s == of)).strip()
            if line:
                out.append((line, of))
        parts.clear()
        return out

    while at < end:
        tag = page.find("<", at)
        found = _TAG.match(page, tag) if tag >= 0 else None
        if tag < 0 or found is None:            # text up to the end, or a lone "<"
            stop = end if tag < 0 else tag + 1
            add(html.unescape(page[at:stop]))
            at = stop
            continue
        if tag > at:
            add(html.unescape(page[at:tag]))
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing, attributes = found[1] or found[4], found[3] or found[6] or ""
        if name in SPACED:
            add(" ")
        is_block = name in BLOCKS
        if is_block:
            yield from lines()
        if closing:
            i = opened(name)
            if i >= 0:
                close(i)
            continue
        if stack and stack[-1][0] == "head" and name not in HEAD:
            close(len(stack) - 1)
        if name in RAW:
            done = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            if done is None:
                at = end
            else:
                at = page.find(">", done.end())
                at = end if at < 0 else at + 1
            add(" ")
            continue
        if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
            continue
        if is_block:                            # a block ends an open paragraph
            i = opened("p", tuple(BLOCKS - {"p"}))
            if i >= 0:
                close(i)
            if name in SIBLINGS:
                i = opened(name, SIBLINGS[name])
                if i >= 0:
                    close(i)
        above = state()
        mine = above
        if name == "main":
            mine = ARTICLE
        elif above != FURNITURE:
            if _is_furniture(name, attributes, above == ARTICLE):
                mine = FURNITURE
            elif name == "article":
                mine = ARTICLE
        if is_block:
            stack.append((name, mine))
        elif mine != above:                     # inline elements matter only where they are furniture
            stack.append((name, mine))
    yield from lines()
