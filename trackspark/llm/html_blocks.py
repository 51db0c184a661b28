"""Leaf blocks of an HTML page, with the names of their features."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable

#: Element names of the HTML standard by how a page's text treats them.
RAW = frozenset("script style iframe textarea title".split())
#: Elements inside a line that can hold blocks.
EMBEDDED = frozenset("noscript object svg math canvas audio video select".split())
#: What a head can hold; anything else ends it.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
ZONES = frozenset("article main nav aside footer header form section body dialog menu".split())
#: Elements that a start tag of the same group ends.
_ENDS = {t: frozenset(g.split()) for g in ("li", "dt dd", "tr", "td th", "option", "p") for t in g.split()}
_P_ENDERS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements of a drawing whose text stands alone.
_DRAWN = frozenset("text title desc foreignobject".split())
_SCOPE = frozenset("template object svg math select datalist article aside body div footer form header main nav ol section table td th ul dl".split())

# an attribute's value is quoted, or ends at white space or >; a quote without a partner is part of such a value, and quotes elsewhere mean nothing
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)>|[!?/][^>]*+>)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
_WORD = re.compile(r"[a-z]+")


class Frame:
    """An open element: the names its blocks inherit, and their score."""

    __slots__ = ("tag", "names", "zones", "link", "score", "inline", "hidden", "foreign")

    def __init__(self, tag: str, names: frozenset[str], zones: tuple[str, ...], link: bool, score: float, inline: bool, hidden: bool = False, foreign: bool = False):
        self.tag, self.names, self.zones, self.link, self.score, self.inline = tag, names, zones, link, score, inline
        self.hidden, self.foreign = hidden, foreign  # in a template; in a drawing or formula


def tokens_of(attributes: str) -> set[str]:
    """Words of class, id, role and itemprop values; compounds are split at capitals and signs."""
    found: set[str] = set()
    for m in _NAMES.finditer(attributes):
        value = m[1] or m[2] or m[3] or ""
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
        for w in _WORD.findall(value):
            found.add(w)
            if w.endswith("s") and len(w) > 3:
                found.add(w[:-1])
    return found


def text_names(text: str, tag: str, linked: int, previous: int) -> list[str]:
    """Features of a block's own text, apart from its ancestors."""
    words = text.split()
    n = len(words)
    share = linked / max(1, len(text))
    return [
        f"leaf={tag}",
        f"words={min(7, n.bit_length())}",
        "links=" + ("none" if share == 0 else "few" if share < 0.3 else "many" if share < 0.9 else "all"),
        f"stop={text[-1] in '.!?…:;' if text else False}",
        f"commas={min(2, text.count(','))}",
        f"capital={text[:1].isupper()}",
        f"copyright={'©' in text}",
        f"rule={min(3, sum(map(text.count, '|·»›')))}",
        f"before={min(4, previous.bit_length())}",
    ]


def leaf_blocks(page: str, weigh: Callable[[str], float] | None = None) -> list[tuple[str, Frame, str, int]]:
    """(text, frame, leaf tag, characters inside links) of each block with text, in page order.

    weigh gives a feature's weight, so that scores of ancestors are summed once when an element opens. Scripts, styles, frames, fields, titles and
    templates have no text; a head ends at the first thing that it can't hold.
    """
    value = weigh or (lambda _: 0.0)
    root = Frame("", frozenset(), (), False, 0.0, False)
    stack = [root]
    blocks: list[tuple[str, Frame, str, int]] = []
    parts: list[str] = []
    linked = 0
    home = root

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                blocks.append((text, home, home.tag, linked))
            parts = []
        linked = 0

    def end_head() -> None:
        for i, f in enumerate(stack[:4]):
            if f.tag == "head":
                del stack[i:]
                return

    def say(raw: str) -> None:
        nonlocal linked, home
        if stack[-1].hidden:
            return
        if not raw.isspace():
            end_head()
        if not parts:
            if raw.isspace():
                return
            home = next((f for f in reversed(stack) if not f.inline), root)
        parts.append(raw)
        if stack[-1].link:
            linked += len(raw.strip())

    at, end = 0, len(page)
    last = page.rfind(">") + 1  # no tag ends after it
    while at < end:
        m = _TAG.search(page, at, last)
        if m is None:
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!]", rest)  # a tag that the page ends in
            say(rest[: cut.start()] if cut else rest)
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break  # a comment that the page ends in
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if closing:
            if tag not in INLINE and tag not in EMBEDDED and not (stack[-1].foreign and stack[-1].tag == tag and stack[-1].inline):
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if not all(f.inline for f in stack[i:]):
                        flush()
                    del stack[i:]
                    break
                if tag in INLINE and not stack[i].inline:
                    break
            continue
        if tag in RAW and not (tag == "title" and stack[-1].foreign):
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if not m[3].rstrip().endswith("/"):
                at = stop.end() if stop else end
            continue
        if tag not in HEAD and not stack[-1].hidden:
            end_head()
        if stack[-1].foreign and (tag in _P_ENDERS or tag in ZONES or tag in _ENDS):
            flush()
            del stack[next(i for i, f in enumerate(stack) if f.foreign) :]
        foreign = tag in ("svg", "math") or stack[-1].foreign and tag != "foreignobject"
        inline = tag in INLINE or tag in EMBEDDED or tag == "template" or foreign and tag not in _DRAWN
        if not inline:
            flush()
        if tag in VOID or m[3].endswith("/") and tag not in ZONES:
            continue
        if tag in _P_ENDERS:
            _close(stack, frozenset(("p",)))
        if tag in _ENDS and tag != "p":
            _close(stack, _ENDS[tag])
        top = stack[-1]
        attributes = m[3]
        names = {f"in={tag}"} if not inline else set()
        if "=" in attributes:
            names.update("name=" + t for t in tokens_of(attributes))
        new = names - top.names
        zones = top.zones
        score = top.score + sum(map(value, new))
        if tag in ZONES:
            zones = (*zones[-1:], tag)
            zone = "zones=" + ">".join(zones)
            score += value(zone) - (value("zones=" + ">".join(top.zones)) if top.zones else 0.0)
        stack.append(Frame(tag, top.names | new if new else top.names, zones, top.link or tag == "a", score, inline, top.hidden or tag == "template", foreign))
    flush()
    return blocks


def _close(stack: list[Frame], tags: frozenset[str]) -> None:
    """Ends the nearest open element of these, unless an element that scopes it lies between."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in _SCOPE:
            return


def names_of(block: tuple[str, Frame, str, int], previous: int) -> list[str]:
    """All features of a block, for training; previous is the number of words of the block before."""
    text, frame, tag, linked = block
    zone = ["zones=" + ">".join(frame.zones)] if frame.zones else []
    return [*frame.names, *zone, *text_names(text, tag, linked, previous)]
