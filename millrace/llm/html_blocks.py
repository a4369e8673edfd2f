"""HTML as a list of leaf blocks: runs of text between block-level tags, each with the
tags above it. A small tolerant reader; per page, no tree is kept, only the open tags."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|textarea|title|select)(?=[\s/>])[^>]*+>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^\"'>])*+)>"
    # A tag with an unclosed quote or without an end is cut at the next sign.
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in (
    "script", "style", "template", "textarea", "title", "select")}
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.I)
_NAMED = ("class", "id", "role", "style", "aria-hidden", "itemprop")

# Fixed by the HTML standard: tags without an end, and tags that run inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark "
    "meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
    # Formulas and drawings stand in the line they are written in.
    + "math semantics annotation merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot "
      "mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover "
      "svg circle defs desc ellipse g line path polygon polyline rect symbol text tspan use".split())
# Labels of a drawing and cells of a formula are words of their own.
_APART = frozenset("text desc mtd annotation".split())
# A new one of these ends an open one of the same kind.
_SELF_CLOSING = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_SCOPES = frozenset("ul ol dl table article section aside nav main div form body html".split())


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    # Words of class, id, role and the like of the open tags, outermost first.
    names: tuple[str, ...]
    linked: int = 0


@dataclass
class _Open:
    tag: str
    names: str


@dataclass
class _State:
    stack: list[_Open] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0


def _names(attrs: str) -> str:
    if "=" not in attrs and "hidden" not in attrs.lower():
        return ""
    out = []
    for name, *values, bare in _ATTRIBUTE.findall(attrs):
        name = name.lower()
        if bare or name == "aria-hidden" and "true" in values:
            out.append("hidden")
        elif name == "style":
            style = "".join(values).replace(" ", "").lower()
            if "display:none" in style or "visibility:hidden" in style:
                out.append("hidden")
        elif name in _NAMED:
            out.append("".join(values).lower())
    return " ".join(out)


def blocks(page: str | None) -> list[Block]:
    """The non-empty leaf blocks of a page in page order. Character references are
    decoded, white space becomes one space and is trimmed. Comments, the head's title,
    scripts, styles, templates and the choices and fields of forms are not text; formulas,
    labels of drawings and what stands in noscript and iframe are. A null page has
    none; a page that breaks off ends with what it has."""
    made: list[Block] = []
    if not page:
        return made
    now, at, size = _State(), 0, len(page)

    def flush():
        if now.parts:
            text = " ".join(html.unescape("".join(now.parts)).split())
            if text:
                made.append(Block(text, tuple(o.tag for o in now.stack),
                                  tuple(o.names for o in now.stack if o.names), now.linked))
            now.parts.clear()
            now.linked = 0

    def text(part: str):
        if part:
            now.parts.append(part)
            if now.links:
                now.linked += len(part)

    def drop(index: int):
        now.links -= sum(o.tag == "a" for o in now.stack[index:])
        del now.stack[index:]

    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        if raw := found["raw"]:
            end = _RAW_END[raw.lower()].search(page, at)
            if end:
                at = end.end()
            elif raw.lower() in ("script", "style", "template"):
                at = size
            continue
        if not (tag := found["tag"]):
            continue
        tag = tag.lower()
        if tag in _APART and now.parts:
            now.parts.append(" ")
        if found["close"]:
            if tag in VOID:
                if tag == "br":
                    flush()
                continue
            index = next((i for i in range(len(now.stack) - 1, -1, -1) if now.stack[i].tag == tag), None)
            if tag not in INLINE:
                flush()
            elif index is not None and any(o.tag not in INLINE for o in now.stack[index:]):
                continue  # an inline end does not end blocks
            if index is not None:
                drop(index)
            continue
        if tag not in INLINE:
            flush()
            _close_before(tag, now.stack, drop)
        if tag in VOID or found["attrs"].endswith("/") and tag in INLINE:
            continue
        now.stack.append(_Open(tag, _names(found["attrs"])))
        now.links += tag == "a"
    flush()
    return made


def _close_before(tag, stack, drop):
    """Ends that a block-level start implies."""
    if tag in ("br", "hr", "img", "input"):
        return
    closing = _SELF_CLOSING.get(tag, ())
    for i in range(len(stack) - 1, -1, -1):
        open_ = stack[i].tag
        if open_ in closing:
            drop(i)
            return
        if open_ == "p":
            drop(i)
            return
        if open_ in _SCOPES or open_ in ("tr", "tbody", "thead", "blockquote") and tag not in ("tr",):
            return
