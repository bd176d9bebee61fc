"""Tags, texts and links of pages, read in one pass over their characters.

What looks like a tag in a comment, a quoted value, a script or a style is none. The walk
never goes back, so its time follows a page's length, whatever is left open in it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements without readable text.
DROPPED = ("script", "style", "nav", "footer", "header", "svg", "noscript")
# Elements that have no end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
# Elements whose content is no markup.
RAW = ("script", "style")
_NAME, _STOP = re.compile(r"</?([a-zA-Z][^\s/>]*)"), re.compile(r""">|=\s*(["'])""")
_ENDS = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


def _tag_end(page: str, at: int) -> int:
    """The place after the ``>`` that ends the tag whose name ends at ``at``; that of no quoted value. -1 if none does."""
    while stop := _STOP.search(page, at):
        if not stop[1]:
            return stop.end()
        at = page.find(stop[1], stop.end()) + 1
        if not at:
            break
    return -1


def tags(page: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """``start``, ``end``, ``name`` (lower case; empty for a comment), ``attributes`` and whether it is an end tag, of each tag and comment in order.

    A tag that never ends takes the rest of the page with it, as an open comment and an open script do.
    """
    at = page.find("<")
    while at >= 0:
        name, attributes, closes, sign = "", "", False, page[at + 1 : at + 2]
        if sign == "!" or sign == "?":
            long = page.startswith("<!--", at)
            end = page.find("-->" if long else ">", at + 2 if long and page.startswith("<!-->", at) else at + 4 if long else at + 2)
            end = len(page) if end < 0 else end + (3 if long else 1)
        elif found := _NAME.match(page, at):
            name, closes = found[1].lower(), sign == "/"
            end = _tag_end(page, found.end())
            if end < 0:
                yield at, len(page), "", "", False
                return
            attributes = page[found.end() : end - 1]
        else:  # a sign like any other
            at = page.find("<", at + 1)
            continue
        yield at, end, name, attributes, closes
        if name in RAW and not closes:
            last = _ENDS[name].search(page, end)
            if not last:
                yield end, len(page), "", "", False
                return
            end = last.start()
        at = page.find("<", end)


def attribute(attributes: str, name: str) -> str | None:
    """The first value of an attribute, without its quotes and with its entities read; empty if it has none, None if it is not there."""
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() == name:
            value = m[2] or ""
            return html.unescape(value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] else value)
    return None


def _hidden(attributes: str) -> bool:
    if "hidden" not in attributes.lower() and "display:" not in attributes:
        return False
    style = attribute(attributes, "style") or ""
    return attribute(attributes, "hidden") is not None or "display:none" in style or "display: none" in style


def visible_text(page: str) -> str:
    """Texts outside of dropped and hidden elements, whatever these hold, with a line end for each tag and comment."""
    out, at, inside, depth = [], 0, "", 0
    for start, end, name, attributes, closes in tags(page):
        if not inside:
            out += (page[at:start], "\n")
        at = end
        opens = bool(name) and not closes and name not in VOID and not attributes.endswith("/")
        if inside:
            depth += (1 if opens else -1 if closes else 0) if name == inside else 0
            inside = inside if depth else ""
        elif opens and (name in DROPPED or _hidden(attributes)):
            inside, depth = name, 1
    return html.unescape("".join(out if inside else [*out, page[at:]]))


def links_of(page: str) -> tuple[list[dict[str, str]], list[str]]:
    """Anchors (``href`` and ``text``, neither trimmed) and addresses of frames, in order.

    An anchor ends at its end tag, at the next anchor, or with the page. Its text is that of all elements inside but scripts and styles.
    """
    anchors: list[dict[str, str]] = []
    frames: list[str] = []
    pieces, href, at, raw = [], None, 0, False

    def close() -> None:
        if href:
            anchors.append({"href": href, "text": html.unescape("".join(pieces))})

    for start, end, name, attributes, closes in tags(page):
        if href is not None and not raw:
            pieces.append(page[at:start])
        at, raw = end, name in RAW and not closes
        if name == "a":
            close()
            pieces, href = [], None if closes else (attribute(attributes, "href") or "").strip(" \t\n\f\r")
        elif name in ("iframe", "embed") and not closes and (source := (attribute(attributes, "src") or "").strip(" \t\n\f\r")):
            frames.append(source)
    if href is not None and not raw:
        pieces.append(page[at:])
    close()
    return anchors, frames


#: Pages that are Python objects at a time; all else of a batch stays in Arrow's memory.
AT_ONCE = 64


def _mapped(pages: pa.Array, kind: pa.DataType, walk: Callable[[str], object]) -> pa.Array:
    parts = [pa.array([], kind)]
    for at in range(0, len(pages), AT_ONCE):
        parts.append(pa.array([walk(page) for page in pages.slice(at, AT_ONCE).to_pylist()], kind))
    return pa.concat_arrays(parts)


@F.arrow_udf(T.StringType())
def walked_text(pages: pa.Array) -> pa.Array:
    return _mapped(pages, pa.string(), lambda page: None if page is None else visible_text(page))


_LINK = T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])
_LINKS = pa.struct([("anchors", pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))), ("frames", pa.list_(pa.string()))])


@F.arrow_udf(T.StructType([T.StructField("anchors", T.ArrayType(_LINK)), T.StructField("frames", T.ArrayType(T.StringType()))]))
def walked_links(pages: pa.Array) -> pa.Array:
    return _mapped(pages, _LINKS, lambda page: dict(zip(("anchors", "frames"), ([], []) if page is None else links_of(page))))
