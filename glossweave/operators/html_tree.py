"""One HTML page to tree nodes: the helper that runs inside Python workers.

It is sent to the workers by value, so they need not have this package.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEXT = "#text"
#: Bytes of pages whose nodes are held as Python objects at a time.
PIECE_BYTES = 1 << 20

# --- fixed values: how an HTML 4 recovering parser repairs trees ------------
_VOID = frozenset(
    "area base br col embed frame hr img input link meta param source track wbr".split()
)
_SHAPING = frozenset(("html", "head", "body"))
_HEAD_ONLY = frozenset("base link meta script style title".split())
_FONT_STYLE = frozenset("b big i s small strike tt u".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag closes the innermost open element while that one is listed here.
_IMPLIED_END = {
    **dict.fromkeys(
        "address blockquote center dir div dl fieldset form h1 h2 h3 h4 h5 h6 hr "
        "menu ol pre table ul".split(),
        frozenset(("p",)),
    ),
    "p": frozenset(("p",)) | _HEADINGS | _FONT_STYLE,
    "li": frozenset(("p", "li", "dl", "address", "pre")) | _HEADINGS,
    "dt": frozenset(("p", "dt", "dd")),
    "dd": frozenset(("p", "dt", "dd")),
    "tr": frozenset(("p", "td", "th", "tr")),
    "td": frozenset(("p", "td", "th")),
    "th": frozenset(("p", "td", "th")),
    "option": frozenset(("option",)),
}
# An end tag does not reach past an open element of higher rank than its own.
_RANK = {
    "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180,
    "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220,
}
_DEFAULT_RANK = 100

_ATTRIBUTES = r"""((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)"""
_TOKEN = re.compile(
    rf"""([^<]++)
      | </([a-zA-Z][^\s/>]*+)[^>]*+>?
      | <((?i:script|style))(?=[\s/>]){_ATTRIBUTES}>(.*?)(?=</(?i:\3)[\s/>]|\Z)
      | <([a-zA-Z][^\s/>]*+){_ATTRIBUTES}>
      | <!--.*?(?:-->|\Z)
      | <[!?][^>]*+>?
      | (<)""",
    re.S | re.X,
)
_TEXT, _END, _RAW, _START, _BARE = 1, 2, 5, 7, 8
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_SELF_CLOSED = re.compile(r"""(?:\A|[\s"'])/\s*\Z""")
# A tag that its own text does not tell: the token is read from the page.
_OPEN_END = (-1,)
_KEPT_ATTRIBUTES = {"id": 0, "class": 1, "lang": 2, "data-level": 3}


def _attributes(source: str) -> tuple | None:
    """Kept attributes of a start tag, the first one where a name is repeated."""
    found: list[str | None] = [None] * len(_KEPT_ATTRIBUTES)
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        slot = _KEPT_ATTRIBUTES.get(name.lower())
        if slot is not None and found[slot] is None:
            found[slot] = unescape(double or single or bare)
    return tuple(found) if any(v is not None for v in found) else None


class Nodes:
    """Node columns of a batch of pages, filled page by page while tags are read."""

    def __init__(self, container: str) -> None:
        self.container = container
        # A node's number is its place after its page's first node; -1 stands for none.
        self.fin = array("i")
        self.parent = array("i")
        self.depth = array("i")
        self.tag: list[str] = []
        self.text: list[str | None] = []
        self.near = array("i")
        self.attrs: dict[int, tuple] = {}
        # Tags read so far by what they hold, as :meth:`_known` tells them.
        self.known: dict[str, tuple] = {}

    def _add(self, tag: str, text: str | None = None) -> int:
        """Append a node below the innermost open element."""
        base = self.base
        pre = len(self.tag) - base
        opened = self.open
        above = opened[-1] if opened else -1
        self.fin.append(pre)
        self.parent.append(above)
        self.depth.append(len(opened))
        self.tag.append(tag)
        self.text.append(text)
        if tag == self.container:
            self.near.append(pre)
        else:
            self.near.append(self.near[base + above] if above >= 0 else -1)
        return pre

    def _push(self, tag: str) -> int:
        pre = self._add(tag)
        self.open.append(pre)
        self.names.append(tag)
        return pre

    def _pop(self) -> None:
        self.names.pop()
        self.fin[self.base + self.open.pop()] = len(self.tag) - self.base - 1

    def _enter_body(self) -> None:
        while len(self.open) > 1:
            self._pop()
        self.body = self._push("body")

    def _place(self, tag: str, source: str) -> bool:
        """Handle the tags that shape the document; true if nothing is left to do."""
        if tag == "html" or (tag == "body" and self.body is not None):
            at = self.base + (0 if tag == "html" else self.body)
            attrs = _attributes(source)
            if attrs:
                old = self.attrs.get(at, attrs)
                self.attrs[at] = tuple(a if a is not None else b for a, b in zip(old, attrs))
            return True
        if self.body is None:
            if tag == "body":
                self._enter_body()
                attrs = _attributes(source)
                if attrs:
                    self.attrs[self.base + self.body] = attrs
                return True
            if tag == "head":
                if not self.head:
                    self.head = True
                    self._push("head")
                return True
            if tag not in _HEAD_ONLY:
                self._enter_body()
            elif not self.head:
                self.head = True
                self._push("head")
        return tag == "head"

    def _start(self, tag: str, source: str) -> bool:
        """Open an element; true if it stays open."""
        if (self.body is None or tag in _SHAPING) and self._place(tag, source):
            return False
        closes = _IMPLIED_END.get(tag)
        if closes:
            while self.names[-1] in closes:
                self._pop()
        pre = self._add(tag)
        stays = not (tag in _VOID or (source and source[-1] == "/" and _SELF_CLOSED.search(source)))
        if stays:
            self.open.append(pre)
            self.names.append(tag)
        if source and "=" in source:
            attrs = _attributes(source)
            if attrs:
                self.attrs[self.base + pre] = attrs
        return stays

    def _end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        rank = _RANK.get(tag, _DEFAULT_RANK)
        for at in range(len(self.names) - 1, 0, -1):
            if self.names[at] == tag:
                while len(self.open) > at:
                    self._pop()
                return
            if _RANK.get(self.names[at], _DEFAULT_RANK) > rank:
                return

    def _text(self, text: str) -> None:
        """Adjacent text is one node, also across a tag that was ignored; text of
        white space only is dropped."""
        if self.text[-1] is not None and self.parent[-1] == self.open[-1]:
            self.text[-1] += text
        elif not text.isspace():
            if self.body is None and self.names[-1] in ("html", "head"):
                self._enter_body()
            self._add(TEXT, text)

    def _known(self, inner: str) -> tuple:
        """What a tag means, by what it holds up to the first ``>``: its token kind (0 for
        one that is passed over, -1 if the token may end elsewhere), name, source of its
        attributes, the tags it closes, whether it stays open, and its kept attributes."""
        # With an open quote, a comment or raw text the token would run on to the end.
        token = _TOKEN.match(f"<{inner}>\"'>")
        kind = token.lastindex or 0
        if token.end() != len(inner) + 2 or kind not in (0, _END, _START):
            found = _OPEN_END
        elif kind == _START:
            tag, source = token[6].lower(), token[7]
            stays = not (tag in _VOID or (source and source[-1] == "/" and _SELF_CLOSED.search(source)))
            attrs = _attributes(source) if source and "=" in source else None
            found = (kind, tag, source, _IMPLIED_END.get(tag), stays, attrs)
        else:
            found = (kind, token[2].lower() if kind else "")
        self.known[inner] = found
        return found

    def read(self, page: str) -> None:
        """Append the nodes of one page."""
        base = self.base = len(self.tag)
        opened = self.open = []
        names = self.names = []
        self.head, self.body = False, None
        self._push("html")
        fin, parent, depth, near = self.fin, self.parent, self.depth, self.near
        tags, texts, known, container = self.tag, self.text, self.known, self.container
        # Each piece is a tag and the text after it; ``at`` is the place where it ends.
        pieces = iter(page.split("<"))
        text = next(pieces)
        pending, at = unescape(text) if "&" in text else text, len(text)
        for piece in pieces:
            start, at = at, at + 1 + len(piece)
            inner, closed, text = piece.partition(">")
            what = (known.get(inner) or self._known(inner)) if closed else _OPEN_END
            kind = what[0]
            if kind < 0:
                token = _TOKEN.match(page, start)
                stop, kind = token.end(), token.lastindex or 0
                while at < stop:
                    at += 1 + len(next(pieces))
                text = page[stop:at]
            if "&" in text:
                text = unescape(text)
            if kind == 0 or kind == _BARE:
                pending += "<" + text if kind else text
                continue
            if pending:
                if self.body is None:
                    self._text(pending)
                elif texts[-1] is not None and parent[-1] == opened[-1]:
                    texts[-1] += pending
                elif not pending.isspace():
                    pre, above = len(tags) - base, opened[-1]
                    fin.append(pre)
                    parent.append(above)
                    depth.append(len(opened))
                    tags.append(TEXT)
                    texts.append(pending)
                    near.append(near[base + above])
            pending = text
            if what[0] < 0:
                if kind == _END:
                    self._end(token[2].lower())
                elif kind == _START:
                    self._start(token[6].lower(), token[7])
                elif self._start(token[3].lower(), token[4]):
                    pending = token[5] + text
                continue
            tag = what[1]
            if kind == _END:
                # Most end tags close the innermost open element.
                if names[-1] == tag and len(names) > 1 and tag != "body":
                    names.pop()
                    fin[base + opened.pop()] = len(tags) - base - 1
                else:
                    self._end(tag)
            elif self.body is None or tag in _SHAPING:
                self._start(tag, what[2])
            else:
                _, _, _, closes, stays, attrs = what
                if closes:
                    while names[-1] in closes:
                        names.pop()
                        fin[base + opened.pop()] = len(tags) - base - 1
                pre, above = len(tags) - base, opened[-1]
                fin.append(pre)
                parent.append(above)
                depth.append(len(opened))
                tags.append(tag)
                texts.append(None)
                near.append(pre if tag == container else near[base + above])
                if stays:
                    opened.append(pre)
                    names.append(tag)
                if attrs:
                    self.attrs[base + pre] = attrs
        if pending:
            self._text(pending)
        while self.open:
            self._pop()


def in_pieces(pages: pa.Array, most_bytes: int = PIECE_BYTES) -> Iterator[list[str | None]]:
    """Consecutive runs of pages, as Python strings, of at most ``most_bytes`` bytes (one page
    at least): nodes take many times a page's bytes, so a run is bounded by its size."""
    start, held = 0, 0
    for at, size in enumerate(pc.fill_null(pc.binary_length(pages), 0).to_pylist()):
        if at > start and held + size > most_bytes:
            yield pages.slice(start, at - start).to_pylist()
            start, held = at, 0
        held += size
    if start < len(pages):
        yield pages.slice(start).to_pylist()


def pages_to_arrow(pages: Iterable[str | None], container: str) -> pa.Array:
    """One list of nodes per page, null for a page without content."""
    nodes = Nodes(container)
    offsets, gaps = [0], []
    for page in pages:
        empty = not page or page.isspace()
        gaps.append(empty)
        if not empty:
            nodes.read(page)
        offsets.append(len(nodes.tag))
    # Few nodes have attributes: each column is taken from those that do, by place.
    rows = np.zeros(len(nodes.tag), np.int32)
    rows[list(nodes.attrs)] = np.arange(1, len(nodes.attrs) + 1)
    ids, classes, langs, levels = (
        pa.array([None, *column], pa.string()).take(pa.array(rows))
        for column in zip(*nodes.attrs.values(), *([(None,) * len(_KEPT_ATTRIBUTES)] if not nodes.attrs else []))
    )
    starts = np.array(offsets, np.int64)
    near = np.frombuffer(nodes.near, np.int32)
    fields = {
        "pre": (np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts)), pa.int32()),
        "fin": (np.frombuffer(nodes.fin, np.int32), pa.int32()),
        "parent": (np.frombuffer(nodes.parent, np.int32), pa.int32()),
        "depth": (np.frombuffer(nodes.depth, np.int32), pa.int32()),
        "tag": (nodes.tag, pa.string()),
        "id": (ids, pa.string()),
        "cls": (classes, pa.string()),
        "lang": (langs, pa.string()),
        "level": (levels, pa.string()),
        "text": (nodes.text, pa.string()),
        "near": (pa.array(near, pa.int32(), mask=near < 0), pa.int32()),
    }
    values = pa.StructArray.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in fields.values()], names=list(fields)
    )
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), values, mask=pa.array(gaps, pa.bool_())
    )
