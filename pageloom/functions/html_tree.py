"""HTML text -> pre-order node lists, the one Python step of the engine.

``parse_batches`` is handed to ``mapInArrow``: it gets Arrow batches holding an
``html`` column and gives the same batches with ``nodes`` in its place.  The
tree rules are the everyday part of HTML5: void, raw-text and text-only
elements, implied html/head/body, implied ends of p, li, dd/dt, option, headings
and table parts, stray end tags dropped, svg/math name spaces.  Reopening of
formatting elements (adoption agency) and moving content out of tables are not
done: the text of a page is unaffected, its nesting may be.
"""

from __future__ import annotations

import gc
import re
from html import unescape

import pyarrow as pa

_ATTR = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+"""
_TOKEN = re.compile(
    r"<(?:"
    rf"(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[\s/]++|{_ATTR})*+)>"
    r"|/(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|!--(?:-?>|(?P<comment>.*?)(?:--!?>|\Z))"
    r"|!(?P<doctype>(?i:doctype)[^>]*+)>?"
    r"|(?:!|(?=\?)|/(?=[^a-zA-Z>]))(?P<bogus>[^>]*+)>?"
    r"|/>"
    r"|(?P<cut>/?[a-zA-Z].*)\Z"
    r")",
    re.S,
)
_ATTR_PARTS = re.compile(
    r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|((?!["'])[^\s>]*+)))?+"""
)
_ATTR_REF = re.compile(r"&(?:#[xX]?[0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*(?:;|(?![a-zA-Z0-9=])))")
_SPACE = " \t\n\f\r"

VOID = frozenset(
    "area base br col embed hr img input keygen link meta param source track wbr".split()
)
RAW_TEXT = frozenset("iframe noembed noframes noscript plaintext script style xmp".split())
_RCDATA = frozenset(("title", "textarea"))
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW_TEXT | _RCDATA}
_HEAD = frozenset(
    "base basefont bgsound link meta noframes noscript script style template title".split()
)
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CLOSES_P = _HEADING | frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption "
    "figure footer form header hgroup hr li listing main menu nav ol p plaintext pre search "
    "section summary table ul xmp".split()
)
_TABLE = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
_ROWS = frozenset(("tbody", "thead", "tfoot"))
_SCOPE = frozenset("applet caption html marquee object table td template th".split())
_SPECIAL = _CLOSES_P | _TABLE | _SCOPE | _HEAD | frozenset(
    "area body br button embed frame frameset head iframe img input param select source "
    "textarea track wbr".split()
)
_BUTTON_SCOPE = _SCOPE | {"button"}
_LIST_SCOPE = _SCOPE | {"ol", "ul"}
_TABLE_SCOPE = frozenset(("html", "table", "template"))
_FRAME = frozenset(("html", "head", "body"))
_BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img "
    "li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul "
    "var".split()
)
_HTML_INSIDE = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
# Elements ended by the start of a sibling, and where the search for one stops.
_SIBLING = {"li": ({"li"}, {"address", "div", "p"}), "dd": ({"dd", "dt"}, {"address", "div", "p"})}
_SIBLING["dt"] = _SIBLING["dd"]
_CAREFUL = _TABLE | frozenset("a button dd dt form image li optgroup option rb rp rt rtc".split())
_EATS = frozenset(_RAW_END) | {"pre", "listing"}


def _attr_text(value: str) -> str:
    if "&" not in value:
        return value
    return _ATTR_REF.sub(lambda m: unescape(m.group()), value)


def _attributes(raw: str) -> dict[str, str]:
    """Attributes of a start tag, the first of a name counting."""
    found: dict[str, str] = {}
    for name, dq, sq, bare in _ATTR_PARTS.findall(raw):
        name = name.lower()
        if name not in found:
            found[name] = _attr_text(dq or sq or bare)
    return found


_NONE: dict[str, str] = {}


class PageTree:
    """Nodes of one page; place in ``rows`` = pre-order position."""

    FIELDS = ("kind", "parent", "tag", "attrs", "text", "ns", "depth")

    def __init__(self, seen: dict[str, dict] | None = None) -> None:
        # The same few tags fill most pages: attributes by their source text,
        # shared between nodes and pages and never changed.
        self.seen = {} if seen is None else seen
        self.rows: list[tuple] = [("document", -1, None, None, None, None, 0)]
        self.stack = [0]  # open nodes, and their tags and name spaces
        self.names: list[str | None] = [None]
        self.spaces = [""]
        self.open: dict[str, int] = {}  # open elements per tag
        self.html = self.head = self.body = None
        self.head_done = False
        self.between: list[tuple[str, str]] = []  # blanks and comments between head and body
        self.tail: list[tuple[int, str]] = []  # comments after the body

    # -- growing the tree ----------------------------------------------------
    def add(self, kind, tag=None, attrs=None, text=None, ns=None, parent=None) -> int:
        at = len(self.rows)
        if parent is None:
            parent = self.stack[-1]
        self.rows.append((kind, parent, tag, attrs, text, ns, self.rows[parent][6] + 1))
        return at

    def push(self, tag, attrs, ns="") -> int:
        stack, rows = self.stack, self.rows
        at = len(rows)
        parent = stack[-1]
        rows.append(("element", parent, tag, attrs, None, ns, rows[parent][6] + 1))
        stack.append(at)
        self.names.append(tag)
        self.spaces.append(ns)
        self.open[tag] = self.open.get(tag, 0) + 1
        return at

    def pop(self) -> str:
        self.stack.pop()
        self.spaces.pop()
        tag = self.names.pop()
        self.open[tag] -= 1
        return tag

    def pop_to(self, tags) -> None:
        while self.pop() not in tags:
            pass

    def merge_attrs(self, at, attrs) -> None:
        row = self.rows[at]
        self.rows[at] = row[:3] + ({**attrs, **row[3]},) + row[4:]

    def in_scope(self, tags, stop=_SCOPE) -> bool:
        """Is one of ``tags`` open with no boundary above it?"""
        for tag in reversed(self.names):
            if tag in tags:
                return True
            if tag in stop:
                return False
        return False

    def close_p(self) -> None:
        if self.open.get("p") and self.in_scope(("p",), _BUTTON_SCOPE):
            self.pop_to(("p",))

    # -- implied html, head, body ------------------------------------------
    def need_html(self, attrs=_NONE) -> None:
        if self.html is None:
            self.html = self.push("html", attrs)

    def need_head(self, attrs=_NONE) -> None:
        self.need_html()
        if self.head is None:
            self.head = self.push("head", attrs)

    def end_head(self) -> None:
        self.need_head()
        if not self.head_done:
            self.head_done = True
            self.pop_to(("head",))

    def need_body(self, attrs=_NONE) -> None:
        if self.body is None:
            self.end_head()
            for kind, text in self.between:
                if kind == "text":
                    self.put_text(text)
                else:
                    self.add(kind, text=text)
            self.body = self.push("body", attrs)

    # -- tokens ------------------------------------------------------------
    def put_text(self, text: str) -> None:
        rows, parent = self.rows, self.stack[-1]
        last = rows[-1]
        if last[0] == "text" and last[1] == parent:
            rows[-1] = last[:4] + (last[4] + text,) + last[5:]
        else:
            rows.append(("text", parent, None, None, text, None, rows[parent][6] + 1))

    def on_text(self, text: str) -> None:
        if self.body is None:
            rest = text.lstrip(_SPACE)
            blank = text[: len(text) - len(rest)]
            if blank and self.head is not None:
                if self.head_done:
                    self.between.append(("text", blank))
                else:
                    self.put_text(blank)
            if not rest:
                return
            self.need_body()
            text = rest
        self.put_text(text)

    def on_comment(self, text: str, ended: str) -> None:
        if ended:
            self.tail.append((0 if ended == "html" else self.html, text))
        elif self.head_done and self.body is None:
            self.between.append(("comment", text))
        else:
            self.add("comment", text=text)

    def on_start(self, tag: str, raw: str) -> int | None:
        attrs = _NONE
        if raw:
            attrs = self.seen.get(raw)
            if attrs is None:
                attrs = _attributes(raw)
                if len(self.seen) < 4096:
                    self.seen[raw] = attrs
        if self.body is None or tag in _FRAME:
            return self.outside_body(tag, attrs, raw)
        space = self.spaces[-1]
        if space and self.names[-1] not in _HTML_INSIDE:
            if tag not in _BREAKOUT:
                return self.foreign(tag, attrs, raw, space)
            while self.spaces[-1] and self.names[-1] not in _HTML_INSIDE:
                self.pop()
        if tag in ("svg", "math"):
            return self.foreign(tag, attrs, raw, tag)
        return self.in_body(tag, attrs)

    def outside_body(self, tag, attrs, raw) -> int | None:
        """Tags of the page frame, and everything before the body opens."""
        at = {"html": self.html, "body": self.body}.get(tag)
        if at is not None:
            self.merge_attrs(at, attrs)
        elif tag == "html":
            self.need_html(attrs)
        elif tag == "head":
            if self.head is None:
                self.need_head(attrs)
        elif tag == "body":
            self.need_body(attrs)
        elif tag in _HEAD:
            self.need_head()
            if self.head_done:  # late head element: still belongs to head
                return self.late_head(tag, attrs)
            return self.leaf_or_push(tag, attrs)
        else:
            self.need_body()
            return self.on_start(tag, raw)
        return None

    def late_head(self, tag, attrs) -> int:
        self.stack.append(self.head)
        self.names.append("head")
        self.spaces.append("")
        self.open["head"] += 1
        at = self.leaf_or_push(tag, attrs)
        if self.names[-1] == "head":
            self.pop()
        return at

    def foreign(self, tag, attrs, raw, ns) -> int:
        at = self.push(tag, attrs, ns)
        if raw.endswith("/"):
            self.pop()
        return at

    def leaf_or_push(self, tag, attrs) -> int:
        if tag in VOID:
            return self.add("element", tag, attrs, None, "")
        return self.push(tag, attrs)

    def in_body(self, tag, attrs) -> int | None:
        names = self.names
        if tag in _CAREFUL:
            if tag == "image":
                tag = "img"
            elif tag in _TABLE:
                if not self.open.get("table"):
                    return None
                self.open_table_part(tag)
            elif tag == "form":
                if self.open.get("form"):
                    return None
            elif tag in _SIBLING:
                self.end_sibling(tag)
            elif tag in ("option", "optgroup"):
                if names[-1] == "option":
                    self.pop()
                if tag == "optgroup" and names[-1] == "optgroup":
                    self.pop()
            elif tag == "button":
                if self.open.get("button") and self.in_scope(("button",)):
                    self.pop_to(("button",))
            elif tag == "a":
                if self.open.get("a"):
                    self.end_plain("a")
            elif names[-1] in ("rb", "rp", "rt"):  # ruby parts
                self.pop()
        if tag in _CLOSES_P:
            self.close_p()
            if tag in _HEADING and names[-1] in _HEADING:
                self.pop()
        return self.leaf_or_push(tag, attrs)

    def end_sibling(self, tag) -> None:
        tags, passable = _SIBLING[tag]
        if not any(self.open.get(t) for t in tags):
            return
        for name in reversed(self.names):
            if name in tags:
                self.pop_to((name,))
                return
            if name is None or (name in _SPECIAL and name not in passable):
                return

    def open_table_part(self, tag) -> None:
        if tag in ("td", "th"):
            stops = _ROWS | {"table", "tr"}
        elif tag == "tr":
            stops = _ROWS | {"table"}
        else:
            stops = {"table", "colgroup"} if tag == "col" else {"table"}
        while self.names[-1] not in stops:
            self.pop()
        if tag == "col" and self.names[-1] == "table":
            self.push("colgroup", _NONE)
        if tag in ("td", "th", "tr") and self.names[-1] == "table":
            self.push("tbody", _NONE)
        if tag in ("td", "th") and self.names[-1] != "tr":
            self.push("tr", _NONE)

    def on_end(self, tag: str) -> None:
        if self.body is None:
            if tag == "head":
                self.end_head()
            elif tag in ("title", "script", "style", "noscript", "noframes", "template"):
                if self.open.get(tag):
                    self.pop_to((tag,))
                if self.head_done and self.names[-1] == "head":
                    self.pop()
            elif tag in ("br", "p"):
                self.need_body()
                self.on_end(tag)
        elif tag == "p":
            if not (self.open.get("p") and self.in_scope(("p",), _BUTTON_SCOPE)):
                self.push("p", _NONE)
            self.pop_to(("p",))
        elif tag == "br":
            self.leaf_or_push("br", _NONE)
        elif tag in _HEADING:
            if self.in_scope(_HEADING):
                self.pop_to(_HEADING)
        elif not self.open.get(tag):
            pass
        elif tag == "table" or tag in _TABLE:
            if self.in_scope((tag,), _TABLE_SCOPE):
                self.pop_to((tag,))
        elif tag in _CLOSES_P or tag == "button":
            if self.in_scope((tag,), _LIST_SCOPE if tag == "li" else _SCOPE):
                self.pop_to((tag,))
        else:
            self.end_plain(tag)

    def end_plain(self, tag) -> None:
        """End of an inline element: closes it unless a block lies in between."""
        for i in range(len(self.names) - 1, 0, -1):
            name = self.names[i]
            if name == tag:
                self.pop_to((tag,))
                return
            if name in _SPECIAL and not self.spaces[i]:
                return

    # -- whole page ----------------------------------------------------------
    def feed(self, html: str) -> "PageTree":
        if "\r" in html:
            html = html.replace("\r\n", "\n").replace("\r", "\n")
        if "\0" in html:
            html = html.replace("\0", "")
        at, size, ended = 0, len(html), ""
        while at < size:
            m = _TOKEN.search(html, at)
            stop = m.start() if m else size
            if stop > at:
                self.on_text(unescape(html[at:stop]))
            if not m:
                break
            at = m.end()
            which = m.lastgroup
            if which in ("start", "attrs"):
                tag, raw = m.group("start").lower(), m.group("attrs")
                if self.on_start(tag, raw) is not None:
                    ended = ""
                    if tag in _EATS and not self.spaces[-1]:
                        at = self.after_start(html, at, tag)
            elif which == "end":
                tag = m.group("end").lower()
                if tag in ("body", "html"):
                    if self.body is None:
                        self.need_body()
                    ended = "html" if tag == "html" else ended or "body"
                else:
                    self.on_end(tag)
            elif which == "doctype":
                if self.html is None:
                    name = m.group("doctype")[7:].split()
                    self.add("doctype", name[0].lower() if name else "")
            elif which == "comment" or html.startswith("<!--", m.start()):
                self.on_comment(m.group("comment") or "", ended)
            elif which == "bogus":
                self.on_comment(m.group("bogus"), ended)
        self.need_body()
        for parent, text in sorted(self.tail, key=lambda t: -t[0]):
            self.add("comment", text=text, parent=parent)
        for field, values in zip(self.FIELDS, zip(*self.rows)):
            setattr(self, field, list(values))
        return self

    def after_start(self, html: str, at: int, tag: str) -> int:
        """Eat the content of raw-text elements and the newline after pre."""
        if tag in _RAW_END:
            end = None if tag == "plaintext" else _RAW_END[tag].search(html, at)
            stop = end.start() if end else len(html)
            text = html[at:stop]
            if tag in _RCDATA:
                text = unescape(text)
            if tag == "textarea" and text.startswith("\n"):
                text = text[1:]
            if text:
                self.put_text(text)
            return stop
        if tag in ("pre", "listing") and html.startswith("\n", at):
            return at + 1
        return at

    def last_descendants(self) -> list[int]:
        fin = list(range(len(self.rows)))
        parent = self.parent
        for at in range(len(fin) - 1, 0, -1):
            up = parent[at]
            if fin[at] > fin[up]:
                fin[up] = fin[at]
        return fin


def _node_array(pages: list[PageTree], nodes_type: pa.DataType) -> pa.Array:
    """One Arrow list of node structs per page, built column by column."""
    node_type = nodes_type.value_type
    offsets, pre, fin = [0], [], []
    cols: dict[str, list] = {k: [] for k in ("parent", "depth", "kind", "tag", "ns", "text")}
    attrs: list[dict | None] = []
    for page in pages:
        size = len(page.rows)
        offsets.append(offsets[-1] + size)
        pre.extend(range(size))
        fin.extend(page.last_descendants())
        for name, values in cols.items():
            values.extend(getattr(page, name))
        attrs.extend(page.attrs)
    keys, values, at = [], [], [0]
    for found in attrs:
        if found:
            keys.extend(found.keys())
            values.extend(found.values())
        at.append(len(keys))
    ints = {"pre": pre, "fin": fin, "n_attrs": [len(a) if a else 0 for a in attrs], **cols}
    arrays = []
    for field in node_type:
        if field.name == "attrs":
            arrays.append(
                pa.MapArray.from_arrays(
                    pa.array(at, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string())
                )
            )
        else:
            arrays.append(pa.array(ints[field.name], field.type))
    struct = pa.StructArray.from_arrays(arrays, names=[f.name for f in node_type])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)


NODES_ARROW = pa.list_(
    pa.struct(
        [
            ("pre", pa.int32()),
            ("fin", pa.int32()),
            ("parent", pa.int32()),
            ("depth", pa.int32()),
            ("kind", pa.string()),
            ("tag", pa.string()),
            ("ns", pa.string()),
            ("n_attrs", pa.int32()),
            ("attrs", pa.map_(pa.string(), pa.string())),
            ("text", pa.string()),
        ]
    )
)


def parse_batches(batches, flush_chars: int = 4_000_000):
    """mapInArrow body: replace ``html`` by ``nodes``, keep every other column.

    Pages are wide, so a batch is cut again once it holds ``flush_chars``
    characters; this bounds the worker's memory whatever the batch size.
    """
    # Trees hold no reference cycles; the collector would only walk them.
    gc.disable()
    try:
        yield from _parsed(batches, flush_chars)
    finally:
        gc.enable()


def _parsed(batches, flush_chars):
    seen: dict[str, dict] = {}
    for batch in batches:
        names = batch.schema.names
        html = batch.column(names.index("html"))
        rest = [(n, batch.column(i)) for i, n in enumerate(names) if n != "html"]
        start, size, pages = 0, 0, []
        for row in range(batch.num_rows):
            page = html[row].as_py() or ""
            pages.append(PageTree(seen).feed(page))
            size += len(page)
            if size >= flush_chars or row == batch.num_rows - 1:
                cut = [c.slice(start, row + 1 - start) for _, c in rest]
                nodes = _node_array(pages, NODES_ARROW)
                pages = []
                yield pa.RecordBatch.from_arrays(cut + [nodes], [n for n, _ in rest] + ["nodes"])
                start, size = row + 1, 0
        # nothing of a batch is held while the next is read
        batch = html = rest = cut = nodes = None
