"""Tree operators over a page's node list, as Spark SQL expressions.

A page's nodes are one array column in pre-order, so ``nodes[i].pre = i`` and
the subtree of a node is the index range ``[pre, fin]``.  Every operator below
is row-local: the plan of an extractor has no exchange, no sort and no join, and
its cost grows with the page, not with the table.  Wherever an operator takes
``scope`` it is any pre-ordered node array (a page, a subtree, earlier hits);
``nodes`` is always the whole page.  Use with ``F.expr``::

    trees.select(F.expr(text("nodes", find_first("nodes", match("title")))))
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pageloom.functions.html_tree import RAW_TEXT, VOID
from pageloom.functions.scalars import case, each, escape_html, keep, let, lit, mapped, struct

Predicate = Callable[[str], str]


# -- node access -----------------------------------------------------------


def attr(node: str, name: str) -> str:
    return f"{node}.attrs[{lit(name)}]"


def has_attr(node: str, name: str) -> str:
    return f"({attr(node, name)} IS NOT NULL)"


def is_element(node: str) -> str:
    return f"{node}.kind = 'element'"


def is_text(node: str) -> str:
    return f"{node}.kind = 'text'"


def match(
    tag: str | None = None,
    attrs: Mapping[str, str] | None = None,
    ns: str | None = None,
    attr_ns: Mapping[str, str] | None = None,
    kind: str = "element",
) -> Predicate:
    """Node predicate: kind, and tag, name space and attributes where given.

    Attribute values are compared whole, so ``class`` is one string and not a
    token list.  ``attr_ns`` names the prefix an attribute must carry
    (``{"href": "xlink"}``); prefixed attributes exist only in svg and math.
    """

    def test(node: str) -> str:
        terms = [f"{node}.kind = {lit(kind)}"]
        if tag is not None:
            terms.append(f"{node}.tag = {lit(tag)}")
        if ns is not None:
            terms.append(f"{node}.ns = {lit(ns)}")
        for name, value in (attrs or {}).items():
            prefix = (attr_ns or {}).get(name)
            if prefix:
                terms.append(f"{node}.ns != '' AND {attr(node, f'{prefix}:{name}')} = {lit(value)}")
            else:
                terms.append(f"{attr(node, name)} = {lit(value)}")
        return "(" + " AND ".join(terms) + ")"

    return test


def both(*preds: Predicate) -> Predicate:
    return lambda node: "(" + " AND ".join(p(node) for p in preds) + ")"


# -- selection ---------------------------------------------------------------


def subtree(nodes: str, root: str) -> str:
    """Nodes of the subtree, root first; NULL root gives NULL.  Reads only the
    subtree's own index range, so nested searches stay linear."""
    return let(
        root, lambda r: mapped(f"sequence({r}.pre, {r}.fin)", lambda i: f"get({nodes}, {i})")
    )


def find_all(scope: str, pred: Predicate) -> str:
    return keep(scope, pred)


def find_first(scope: str, pred: Predicate) -> str:
    return f"get({keep(scope, pred)}, 0)"


def last(array: str) -> str:
    return f"try_element_at({array}, -1)"


def find_last(scope: str, pred: Predicate) -> str:
    return last(keep(scope, pred))


def values_of(items: str, value: Callable[[str], str]) -> str:
    """Values that are not NULL, in order."""
    return keep(mapped(items, value), lambda v: f"{v} IS NOT NULL")


def last_of(items: str, value: Callable[[str], str]) -> str:
    """Last value that is not NULL (a later find overwrites an earlier one)."""
    return last(values_of(items, value))


def walk_until(scope: str, stop: Predicate) -> str:
    """Nodes seen by a scan that ends at the first stop node, that node included."""
    return let(
        f"{find_first(scope, stop)}.pre",
        lambda at: keep(scope, lambda n: f"{at} IS NULL OR {n}.pre <= {at}"),
    )


def _drop_nested(hits: str) -> str:
    """Keep hits outside every earlier hit.  Two neighbours overlap iff any two
    hits do, so the usual flat list is passed through untouched."""
    overlap = each(
        "exists",
        f"sequence(1, size({hits}) - 1)",
        lambda i: f"get({hits}, {i}).pre <= get({hits}, {i} - 1).fin",
    )
    step = each(
        "aggregate",
        f"{hits}, {struct(fin='-1', kept=f'slice({hits}, 1, 0)')}",
        lambda acc, n: case(
            (
                f"{n}.pre > {acc}.fin",
                struct(fin=f"{n}.fin", kept=f"concat({acc}.kept, array({n}))"),
            ),
            other=acc,
        ),
        arity=2,
    )
    return case((f"size({hits}) > 1 AND {overlap}", f"{step}.kept"), other=hits)


def outermost(scope: str, pred: Predicate) -> str:
    """Hits of a scan that skips the subtree of each hit."""
    return let(keep(scope, pred), _drop_nested)


def outermost_until(scope: str, pred: Predicate, stop: Predicate) -> str:
    """``outermost`` that gives up everything after the first surviving stop hit."""
    return let(outermost(scope, pred), lambda hits: walk_until(hits, stop))


def dispatch(scope: str, rules: Sequence[tuple[str, Predicate]]) -> str:
    """First rule in order claims an element and hides its subtree from all rules.

    Gives ``ARRAY<STRUCT<rule, node>>`` in page order.
    """

    def label(node: str) -> str:
        return case(*[(pred(node), lit(name)) for name, pred in rules])

    hits = outermost(scope, lambda n: f"{is_element(n)} AND {label(n)} IS NOT NULL")
    return mapped(hits, lambda n: struct(rule=label(n), node=n))


def nodes_of(hits: str, *rules: str) -> str:
    """Nodes of a dispatch result that were claimed by the given rules."""
    names = ", ".join(lit(r) for r in rules)
    return mapped(keep(hits, lambda h: f"{h}.rule IN ({names})"), lambda h: f"{h}.node")


# -- content -------------------------------------------------------------------


def texts(nodes: str, root: str) -> str:
    """Text pieces under root, in order."""
    return mapped(keep(subtree(nodes, root), is_text), lambda n: f"{n}.text")


def text(nodes: str, root: str) -> str:
    return f"array_join({texts(nodes, root)}, '')"


def last_text(nodes: str, root: str) -> str:
    return last(texts(nodes, root))


_VOID = ", ".join(lit(t) for t in sorted(VOID))
_RAW = ", ".join(lit(t) for t in sorted(RAW_TEXT))


def _open_tag(nodes: str, node: str) -> str:
    attributes = mapped(
        f"map_entries({node}.attrs)",
        lambda e: f"""concat(' ', {e}.key, '="', {escape_html(f'{e}.value')}, '"')""",
    )
    # A leading newline in these is dropped by parsers, so it is doubled.
    guard = let(
        f"get({nodes}, {node}.pre + 1)",
        lambda n: case(
            (
                f"{node}.tag IN ('pre', 'listing', 'textarea') AND {n}.parent = {node}.pre "
                f"AND startswith({n}.text, '\\n')",
                "'\\n'",
            ),
            other="''",
        ),
    )
    return (
        f"concat('<', {node}.tag, array_join({attributes}, ''), "
        f"if({node}.tag IN ({_VOID}), '/>', '>'), {guard})"
    )


def _open_html(nodes: str, node: str) -> str:
    raw = f"get({nodes}, {node}.parent).tag IN ({_RAW})"
    return case(
        (is_element(node), _open_tag(nodes, node)),
        (f"{is_text(node)} AND {raw}", f"{node}.text"),
        (is_text(node), escape_html(f"{node}.text")),
        (f"{node}.kind = 'comment'", f"concat('<!--', {node}.text, '-->')"),
        (f"{node}.kind = 'doctype'", f"concat('<!DOCTYPE ', {node}.tag, '>')"),
        other="''",
    )


def _events(nodes: str, node: str) -> str:
    """Opening and closing strings keyed so that sorting puts them in page order;
    of several elements ending together the deeper one closes first."""
    opened = struct(at=f"{node}.pre", phase="0", up="0", s=_open_html(nodes, node))
    closed = struct(
        at=f"{node}.fin", phase="1", up=f"-{node}.depth", s=f"concat('</', {node}.tag, '>')"
    )
    has_close = f"{is_element(node)} AND {node}.tag NOT IN ({_VOID})"
    return let(opened, lambda o: case((has_close, f"array({o}, {closed})"), other=f"array({o})"))


def outer_html(nodes: str, root: str) -> str:
    events = f"flatten({mapped(subtree(nodes, root), lambda n: _events(nodes, n))})"
    return f"array_join({mapped(f'array_sort({events})', lambda e: f'{e}.s')}, '')"


def mixed(nodes: str, root: str, transparent: Sequence[str] = ()) -> str:
    """Inner content of root: bare text plus the outer HTML of child elements.

    Text is not escaped while rendered elements are.  ``transparent`` tags are
    looked through instead of being rendered.
    """

    def counts(node: str) -> str:
        return f"{node}.kind IN ('text', 'element')"

    if transparent:
        names = ", ".join(lit(t) for t in transparent)
        pieces = outermost(
            subtree(nodes, root),
            lambda n: f"{counts(n)} AND {n}.pre != {root}.pre "
            f"AND coalesce({n}.tag NOT IN ({names}), true)",
        )
    else:
        pieces = keep(subtree(nodes, root), lambda n: f"{n}.parent = {root}.pre AND {counts(n)}")
    rendered = mapped(
        pieces, lambda n: case((is_text(n), f"{n}.text"), other=outer_html(nodes, n))
    )
    return f"array_join({rendered}, '')"
