"""Scalar expressions shared by the extractors, as Spark SQL text.

Expressions in this package are SQL fragments (``str -> str``) that end up in
one ``F.expr`` per output column.  An extractor holds a few thousand operator
nodes; as text they reach the JVM in one call, where building them node by node
through the Column API took seconds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import count
from types import SimpleNamespace

NBSP = "\u00a0"
_ids = count(1)
_BOUND = re.compile(r"v\d+(?:\.\w+|\['[^']*'\])*")


def lit(value: str) -> str:
    """SQL string literal."""
    value = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
    return f"'{value}'"


def each(function: str, array: str, body: Callable[..., str], arity: int = 1) -> str:
    """Higher-order function call with fresh variable names."""
    names = [f"v{next(_ids)}" for _ in range(arity)]
    head = names[0] if arity == 1 else f"({', '.join(names)})"
    return f"{function}({array}, {head} -> {body(*names)})"


def keep(array: str, pred: Callable[[str], str]) -> str:
    return each("filter", array, pred)


def mapped(array: str, body: Callable[..., str], arity: int = 1) -> str:
    return each("transform", array, body, arity)


def let(value: str, body: Callable[[str], str]) -> str:
    """Bind ``value`` once and use it many times inside one expression.

    A lambda variable is never inlined by the optimizer, so a costly value used
    inside another lambda is still computed once and not once per element.  A
    path of such a variable (``v3.attrs['src']``) counts as bound.
    """
    if _BOUND.fullmatch(value):
        return body(value)
    return f"get({mapped(f'array({value})', body)}, 0)"


def lets(body: Callable[[SimpleNamespace], str], **steps: Callable[[SimpleNamespace], str]) -> str:
    """Bind several values in order; each step sees the ones before it."""
    names = list(steps)

    def bind(i: int, env: dict[str, str]) -> str:
        if i == len(names):
            return body(SimpleNamespace(**env))
        value = steps[names[i]](SimpleNamespace(**env))
        return let(value, lambda v: bind(i + 1, {**env, names[i]: v}))

    return bind(0, {})


def case(*branches: tuple[str, str], other: str = "NULL") -> str:
    arms = " ".join(f"WHEN {cond} THEN {value}" for cond, value in branches)
    return f"(CASE {arms} ELSE {other} END)"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def ws_trim(x: str) -> str:
    """Strip Unicode white space, NBSP included, at both ends."""
    return rf"regexp_replace({x}, r'(?U)^\s+|\s+$', '')"


def plain_spaces(x: str) -> str:
    """NBSP -> space."""
    return f"translate({x}, '{NBSP}', ' ')"


def absent(x: str) -> str:
    """The absence rule: an empty string is NULL."""
    return let(x, lambda v: f"if({v} = '', NULL, {v})")


def strict_int(x: str, to: str = "INT") -> str:
    """Whole decimal number or NULL; no blanks, fractions or exponents."""
    return let(x, lambda v: case((rf"rlike({v}, r'^[+-]?[0-9]+\z')", f"try_cast({v} AS {to})")))


def positive(x: str) -> str:
    """0 counts as absent."""
    return let(x, lambda v: f"if({v} = 0, NULL, {v})")


def pixels(x: str) -> str:
    return positive(strict_int(x))


def epoch_time(x: str) -> str:
    """Epoch seconds as text -> timestamp, NULL for a bad number."""
    return f"timestamp_seconds({strict_int(x, 'BIGINT')})"


_RFC3339 = (
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)\z"
)


def rfc3339(x: str) -> str:
    """RFC 3339 text -> timestamp.  The pattern keeps out date-only and zone-less
    forms, which a bare cast would take."""
    return let(
        x,
        lambda v: case(
            (f"rlike({v}, r'{_RFC3339}')", f"try_cast(replace({v}, ',', '.') AS TIMESTAMP)")
        ),
    )


def known_keys(json: str, names: Sequence[str]) -> str:
    """JSON text whose keys of these names, in any case, are written as given.

    A quoted name before a colon is a key: inside a string its quotes are escaped, and
    the closing one then follows a backslash.  One search tells whether a key is written
    in another way at all; few texts are searched again for each name.
    """
    keys = rf"""regexp_extract_all({json}, r'(?i)"({'|'.join(names)})"(?=\s*:)', 1)"""
    given = ", ".join(lit(name) for name in names)
    out = json
    for name in names:
        out = rf"""regexp_replace({out}, r'(?i)"{name}"(?=\s*:)', '"{name}"')"""
    return f"if({each('exists', keys, lambda k: f'{k} NOT IN ({given})')}, {out}, {json})"


_ESCAPES = [("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("\r", "&#13;")]


def replaced(x: str, pairs: Sequence[tuple[str, str]]) -> str:
    """Every plain text of ``pairs`` replaced by its partner, in order.

    ``replace`` compares whole slices at every place of a text, ``contains`` the first
    byte; so what ``x`` does not hold is not looked for again: an empty search text
    leaves a string as it is.  ``x`` is a column or a bound variable.  No partner may
    hold a later plain text.
    """
    out = x
    for plain, ref in pairs:
        plain = lit(plain)
        out = f"replace({out}, if(contains({x}, {plain}), {plain}, ''), {lit(ref)})"
    return out


def escape_html(x: str) -> str:
    return let(x, lambda v: replaced(v, _ESCAPES))
