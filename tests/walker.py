"""A plain recursive tree walker; the tests' independent yardstick."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

TAGS = ("div", "span", "b", "i", "section")
CLASSES = (None, "x", "y", "x y")


@dataclass
class Node:
    tag: str | None  # None: text
    text: str = ""
    attrs: dict = field(default_factory=dict)
    children: list = field(default_factory=list)


def random_tree(rng: random.Random, depth: int = 0) -> Node:
    node = Node(rng.choice(TAGS))
    cls = rng.choice(CLASSES)
    if cls:
        node.attrs["class"] = cls
    if rng.random() < 0.3:
        node.attrs["data-q"] = rng.choice(['a"b', "<&>", "it's", ""])
    for _ in range(rng.randint(0, 4 if depth < 4 else 0)):
        last_is_text = bool(node.children) and node.children[-1].tag is None
        if rng.random() < 0.4 and not last_is_text:
            node.children.append(Node(None, rng.choice(["a", " ", "b & c", "<d>", 'q"t', "é z"])))
        else:
            node.children.append(random_tree(rng, depth + 1))
    return node


def esc(s: str) -> str:
    for a, b in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        s = s.replace(a, b)
    return s


def render(node: Node) -> str:
    if node.tag is None:
        return esc(node.text)
    attrs = "".join(f' {k}="{esc(v)}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}>" + "".join(map(render, node.children)) + f"</{node.tag}>"


def walk(node: Node):
    yield node
    for child in node.children:
        yield from walk(child)


def outermost(node: Node, pred) -> list[Node]:
    if pred(node):
        return [node]
    return [hit for child in node.children for hit in outermost(child, pred)]


def text_of(node: Node) -> str:
    return "".join(n.text for n in walk(node) if n.tag is None)


def inner(node: Node) -> str:
    return "".join(c.text if c.tag is None else render(c) for c in node.children)
