"""Tree operators against a plain recursive walker on random trees."""

import random

import pytest

from pageloom.functions.scalars import mapped
from pageloom.operators import tree as t
from tests import walker

THREE_FILES = """<ul id=downloads>
<li><b>Guide</b> <object data-file="guide.pdf" type="pdf"></object>
<li><object data-file="map.svg"><i>no viewer</i></object><li>none</ul>
<section><object data-file="song.ogg"></object></section>"""


@pytest.fixture(scope="module")
def forest(trees_of):
    rng = random.Random(7)
    roots = [walker.random_tree(rng) for _ in range(150)]
    df = trees_of(*["<body>" + walker.render(r) for r in roots]).cache()
    df.count()
    return roots, df


BODY = t.find_first("nodes", t.match("body"))


def answers(df, sql):
    return [r.x for r in df.selectExpr("page_id", f"{sql} AS x").orderBy("page_id").collect()]


def is_x(node):
    return node.tag is not None and node.attrs.get("class") == "x"


IS_X = t.match(attrs={"class": "x"})


def test_find(forest):
    roots, df = forest
    hits = [[n for n in walker.walk(r) if is_x(n)] for r in roots]
    got = answers(df, mapped(t.find_all("nodes", IS_X), lambda n: f"{n}.tag"))
    assert got == [[n.tag for n in h] for h in hits]
    assert answers(df, t.find_first("nodes", IS_X) + ".tag") == [h[0].tag if h else None for h in hits]
    assert answers(df, t.find_last("nodes", IS_X) + ".tag") == [h[-1].tag if h else None for h in hits]


def test_class_is_compared_whole(forest):
    roots, df = forest
    got = answers(df, f"size({t.find_all('nodes', t.match('div', {'class': 'x y'}))})")
    assert got == [sum(n.tag == "div" and n.attrs.get("class") == "x y" for n in walker.walk(r)) for r in roots]


def test_text_and_html(forest):
    roots, df = forest
    root = f"get(nodes, {BODY}.pre + 1)"
    assert answers(df, t.text("nodes", root)) == [walker.text_of(r) for r in roots]
    assert answers(df, t.outer_html("nodes", root)) == [walker.render(r) for r in roots]
    bound = t.let(root, lambda r: t.mixed("nodes", r))
    assert answers(df, bound) == [walker.inner(r) for r in roots]


def test_outermost_and_nested_hits(forest):
    roots, df = forest
    got = answers(df, mapped(t.outermost("nodes", IS_X), lambda n: t.text("nodes", n)))
    want = [[walker.text_of(n) for n in walker.outermost(r, is_x)] for r in roots]
    assert got == want
    assert any(
        len(walker.outermost(r, is_x)) < sum(map(is_x, walker.walk(r))) for r in roots
    ), "the sample must hold nested hits"


def test_walk_until(forest):
    roots, df = forest

    def seen(root):
        out = []
        for n in walker.walk(root):
            out.append(n)
            if n.tag == "b":
                break
        return len(out)

    scope = t.subtree("nodes", f"get(nodes, {BODY}.pre + 1)")
    assert answers(df, f"size({t.walk_until(scope, t.match('b'))})") == [seen(r) for r in roots]


def test_outermost_until_gives_up_the_rest(forest):
    roots, df = forest
    stop = t.match("span")

    def kept(root):
        out = []
        for n in walker.outermost(root, is_x):
            out.append(n)
            if n.tag == "span":
                break
        return len(out)

    assert answers(df, f"size({t.outermost_until('nodes', IS_X, stop)})") == [kept(r) for r in roots]


def test_dispatch_priority_and_pruning(forest):
    roots, df = forest
    rules = [("first", t.match("b")), ("second", IS_X), ("third", t.match("i"))]

    def label(n):
        if n.tag == "b":
            return "first"
        return "second" if is_x(n) else "third" if n.tag == "i" else None

    got = answers(df, mapped(t.dispatch("nodes", rules), lambda h: f"{h}.rule"))
    assert got == [[label(n) for n in walker.outermost(r, label)] for r in roots]


def test_transparent_tags_are_looked_through(trees_of):
    df = trees_of("<body><div>a<div>b<i>c<div>d</div></i></div><b>e</b></div>")
    root = t.find_first("nodes", t.match("div"))
    got = answers(df, t.let(root, lambda r: t.mixed("nodes", r, ("div",))))
    assert got == ["ab<i>c<div>d</div></i><b>e</b>"]


def test_rendering_details(trees_of):
    df = trees_of(
        """<body><p><br><img src="a"><!--c--><script>a<b&c</script><pre>\n\nx</pre></p>""",
        """<body><p>'"&lt;&amp;</p>""",
    )
    got = answers(df, t.outer_html("nodes", BODY))
    assert got[0] == '<body><p><br/><img src="a"/><!--c--><script>a<b&c</script></p><pre>\n\nx</pre><p></p></body>'
    assert got[1] == "<body><p>&#39;&#34;&lt;&amp;</p></body>"


def test_first_and_all_of_several(trees_of):
    df = trees_of(THREE_FILES)
    every = t.find_all("nodes", t.match("object"))
    names = ["guide.pdf", "map.svg", "song.ogg"]
    assert answers(df, mapped(every, lambda n: t.attr(n, "data-file"))) == [names]
    assert answers(df, t.attr(t.find_first("nodes", t.match("object")), "data-file")) == names[:1]


def test_name_space_filters(trees_of):
    df = trees_of('<svg><a href="1" xlink:href="2"></a></svg><a href="1"></a>')

    def count(pred):
        return answers(df, f"size({t.find_all('nodes', pred)})")[0]

    assert count(t.match("a", {"href": "1"})) == 2
    assert count(t.match("a", {"href": "1"}, ns="svg")) == 1
    assert count(t.match("a", {"href": "2"}, attr_ns={"href": "xlink"})) == 1
    assert count(t.match(kind="text")) == 0


def test_missing_root_gives_null(trees_of):
    df = trees_of("<p>x")
    none = t.find_first("nodes", t.match("article"))
    assert answers(df, t.text("nodes", none)) == [None]
    assert answers(df, t.subtree("nodes", none)) == [None]


def test_many_nested_hits_in_one_page(trees_of):
    """A page of thousands of hits, nested and flat, stays exact."""
    df = trees_of("<div class=x><b class=x></b></div>" * 2000)
    assert answers(df, f"size({t.outermost('nodes', IS_X)})") == [2000]
