"""The HTML helper on its own: tree rules, references, bad markup."""

import random

from hypothesis import given, settings, strategies as st

from pageloom.functions.html_tree import PageTree
from tests import walker


def tree(html):
    return PageTree().feed(html)


def outline(html):
    """Body as nested text, e.g. ``p(a b(c))``."""
    page = tree(html)

    def show(at):
        if page.kind[at] == "text":
            return page.text[at]
        if page.kind[at] == "comment":
            return f"!{page.text[at]}"
        kids = " ".join(show(i) for i in range(len(page.kind)) if page.parent[i] == at)
        return f"{page.tag[at]}({kids})"

    return show(page.body)[5:-1]


def test_empty_page_has_html_head_body():
    assert tree("").tag == [None, "html", "head", "body"]
    assert tree("  \n").tag == [None, "html", "head", "body"]


def test_implied_ends():
    assert outline("<p>a<p>b<div>c</div>") == "p(a) p(b) div(c)"
    assert outline("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>") == "ul(li(1) li(2 ul(li(3))) li(4))"
    assert outline("<dl><dt>a<dd>b<dt>c</dl>") == "dl(dt(a) dd(b) dt(c))"
    assert outline("<h1>a<h2>b</h2>") == "h1(a) h2(b)"
    assert outline("<select><option>a<option>b</select>") == "select(option(a) option(b))"
    assert outline("<table><tr><td>1<td>2<tr><td>3</table>") == "table(tbody(tr(td(1) td(2)) tr(td(3))))"
    assert outline("<a>x<a>y</a>") == "a(x) a(y)"


def test_stray_and_missing_tags():
    assert outline("</div>x</span>") == "x"
    assert outline("x</p>y") == "x p() y"
    assert outline("<p><b>x</p>y") == "p(b(x)) y"
    assert outline("<td>x") == "x"
    assert outline("<div") == ""
    assert outline("a < b & c &lt; d") == "a < b & c < d"


def test_void_raw_and_comments():
    assert outline("<br/><img src=x>t") == "br() img() t"
    assert outline('<body><script>"</p>" < 1</script>z') == 'script("</p>" < 1) z'
    assert outline("<div>a<!-- <p> -->b</div>") == "div(a ! <p>  b)"
    assert outline("<textarea>\n<b>&amp;</textarea>") == "textarea(<b>&)"
    assert outline("<body><?php x ?>y<!x>z</ q>") == "!?php x ? y !x z ! q"


def test_attributes():
    page = tree("""<body><a HREF='1' class="a b" data-x=y&amp;z hidden href=2 title="&copy=1 &lt;">""")
    assert page.attrs[page.tag.index("a")] == {
        "href": "1", "class": "a b", "data-x": "y&z", "hidden": "", "title": "&copy=1 <",
    }


def test_head_and_body_placement():
    page = tree("<title>t</title><meta a=1>\n<p>x")
    assert [page.tag[page.parent[page.tag.index(t)]] for t in ("title", "meta", "p")] == ["head", "head", "body"]
    late = tree("<head></head> <!-- c --><script>1</script><body>x")
    assert late.tag[late.parent[late.tag.index("script")]] == "head"
    after = tree("<body>a</body></html><!-- end --> b")
    assert after.kind.count("comment") == 1 and "".join(t for t in after.text if t) .count("b") == 1


def test_whitespace_nodes_are_kept_and_text_is_merged():
    page = tree("<div> <i>x</i>\n</div>a&amp;b")
    assert [t for t in page.text if t is not None] == [" ", "x", "\n", "a&b"]


def test_name_spaces():
    page = tree('<svg><a xlink:href="u"/><foreignObject><p>q</p></foreignObject></svg><math><mi>x</mi></math><a>')
    spaces = dict(zip(page.tag, page.ns))
    assert spaces["svg"] == "svg" and spaces["p"] == "" and spaces["mi"] == "math"


def check_intervals(page):
    fin = page.last_descendants()
    for at in range(1, len(page.kind)):
        up = page.parent[at]
        assert up < at <= fin[at] <= fin[up]
        assert page.depth[at] == page.depth[up] + 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/ab pdivtrh1\"'=&;!-\n lt", max_size=80))
def test_any_text_parses_to_nested_intervals(html):
    check_intervals(tree(html))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(
    "<p> </p> <b> </b> <div> </div> <table> <tr> <td> </table> <ul> <li> </ul> <a> </a> x <br> "
    "<h1> </h1> <script> </script> <svg> </svg> <title> </title> </body> <!--c--> </head>".split()
), max_size=40))
def test_any_tag_soup_parses_to_nested_intervals(parts):
    check_intervals(tree("".join(parts)))


def test_random_trees_come_back():
    rng = random.Random(1)
    for _ in range(200):
        root = walker.random_tree(rng)
        page = tree("<body>" + walker.render(root))
        start = page.body + 1
        expected = list(walker.walk(root))
        assert [n.tag for n in expected] == page.tag[start:]
        assert [n.text if n.tag is None else None for n in expected] == page.text[start:]
        assert [n.attrs for n in expected if n.tag] == [a for a in page.attrs[start:] if a is not None]
