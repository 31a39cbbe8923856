"""Hand-written edge pages of both sites."""

from datetime import datetime

import pytest

from pageloom.plans.article_a import article_a
from pageloom.plans.article_b import article_b
from pageloom.plans.listing_a import index_a
from pageloom.plans.listing_b import index_b


def item(body, extra=""):
    return (
        f'<article>{extra}<div class="media__image"><img src="i"></div>{body}'
        '<div class="media__date"><span d-time="1700000000">x</span></div></article>'
    )


LINK = '<h3 class="media__title"><a class="media__link" href="l">t</a></h3>'


def root(*items):
    return '<div id="indeks-container">' + "".join(items) + "</div>"


def rows(df):
    return [r.asDict(True) for r in df.orderBy(*[c for c in ("page_id", "pos") if c in df.columns]).collect()]


def test_listing_a_edges(trees_of):
    pages = [
        item(LINK),  # 0: no listing root
        root(item(LINK)),  # 1
        root(item(LINK).replace('class="media__image"', 'class="media__image big"')),  # 2: class token
        root(item(LINK).replace("1700000000", "17e8")),  # 3: bad number keeps the item
        root(item('<h3 class="media__title"><a class="media__link">no href</a></h3>')),  # 4
        root(item('<h3 class="media__title"><a href="l" class="media__link"><b>t</b></a></h3>')),  # 5: next node no text
        root("<article>" + item(LINK) + "</article>"),  # 6: nested article starts a new segment
        root(item('<h2 class="media__subtitle">one</h2><h2 class="media__subtitle">two</h2>' + LINK)),  # 7
        root(item('<h2 class="media__subtitle"></h2>' + LINK)),  # 8: h3 is read as the subtitle's text
        root(item(LINK).replace('d-time="1700000000"', "")),  # 9: never complete
        root(item('<h2 class="media__subtitle">s</h2>\n' + LINK), item(LINK)),  # 10
    ]
    got = {}
    for r in rows(index_a(trees_of(*pages))):
        got.setdefault(r["page_id"], []).append(r)
    assert sorted(got) == [1, 3, 5, 6, 7, 10]
    assert got[1][0] == {
        "page_id": 1, "pos": 0, "article_link": "l", "image_url": "i", "title": "t", "subtitle": None,
        "published_at": datetime(2023, 11, 14, 22, 13, 20),
    }
    assert got[3][0]["published_at"] is None and got[3][0]["article_link"] == "l"
    assert got[5][0]["title"] is None
    assert [r["pos"] for r in got[6]] == [1]
    assert got[7][0]["subtitle"] == "two"
    assert [r["subtitle"] for r in got[10]] == ["s", None]


def test_listing_b_edges(trees_of):
    inner = '<h4 class="articles--rows--item__title"><a href="l" title="a&nbsp;b">x</a></h4>'

    def page(*items):
        return '<article class="main">' + "".join(items) + "</article>"

    pages = [
        f'<div class="articles--rows--item">{inner}</div>',  # 0: no root
        page(f'<div class="articles--rows--item">{inner}</div>'),  # 1: any tag, missing parts
        page('<p data-type="Photo"></p>', f'<article class="articles--rows--item">{inner}</article>'),  # 2: no leak
        page('<article class="articles--rows--item"><time datetime="2024-01-01">x</time></article>'),  # 3: date only
        page(
            '<article class="articles--rows--item"><time datetime="2024-01-01T00:00:00.5Z">x</time>'
            '<article class="articles--rows--item"></article></article>'
        ),  # 4: nested item belongs to the outer one
        page('<article class="articles--rows--item x"></article>'),  # 5: class token
    ]
    got = rows(index_b(trees_of(*pages)))
    assert [(r["page_id"], r["type"], r["title"], r["link"]) for r in got] == [
        (1, None, "a b", "l"), (2, None, "a b", "l"), (3, None, None, None), (4, None, None, None),
    ]
    assert got[0]["thumbnail"] is None and got[2]["published_at"] is None
    assert got[3]["published_at"] == datetime(2024, 1, 1, 0, 0, 0, 500000)


def page_a(kind, body, head=""):
    return f'<html><head>{head}<meta name="articletype" content="{kind}"></head><body>{body}</body></html>'


def single(body):
    return page_a("singlepage", f'<div class="detail__body-text itp_bodycontent">{body}</div>')


def news(fields):
    return '<script type="application/ld+json">{"@type" : "NewsArticle", ' + fields + "}</script>"


def blocks(row):
    return [(b["type"], b["text"]) for b in row["contents"]]


def test_article_a_blocks(trees_of):
    pages = [
        single("<p> a <b>x &amp; y</b> & z</p><p></p><p id=q>no</p><p>c<p>d"),  # 0
        single("<h2>a <b>x</b></h2><h2></h2>"),  # 1: child text once
        single("<strong></strong><strong>A<i>B</i></strong><strong>C</strong><p><strong>D</strong></p>"),  # 2
        single('<p>a<a class="embed video20detik" href="v">x</a></p><p>a<b><a class="embed video20detik" href="v">x</a></b></p>'),
        single('<div class="pic_artikel_sisip"><img src="1" alt="a"><img src="2"><span> c </span><img src="3"></div>'),
        single('<div class="lihatjg">none</div><div class="lihatjg"><a href="r">H</a></div>'),
        single('<div class="pic_artikel_sisip"><p>inside a claimed block</p></div>'),
        page_a("other", '<div class="detail__body-text itp_bodycontent"><p>x</p></div>'),
        "",
    ]
    got = rows(article_a(trees_of(*pages)))
    par = "paragraph-text"
    assert blocks(got[0]) == [(par, ' a <b>x &amp; y</b> & z'), (par, "c"), (par, "d")]
    assert blocks(got[1]) == [("section-title", "a <b>x</b>"), ("section-title", None)]
    assert got[2]["published_from"] == "B" and blocks(got[2]) == [(par, "<strong>D</strong>")]
    assert [b["type"] for b in got[3]["contents"]] == ["video", par]
    assert got[3]["contents"][0]["video"]["embedded_url"] == "v"
    assert got[4]["contents"][0]["image"]["url"] == "2" and got[4]["contents"][0]["image"]["alt"] == "a"
    assert got[4]["contents"][0]["image"]["caption"] == " c "
    assert [b["ref"] for b in got[5]["contents"]] == [
        {"headline": None, "article_link": None}, {"headline": "H", "article_link": "r"},
    ]
    assert [b["type"] for b in got[6]["contents"]] == ["image"]
    assert got[7]["kind"] == "other" and got[7]["contents"] == []
    assert got[8]["kind"] is None and got[8]["contents"] == []


def test_json_keys_in_any_case(trees_of):
    pages = [
        news('"HeadLine" : "H", "datepublished": "2024-02-03T04:05:06Z", "IMAGE": {"ContentLocation": "Bali"}'),
        news('"headline": "H", "description": "he said \\"Headline\\": no", "Description2": "x"'),
        news('"headline": "exact", "HEADLINE": "other"'),  # twice: read as it stands
    ]
    got = rows(article_a(trees_of(*pages)))
    assert got[0]["headline"] == "H" and got[0]["published_at"] is not None
    assert got[1]["headline"] == "H" and got[1]["description"] == 'he said "Headline": no'
    assert got[2]["headline"] == "exact"


def test_article_a_metadata(trees_of):
    video = '"video": {"name": "n", "contentUrl": "c"}, "headline": "H"'
    pages = [
        news('"headline": "one"') + news('"headline": "two"'),  # 0: first wins
        '<script type="application/ld+json">{"@type": "WebPage", "headline": "w"}</script>' + news('"headline": "n"'),
        news('"headline": '),  # 2: broken
        page_a("video", '<meta name="duration" content="12"><div class="detail"><p>p</p></div>', news(video)),
        page_a("video", '<meta name="duration" content="1x"><div class="detail"></div>'),
        page_a("multiplefoto", '<p class="detail"></p>', news('"headline": "J", "image": {"contentLocation": "Bali"}')),
        page_a("multiplefoto", '<div class="detail"><div class="detail__header"><h1> T </h1></div></div>', news('"headline": "J"')),
        news('"datePublished": "2024-02-03T04:05:06+07:00", "dateModified": "2024-02-03"'),
        '<meta name="author" content="a"><meta name="author" content="b"><meta name="author">',
        # the main part of a later page kind hides what is inside it
        page_a("singlepage", '<div class="detail__body-text itp_bodycontent"><div id="bt_tkt"><article><a href="x"></a></article></div></div>'),
    ]
    got = rows(article_a(trees_of(*pages)))
    assert [got[i]["headline"] for i in (0, 1, 2)] == ["one", "n", None]
    clip = got[3]["contents"][0]["video"]
    assert (clip["title"], clip["url"], clip["duration"], clip["thumbnail"]) == ("n", "c", 12, None)
    assert blocks(got[3])[1] == ("paragraph-text", "p")
    assert got[4]["contents"][0]["video"] == dict.fromkeys(clip) and got[4]["duration"] is None
    assert got[5]["published_from"] == "Bali" and got[5]["headline"] == "J"
    assert got[6]["headline"] == "T"
    assert got[7]["published_at"] == datetime(2024, 2, 2, 21, 5, 6) and got[7]["updated_at"] is None
    assert got[8]["author"] == "b"
    assert got[9]["related"] == []


def test_article_a_photos(trees_of):
    def fig(img, cap=""):
        return f"<figure><img {img}><figcaption>{cap}</figcaption></figure>"

    slider = (
        fig('data-lazy="z" src="s"') + fig('src="s" data-lazy="z"') + fig('src="s" data-lazy=""')
        + fig('src="s"', " <div>a<div>b<i>c</i></div></div> ")
    )
    got = rows(article_a(trees_of(page_a("multiplefoto", f'<b class="detail"><i id="slider-foto__detail">{slider}</i></b>'))))
    images = [b["image"] for b in got[0]["contents"]]
    assert [i["url"] for i in images] == ["z", "z", "s", "s"]
    assert [i["caption"] for i in images] == [None, None, None, "ab<i>c</i>"]


TEXT = "articles show category-news immersive"


def page_b(blocks_html, body_class=TEXT, head="", wrap="article-content-body__item-page"):
    return (
        f'<html><head>{head}</head><body class="{body_class}"><article class="hentry main"><div class="read-page--content">'
        '<div class="article-content-body article-content-body_with-aside">'
        f'<div class="{wrap}">{blocks_html}</div></div></div></article></body></html>'
    )


def test_article_b_blocks(trees_of):
    image = (
        '<div class="article-content-body__item-media"><figure class="read-page--photo-gallery--item" data-image="i" '
        'data-title="t" data-description="&lt;p&gt;pop&nbsp;up&lt;/p&gt;"><img width="6" height="0"></figure></div>'
    )
    pages = [
        page_b("<p>a&nbsp;<b>c&nbsp;</b></p><p> </p><p>&nbsp;</p><p></p><p class=x>no</p><p>  </p>"),
        page_b('<h2 class="article-content-body__item-title">  T </h2><h2>no</h2>'),
        page_b('<div class="promo promo-below"><p>no</p></div><div class="promo other"><p>yes</p></div>'),
        page_b(image + '<div class="article-content-body__item-media"><p>no figure</p></div>'),
        page_b("<p>x</p>", wrap="article-content-body__item-page page-2"),
        page_b("<p>x</p>", wrap="my article-content-body__item-page"),
        page_b('<p>a</p><div class="article-content-body__item-page"><p>b</p></div>'),  # 6: no repeats
        page_b("<p>x</p>", body_class=TEXT + " more"),  # 7: kind unknown
        page_b("<p>x</p>", body_class="articles show category-photo immersive"),  # 8: photo has no main part
    ]
    got = rows(article_b(trees_of(*pages)))
    par = "paragraph-text"
    assert blocks(got[0]) == [(par, "a <b>c </b>"), (par, "  ")]
    assert blocks(got[1]) == [("section-title", "T")]
    assert blocks(got[2]) == [(par, "yes")]
    assert [b["image"] for b in got[3]["contents"]] == [
        {"url": "i", "title": None, "caption": "op u", "alt": "t", "width": 6, "height": None}
    ]
    assert blocks(got[4]) == [(par, "x")] and blocks(got[5]) == []
    assert blocks(got[6]) == [(par, "a"), (par, "b")]
    assert (got[7]["kind"], got[7]["contents"]) == (None, [])
    assert (got[8]["kind"], got[8]["contents"]) == ("Photo", [])


def test_article_b_metadata(trees_of):
    def card(json, more=""):
        return f'<script id="rich-card" type="application/ld+json"{more}>{json}</script>'

    pages = [
        "<title> a b </title>",
        "<title lang=x>no</title>",
        '<meta name="description" content="one"><b name="description" content="two"></b>',
        '<meta property="article:modified_time" content="2024-01-02T00:00:00Z">',
        '<meta property="article:published_time" content="2024-01-02T00:00:00Z">'
        '<meta property="article:published_time" content="2024-01-02">',
        card('[{"author": {"name": "a", "url": "u"}}, {"author": {"name": "b"}}, {"x": 1}, {"author": null}]'),
        card('{"author": {"name": "a"}}'),
        card('[{"author": {"name": "a"}}]') + card("[broken"),
        '<script id="rich-card">[{"author": {"name": "a"}}]</script>',
    ]
    got = rows(article_b(trees_of(*pages)))
    assert got[0]["headline"] == "a b" and got[1]["headline"] is None
    assert got[2]["description"] == "two"
    assert got[3]["updated_at"] == datetime(2024, 1, 2) and got[3]["published_at"] is None
    assert got[4]["published_at"] == datetime(2024, 1, 2)
    assert got[5]["author"] == {"name": "b", "profile_url": None}
    assert got[6]["author"] is None and got[8]["author"] is None
    assert got[7]["author"] == {"name": "a", "profile_url": None}


def test_article_b_kind_of_the_listing_wins(spark):
    from pyspark.sql import functions as F

    from pageloom.plans.trees import page_trees

    df = spark.createDataFrame(
        [(0, "u", page_b("<p>x</p>"), None), (1, "u", page_b("<p>x</p>"), "Video"), (2, "u", page_b("<p>x</p>"), "")],
        "page_id BIGINT, url STRING, html STRING, item_kind STRING",
    )
    got = rows(article_b(page_trees(df)).select("page_id", "kind", F.size("contents").alias("n")))
    assert [(r["kind"], r["n"]) for r in got] == [("Article", 1), ("Video", 0), ("Article", 1)]


@pytest.mark.parametrize("text, ok", [
    ("2024-01-01T00:00:00Z", True), ("2024-01-01T00:00:00+07:00", True), ("2024-01-01 00:00:00Z", False),
    ("2024-01-01T00:00:00", False), ("2024-13-01T00:00:00Z", False), ("2024-01-01", False), ("", False),
])
def test_rfc3339(spark, text, ok):
    from pageloom.functions.scalars import lit, rfc3339

    assert (spark.range(1).selectExpr(f"{rfc3339(lit(text))} AS x").first().x is not None) == ok


@pytest.mark.parametrize("text, value", [
    ("12", 12), ("+3", 3), ("-4", -4), ("", None), (" 1", None), ("1.0", None), ("1e3", None), ("99999999999", None),
])
def test_strict_int(spark, text, value):
    from pageloom.functions.scalars import lit, strict_int

    assert spark.range(1).selectExpr(f"{strict_int(lit(text))} AS x").first().x == value


def test_subtitle_right_after_a_subtitle_is_its_text(trees_of):
    sub = '<h2 class="media__subtitle">{}</h2>'
    pages = [sub.format("") + sub.format("two"), sub.format("one") + sub.format("two"),
             sub.format("") + sub.format("") + sub.format("three")]
    got = rows(index_a(trees_of(*[root(item(p + LINK)) for p in pages])))
    assert [r["subtitle"] for r in got] == [None, "two", "three"]
