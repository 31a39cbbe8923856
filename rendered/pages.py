"""Documents -> pages, by SQL expressions (JVM-side).

Parts that a real page may lack come and go with ``n_chars``; whole texts are
rendered, one block per line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.functions.scalars import replaced
from pageloom.sources.pages import spread

PER_PAGE = 20


def _esc(x: str) -> str:
    return replaced(x, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")])


def _iso(zone: str) -> str:
    """Minute ``doc_id`` after 2024-01-01 as RFC 3339, by plain arithmetic."""
    return (
        "concat(CAST(date_add(DATE'2024-01-01', CAST(doc_id div 1440 AS INT)) AS STRING), 'T', "
        "lpad(CAST((doc_id % 1440) div 60 AS STRING), 2, '0'), ':', "
        f"lpad(CAST(doc_id % 60 AS STRING), 2, '0'), ':00{zone}')"
    )


LINK_A = "concat('https://news.detik.com/berita/d-', doc_id)"
LINK_B = "concat('https://www.liputan6.com/news/read/', doc_id)"


def documents(spark, sf_dir: str, key: str = "doc_id") -> DataFrame:
    """Documents with the columns the templates use, spread by the key they are
    rendered by: ``doc_id`` for articles, ``page_id`` for listings."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn(
        "page_id", F.expr(f"doc_id div {PER_PAGE}")
    )
    return (
        spread(docs, key)
        .select("doc_id", "page_id", "lang", "source", "n_chars", F.split("text", "\n").alias("lines"))
        .selectExpr(
            "*",
            "get(lines, 0) AS title",
            "coalesce(get(lines, 1), '') AS second",
            f"{LINK_A} AS link_a",
            f"{LINK_B} AS link_b",
        )
    )


def _cat(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def _html(template: str, **values: str) -> str:
    """SQL concat of a template; ``{name}`` is replaced by the SQL in values."""
    out, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if head:
            out.append("'" + head.replace("'", "\\'") + "'")
        out.append(f"CAST({values.get(name, name)} AS STRING)")
    if rest:
        out.append("'" + rest.replace("'", "\\'") + "'")
    return _cat(*out)


def _per_line(*arms: str) -> str:
    """Block HTML of each line, chosen by line number modulo the arm count."""
    whens = " ".join(f"WHEN {i} THEN {arm}" for i, arm in enumerate(arms))
    return f"array_join(transform(lines, (line, i) -> CASE i % {len(arms)} {whens} END), '\\n')"


# -- listings ---------------------------------------------------------------------

ITEM_A = _html(
    '<article class="list-content__item"><div class="media"><div class="media__image"><span><a href="{link_a}">'
    '<img src="https://img.example/{doc_id}.jpg" alt=""></a></span></div><div class="media__text">{sub}'
    '<h3 class="media__title">{anchor}</h3>{date}</div></div></article>\n',
    sub="if(n_chars % 3 = 0, concat('<h2 class=\"media__subtitle\">', lang, ' desk</h2>\\n'), '')",
    anchor="if(n_chars % 2 = 0, "
    + _html('<a class="media__link" href="{link_a}">{t}</a>', t=_esc("title"))
    + ", "
    + _html('<a href="{link_a}" class="media__link">{t}</a>', t=_esc("title"))
    + ")",
    date="CASE WHEN n_chars % 11 = 0 THEN '' WHEN n_chars % 7 = 0 THEN "
    "'<div class=\"media__date\"><span d-time=\"soon\">x</span></div>' ELSE "
    "concat('<div class=\"media__date\"><span class=\"i\"></span><span d-time=\"', 1704067200 + doc_id * 60, "
    "'\">x</span></div>') END",
)

ITEM_B = _html(
    '<article class="articles--rows--item" data-type="{kind}">{thumb}<aside><header>'
    '<h4 class="articles--rows--item__title"><a href="{link_b}" title="{t}">x</a></h4>'
    '<span><time datetime="{time}">x</time></span></header>'
    '<div class="articles--rows--item__summary"> \n{s} <i>more</i> </div></aside>{nested}</article>\n',
    kind="elt(CAST(n_chars % 3 AS INT) + 1, 'Article', 'Photo', 'Video')",
    thumb="if(n_chars % 4 = 0, '', "
    + _html(
        '<figure class="articles--rows--item__figure-thumbnail"><a href="#"><img src="https://img.example/{doc_id}.png"'
        ' width="640" height="{h}" alt="{t}"></a></figure>',
        h="if(n_chars % 5 = 0, 'auto', '360')",
        t=f"replace({_esc('title')}, ' ', '&nbsp;')",
    )
    + ")",
    t=f"replace({_esc('title')}, ' ', '&nbsp;')",
    time=f"if(n_chars % 7 = 0, '2024-01-01', {_iso('+07:00')})",
    s=_esc("second"),
    # an item within an item, which does not count
    nested="if(n_chars % 9 = 0, '<div><article class=\"articles--rows--item\"></article></div>', '')",
)


def _listing(docs: DataFrame, item: str, head: str, tail: str, url: str) -> DataFrame:
    """Twenty consecutive documents per page (the page size bounds each group)."""
    return (
        docs.selectExpr("page_id", "doc_id", f"{item} AS item")
        .groupBy("page_id")
        .agg(F.array_sort(F.collect_list(F.struct("doc_id", "item"))).alias("items"))
        .select(
            "page_id",
            F.concat(F.lit(url), F.col("page_id").cast("string")).alias("url"),
            F.concat(F.lit(head), F.array_join(F.col("items.item"), ""), F.lit(tail)).alias("html"),
        )
    )


def listing_a(docs: DataFrame) -> DataFrame:
    return _listing(
        docs, ITEM_A,
        "<!DOCTYPE html><html><head><title>Indeks</title></head><body><article>not listed</article>"
        '<div id="indeks-container"><div class="grid-row">\n',
        "</div></div><article>footer</article></body></html>",
        "https://news.detik.com/indeks?page=",
    )


def listing_b(docs: DataFrame) -> DataFrame:
    return _listing(
        docs, ITEM_B,
        '<!DOCTYPE html><html><body><article class="main"><div class="articles--rows">\n',
        "</div></article></body></html>",
        "https://www.liputan6.com/indeks?page=",
    )


# -- articles, site A -----------------------------------------------------------------

KIND_A = "elt(CAST(n_chars % 4 AS INT) + 1, 'singlepage', 'singlepage', 'multiplefoto', 'video')"

_JSON_A = (
    "CASE n_chars % 10 WHEN 9 THEN '' "
    "WHEN 8 THEN '<script type=\"application/ld+json\">{\"@type\": \"NewsArticle\", broken</script>' ELSE "
    "concat('<script type=\"application/ld+json\">', replace(to_json(named_struct('@type', 'NewsArticle', "
    "'headline', title, 'description', second, "
    f"'datePublished', {_iso('+07:00')}, 'dateModified', if(n_chars % 6 = 0, 'yesterday', {_iso('.250Z')}), "
    "'image', named_struct('url', 'x', 'contentLocation', concat(source, ' city')), "
    "'video', named_struct('name', title, 'description', second, 'thumbnailUrl', concat('https://t.example/', doc_id), "
    "'contentUrl', concat('https://v.example/', doc_id), 'embedUrl', concat('https://e.example/', doc_id)))), "
    "'<', '\\\\u003c'), '</script>') END"
)

_LINES_SINGLE = _per_line(
    _html("<p>{l}</p>", l=_esc("line")),
    _html('<p>{l} <a href="https://x.example/{i}?a=1&amp;b=2">ref &amp; more</a><br></p>', l=_esc("line")),
    _html("<h2>{l} <em>x</em></h2>", l=_esc("line")),
    _html(
        '<div class="pic_artikel_sisip"><div class="pic"><img src="https://i.example/{doc_id}/{i}.jpg" alt="{l}" title="t{i}">'
        '<span>{l} <i>Foto</i></span><img src="late.jpg"></div></div>',
        l=_esc("line"),
    ),
    _html(
        '<div class="lihatjg"><a href="https://ref.example/{doc_id}/{i}">Baca <b>{l}</b></a><a href="#">x</a></div>',
        l=_esc("line"),
    ),
    _html(
        '<p>{l}<a href="#">y</a><a class="embed video20detik" href="https://e.example/{doc_id}/{i}">video</a></p>',
        l=_esc("line"),
    ),
    _html('<p class="ad">{l}</p><!-- {i} -->', l=_esc("line")),
)

_SINGLE = _html(
    '{figure}<div class="detail__body-text itp_bodycontent">{strong} - {lines}</div>',
    figure="if(n_chars % 5 = 0, '', "
    + _html(
        '<figure class="detail__media-image"><img src="https://h.example/{doc_id}.jpg" alt="{t}" title="{source}">'
        "<figcaption> {t} <b>Foto</b> </figcaption></figure>",
        t=_esc("title"),
    )
    + ")",
    strong="CASE n_chars % 3 WHEN 0 THEN '' WHEN 1 THEN "
    + _html("<strong>{lang}<i>, {source}</i></strong><strong>later</strong>")
    + " ELSE concat('<strong></strong><strong>', lang, '</strong>') END",
    lines=_LINES_SINGLE,
)

_PHOTO = _html(
    '<article class="detail"><div class="detail__header"><h1> {t} </h1><h1>no</h1></div>{paras}'
    '<div id="slider-foto__detail"><div>{figures}</div></div></article>',
    t=_esc("title"),
    paras="array_join(transform(filter(lines, (line, i) -> i % 2 = 0), line -> "
    + _html("<p>{l}</p>", l=_esc("line"))
    + "), '')",
    figures="array_join(transform(filter(transform(lines, (line, i) -> named_struct('line', line, 'i', i)), "
    "s -> s.i % 2 = 1), s -> "
    + _html(
        '<figure><img src="https://s.example/{s.i}" data-lazy="{lazy}" alt="{l}" title="{lang}">'
        "<figcaption><div>{l}<b> &amp; co</b></div> </figcaption></figure>",
        lazy="if(s.i % 4 = 1, concat('https://lazy.example/', s.i), '')",
        l=_esc("s.line"),
    )
    + "), '')",
)

_VIDEO = _html(
    '<div class="detail">{paras}</div>',
    paras="array_join(transform(lines, line -> " + _html("<p>{l}</p>", l=_esc("line")) + "), '')",
)

ARTICLE_A = _html(
    '<!DOCTYPE html><html><head><meta charset="utf-8"><title>{t}</title><meta name="articletype" content="{kind}">'
    '<meta name="author" content="{source}"><meta name="duration" content="{n_chars}">'
    '<script type="application/ld+json">{web}</script>{json}</head>\n<body class="x">{body}{related}</body></html>',
    t=_esc("title"),
    kind=KIND_A,
    web="""'{"@type":"WebPage","headline":"no"}'""",
    json=_JSON_A,
    body=f"CASE {KIND_A} WHEN 'singlepage' THEN {_SINGLE} WHEN 'multiplefoto' THEN {_PHOTO} ELSE {_VIDEO} END",
    related="if(n_chars % 2 = 0, "
    + _html(
        '<div id="bt_tkt"><article><a dtr-ttl="{t}" href="{link_a}/1">x</a><a href="{link_a}/2">y</a></article>'
        '<div><article><a dtr-ttl="" href="{link_a}/3">z</a></article></div><a href="#">no</a></div>',
        t=_esc("title"),
    )
    + ", '')",
)


def articles_a(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("doc_id AS page_id", "link_a AS url", f"{ARTICLE_A} AS html")


# -- articles, site B ---------------------------------------------------------------------

_LINES_B = _per_line(
    _html("<p>{l}</p>", l=_esc("line")),
    _html("<p>{l}&nbsp;<b>x &lt; y</b></p>", l=_esc("line")),
    _html('<h2 class="article-content-body__item-title"> {l}\n</h2>', l=_esc("line")),
    _html(
        '<div class="article-content-body__item-media"><figure class="read-page--photo-gallery--item" '
        'data-image="https://i.example/{doc_id}/{i}" data-title="{l}" data-description="&lt;p&gt;{l}&lt;/p&gt;">'
        '<img width="640" height="{i}"></figure></div>',
        l=_esc("line"),
    ),
    _html('<div class="promo promo-above"><p>{l}</p></div>', l=_esc("line")),
    _html('<h2>{l}</h2><p class="x">{l}</p><div class="article-content-body__item-media">none</div>', l=_esc("line")),
)

_TEXT_B = _html(
    '<body class="articles show category-news immersive"><article class="hentry main">{related}'
    '<div class="read-page--content">{top}'
    '<div class="article-content-body article-content-body_with-aside">'
    '<div class="article-content-body__item-page page-1">{lines}</div></div></div><p>outside</p></article></body>',
    related="if(n_chars % 5 = 1, '', "
    + _html(
        '<div id="related-news"><div class="relateds-slow--lattice--item" data-title="{t}"><figure><a href="{link_b}/1">'
        '<img data-src="https://r.example/{doc_id}" width="100" height="50"></a></figure></div>'
        '<div class="relateds-slow--lattice--item" data-title="no figure"></div></div>',
        t=_esc("title"),
    )
    + ")",
    top="CASE WHEN n_chars % 8 = 4 THEN '' WHEN n_chars % 8 = 0 THEN '<div class=\"read-page--top-media\"></div>' ELSE "
    + _html(
        '<div class="read-page--top-media"><figure class="read-page--photo-gallery--item">'
        '<a class="read-page--photo-gallery--item__link" href="#">'
        '<img data-src="https://t.example/{doc_id}" width="640" height="abc" alt="{t}"></a></figure></div>',
        t=_esc("title"),
    )
    + " END",
    lines=_LINES_B,
)

_PHOTO_B = _html(
    '<body class="articles show category-photo immersive">'
    '<div class="read-page--photo-tag--slider__top js-top-slider">{figures}</div></body>',
    figures="array_join(transform(lines, (line, i) -> "
    + _html(
        '<figure data-image="https://p.example/{doc_id}/{i}" data-description="{l}" data-title="{lang}">'
        '<a><img width="{w}" height="480"></a></figure>',
        l=_esc("line"),
        w="i + 1",
    )
    + "), '')",
)

ARTICLE_B = _html(
    '<!DOCTYPE html><html><head><title> {t}&nbsp;- Berita </title><meta name="description" content="{s}">'
    '<meta property="article:published_time" content="{published}">'
    '<meta property="article:modified_time" content="{updated}">{card}</head>{body}</html>',
    t=_esc("title"),
    s=_esc("second"),
    published=_iso("+07:00"),
    updated=f"if(n_chars % 6 = 0, '2024-01-01', {_iso('Z')})",
    card="CASE n_chars % 7 WHEN 6 THEN '' ELSE "
    "concat('<script id=\"rich-card\" type=\"application/ld+json\">', if(n_chars % 7 = 5, '[', ''), "
    "'[{\"@type\":\"x\"},{\"author\":{\"name\":\"', source, '\",\"url\":\"https://u.example/', source, '\"}},{\"author\":null}]', "
    "'</script>') END",
    body=f"if(n_chars % 3 = 0, {_PHOTO_B}, {_TEXT_B})",
)


def articles_b(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("doc_id AS page_id", "link_b AS url", f"{ARTICLE_B} AS html")


