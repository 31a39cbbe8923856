"""Expected results as DuckDB SQL over the test tables.

Each statement works from the columns of ``documents`` (or by pattern on the raw
``html`` of ``pages``); none of them parses a rendered page.
"""

from __future__ import annotations

from pageloom.fixed import CHANNELS

NL = "chr(10)"

# Documents with the same helper columns as the renderer.
DOC = """
doc AS (
  SELECT *, string_split(text, chr(10)) AS lines, string_split(text, chr(10))[1] AS title,
         coalesce(string_split(text, chr(10))[2], '') AS second,
         'https://news.detik.com/berita/d-' || doc_id AS link_a,
         'https://www.liputan6.com/news/read/' || doc_id AS link_b,
         1704067200 + doc_id * 60 AS epoch,
         CASE n_chars % 4 WHEN 2 THEN 'multiplefoto' WHEN 3 THEN 'video' ELSE 'singlepage' END AS kind_a,
         CASE WHEN n_chars % 3 = 0 THEN 'Photo' ELSE 'Article' END AS kind_b,
         n_chars % 10 < 8 AS has_json,
         doc_id // 20 AS page_id, doc_id % 20 AS pos
  FROM documents
),
line AS (
  SELECT * EXCLUDE (lines), unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i FROM doc
)"""

ITEMS_A = """
item_a AS (
  SELECT page_id, pos, link_a AS article_link, 'https://img.example/' || doc_id || '.jpg' AS image_url,
         nullif(title, '') AS title, CASE WHEN n_chars % 3 = 0 THEN lang || ' desk' END AS subtitle,
         CASE WHEN n_chars % 7 <> 0 THEN epoch END AS published_s
  FROM doc WHERE n_chars % 11 <> 0
)"""

ITEMS_B = r"""
item_b AS (
  SELECT page_id, pos, CASE n_chars % 3 WHEN 0 THEN 'Article' WHEN 1 THEN 'Photo' ELSE 'Video' END AS type,
         nullif(title, '') AS title, link_b AS link,
         CASE WHEN n_chars % 4 <> 0 THEN 'https://img.example/' || doc_id || '.png' END AS thumb_url,
         CASE WHEN n_chars % 4 <> 0 THEN 640 END AS thumb_w,
         CASE WHEN n_chars % 4 <> 0 AND n_chars % 5 <> 0 THEN 360 END AS thumb_h,
         CASE WHEN n_chars % 4 <> 0 THEN nullif(replace(title, ' ', chr(160)), '') END AS thumb_alt,
         trim(second || ' more', ' ' || chr(9)) AS summary,
         CASE WHEN n_chars % 7 <> 0 THEN epoch - 25200 END AS published_s
  FROM doc
)"""

LISTED = """
listed AS (
  SELECT 'Detik.com' AS source, article_link AS link, published_s FROM item_a
  UNION ALL SELECT 'Liputan6.com', link, published_s FROM item_b
)"""

KNOWN = """
known AS (
  SELECT 'https://news.detik.com/berita/d-' || doc_id AS link FROM labels
  UNION ALL SELECT 'https://www.liputan6.com/news/read/' || doc_id FROM labels
)"""

_NULLS = dict.fromkeys(
    "text img_url img_title img_caption img_alt img_w img_h vid_url vid_embed vid_title vid_desc "
    "vid_dur vid_thumb ref_headline ref_link".split(),
    "NULL",
)


def _blocks(kind: str, ord_: str, source: str, where: str, **members: str) -> str:
    cols = {**_NULLS, **members}
    casts = {"img_w": "INT", "img_h": "INT", "vid_dur": "BIGINT"}
    sel = ", ".join(f"CAST({v} AS {casts.get(k, 'VARCHAR')}) AS {k}" for k, v in cols.items())
    return (
        f"SELECT doc_id, {ord_} AS ord, '{kind}' AS type, {sel} FROM {source} WHERE {where}"
    )


_S = "kind_a = 'singlepage' AND i % 7 = "
_REF = "' <a href=\"https://x.example/' || i || '?a=1&amp;b=2\">ref &amp; more</a><br/>'"
_PAR, _SEC, _IMG, _VID, _LNK = (
    "paragraph-text", "section-title", "image", "video", "referenced-article-link",
)


def _json(x: str) -> str:
    return f"CASE WHEN has_json THEN nullif({x}, '') END"


BLOCKS_A = (
    "raw_a AS (\n"
    + "\nUNION ALL ".join(
        [
            _blocks(_PAR, "i", "line", _S + "0 AND line <> ''", text="line"),
            _blocks(_PAR, "i", "line", _S + "1", text=f"line || {_REF}"),
            _blocks(_SEC, "i", "line", _S + "2", text="line || ' <em>x</em>'"),
            _blocks(
                _IMG, "i", "line", _S + "3",
                img_url="'https://i.example/' || doc_id || '/' || i || '.jpg'",
                img_title="'t' || i", img_alt="nullif(line, '')", img_caption="line || ' Foto'",
            ),
            _blocks(
                _LNK, "i", "line", _S + "4",
                ref_headline="CASE WHEN line = '' THEN 'Baca ' ELSE line END",
                ref_link="'https://ref.example/' || doc_id || '/' || i",
            ),
            _blocks(
                _VID, "i", "line", _S + "5",
                vid_embed="'https://e.example/' || doc_id || '/' || i",
            ),
            _blocks(
                _PAR, "i", "line", "kind_a = 'multiplefoto' AND i % 2 = 0 AND line <> ''", text="line"
            ),
            _blocks(
                _IMG, "1000000 + i", "line", "kind_a = 'multiplefoto' AND i % 2 = 1",
                img_url="CASE WHEN i % 4 = 1 THEN 'https://lazy.example/' ELSE 'https://s.example/' END || i",
                img_title="lang", img_alt="nullif(line, '')",
                img_caption="trim(line || '<b> &amp; co</b>', ' ' || chr(9))",
            ),
            _blocks(
                _VID, "-1", "doc", "kind_a = 'video'",
                vid_url=_json("'https://v.example/' || doc_id"),
                vid_embed=_json("'https://e.example/' || doc_id"),
                vid_title=_json("title"), vid_desc=_json("second"), vid_dur="nullif(n_chars, 0)",
                vid_thumb=_json("'https://t.example/' || doc_id"),
            ),
            _blocks(_PAR, "i", "line", "kind_a = 'video' AND line <> ''", text="line"),
        ]
    )
    + "\n),\nblock_a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS pos FROM raw_a)"
)

_B = "kind_b = 'Article' AND i % 6 = "
BLOCKS_B = (
    "raw_b AS (\n"
    + "\nUNION ALL ".join(
        [
            _blocks(
                _IMG, "-1", "doc", "kind_b = 'Article' AND n_chars % 4 <> 0",
                img_url="'https://t.example/' || doc_id", img_caption="nullif(title, '')", img_w="640",
            ),
            _blocks(_PAR, "i", "line", _B + "0 AND line NOT IN ('', ' ')", text="line"),
            _blocks(_PAR, "i", "line", _B + "1", text="line || ' <b>x &lt; y</b>'"),
            _blocks(
                _SEC, "i", "line", _B + "2", text="nullif(trim(line, ' ' || chr(9)), '')"
            ),
            _blocks(
                _IMG, "i", "line", _B + "3",
                img_url="'https://i.example/' || doc_id || '/' || i", img_alt="nullif(line, '')",
                img_caption="nullif(trim('<p>' || line || '</p>', '<>p/'), '')", img_w="640",
                img_h="nullif(i, 0)",
            ),
            _blocks(
                _IMG, "i", "line", "kind_b = 'Photo'",
                img_url="'https://p.example/' || doc_id || '/' || i", img_title="lang",
                img_caption="nullif(line, '')", img_w="i + 1", img_h="480",
            ),
        ]
    )
    + "\n),\nblock_b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS pos FROM raw_b)"
)

# All members of a block as one text, for comparing whole records.
DIGEST = (
    "concat_ws('|', type, coalesce(text, ''), coalesce(img_url, ''), coalesce(img_title, ''), "
    "coalesce(img_caption, ''), coalesce(img_alt, ''), coalesce(img_w::VARCHAR, ''), "
    "coalesce(img_h::VARCHAR, ''), coalesce(vid_url, ''), coalesce(vid_embed, ''), "
    "coalesce(vid_title, ''), coalesce(vid_desc, ''), coalesce(vid_dur::VARCHAR, ''), "
    "coalesce(vid_thumb, ''), coalesce(ref_headline, ''), coalesce(ref_link, ''))"
)

RELATED_A = """
related_a AS (
  SELECT doc_id, 0::BIGINT AS pos, nullif(title, '') AS title, link_a || '/1' AS article_link FROM doc WHERE n_chars % 2 = 0
  UNION ALL SELECT doc_id, 1, NULL, link_a || '/2' FROM doc WHERE n_chars % 2 = 0
  UNION ALL SELECT doc_id, 2, NULL, link_a || '/3' FROM doc WHERE n_chars % 2 = 0
)"""
RELATED_B = """
related_b AS (
  SELECT doc_id, 0::BIGINT AS pos, nullif(title, '') AS title, link_b || '/1' AS article_link,
         'https://r.example/' || doc_id AS thumb_url, 100 AS thumb_w, 50 AS thumb_h
  FROM doc WHERE kind_b = 'Article' AND n_chars % 5 <> 1
)"""

ARTICLES_A = f"""
art_a AS (
  SELECT doc_id AS page_id, link_a AS link, kind_a AS kind,
         CASE WHEN kind_a = 'multiplefoto' AND trim(title, ' ' || chr(9)) <> '' THEN trim(title, ' ' || chr(9))
              ELSE {_json('title')} END AS headline,
         {_json('second')} AS description, source AS author,
         CASE kind_a WHEN 'multiplefoto' THEN CASE WHEN has_json THEN source || ' city' END
              WHEN 'singlepage' THEN CASE n_chars % 3 WHEN 1 THEN ', ' || source WHEN 2 THEN lang END END AS published_from,
         CASE WHEN has_json THEN epoch - 25200 END AS published_s,
         CASE WHEN has_json AND n_chars % 6 <> 0 THEN epoch END AS updated_s,
         CASE WHEN kind_a = 'video' THEN nullif(n_chars, 0) END AS duration,
         kind_a = 'singlepage' AND n_chars % 5 <> 0 AS has_figure, n_chars, title, source, doc_id
  FROM doc
)"""
ARTICLES_B = """
art_b AS (
  SELECT doc_id AS page_id, link_b AS link, kind_b AS kind,
         trim(title || ' - Berita', ' ' || chr(9)) AS headline, nullif(second, '') AS description,
         epoch - 25200 AS published_s, CASE WHEN n_chars % 6 <> 0 THEN epoch END AS updated_s,
         CASE WHEN n_chars % 7 < 5 THEN source END AS author_name,
         CASE WHEN n_chars % 7 < 5 THEN 'https://u.example/' || source END AS author_url, doc_id
  FROM doc
)"""


def _with(select: str, *ctes: str) -> str:
    return "WITH " + ",".join((DOC,) + ctes) + "\n" + select


def _member(block: str, kind: str, cols: str, more: str = "") -> str:
    where = f"b.type = '{kind}'" + (f" AND {more}" if more else "")
    return f"SELECT b.doc_id AS page_id, b.pos, {cols} FROM {block} b JOIN doc d ON d.doc_id = b.doc_id WHERE {where}"


def _record(site: str) -> str:
    cols = {
        "a": "a.page_id, a.link, a.kind, a.headline, a.description, a.author, a.published_from, a.published_s, a.updated_s",
        "b": "a.page_id, a.link, a.kind, a.headline, a.description, a.author_name, a.author_url, a.published_s, a.updated_s",
    }[site]
    return f"""
SELECT {cols}, coalesce(b.n, 0) AS n_contents, coalesce(b.digest, '') AS contents, coalesce(r.n, 0) AS n_related
FROM art_{site} a
LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg({DIGEST}, {NL} ORDER BY pos) AS digest FROM block_{site} GROUP BY doc_id) b
  ON b.doc_id = a.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM related_{site} GROUP BY doc_id) r ON r.doc_id = a.doc_id"""


_TITLE_RE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"

_H1_RE = "regexp_extract(html, '<h1>([^<]*)</h1>', 1)"


def unescape(x: str) -> str:
    """Decode references; these also count without the final semicolon."""
    for ref, plain in (
        ("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&"),
    ):
        x = f"regexp_replace({x}, '&{ref};?', '{plain}', 'g')"
    return x


_CHANNEL_ROWS = ", ".join(f"('{n}', '{u}', {i})" for i, (n, u) in enumerate(CHANNELS))
_STATUS = "CASE l.quality WHEN 0 THEN CASE l.toxic WHEN 1 THEN 404 ELSE 500 END ELSE 200 END"
_ALL_A = (BLOCKS_A, RELATED_A, ARTICLES_A)
_ALL_B = (BLOCKS_B, RELATED_B, ARTICLES_B)
_CANONICAL = f"""
SELECT sha256(link) AS id, 'Detik.com' AS source, link, kind, headline, published_s, author AS author_name, n_contents, n_related
FROM ({_record('a')})
UNION ALL
SELECT sha256(link), 'Liputan6.com', link, kind, headline, published_s, author_name, n_contents, n_related
FROM ({_record('b')})"""
_BLOCKS_BOTH = """
site_blocks AS (
  SELECT sha256(d.link_a) AS id, b.* FROM block_a b JOIN doc d ON d.doc_id = b.doc_id
  UNION ALL SELECT sha256(d.link_b), b.* FROM block_b b JOIN doc d ON d.doc_id = b.doc_id
)"""


def statements() -> dict[str, str]:
    listing = (ITEMS_A, ITEMS_B, LISTED)
    plain = "SELECT page_id, {0} FROM art_{1}"
    body_a = "SELECT b.doc_id AS page_id, b.pos, b.type FROM block_a b JOIN doc d ON d.doc_id = b.doc_id"
    out = {
        # sources
        "src_pages": "SELECT page_id, url, length(html) AS html_chars, md5(html) AS html_md5 FROM pages",
        "src_status_gate": f"""
SELECT d.doc_id AS page_id, src.source, src.status, coalesce(src.status = 200, false) AS accepted,
       CASE WHEN src.status = 200 THEN NULL
            WHEN src.source = 'Liputan6.com' THEN 'error requesting resource: got ' || coalesce(src.status, 0) || ' status code'
            WHEN src.status = 404 THEN 'news not found' ELSE 'error fetching news items: ' || d.text END AS reason
FROM documents d JOIN (
  SELECT p.doc_id, site.source, CASE WHEN l.doc_id IS NOT NULL THEN {_STATUS} END AS status
  FROM documents p CROSS JOIN (VALUES ('Detik.com'), ('Liputan6.com')) site(source)
  LEFT JOIN labels l ON l.doc_id = p.doc_id) src ON src.doc_id = d.doc_id""",
        "src_channels": f"""
SELECT c.name, c.base_url, count(*) AS n_documents, sum(d.n_chars)::BIGINT AS n_chars
FROM documents d JOIN (VALUES {_CHANNEL_ROWS}) c(name, base_url, k) ON c.k = d.n_chars % 22 GROUP BY ALL""",
        "src_known_links": _with("SELECT link FROM known", KNOWN),
        "snk_articles": _with(_CANONICAL, *_ALL_A, *_ALL_B),
        # tree
        "htm_match": "SELECT page_id, len(regexp_extract_all(html, '<div class=\"ad\">'))::BIGINT AS n_ads FROM pages",
        "htm_find_first": f"SELECT page_id, url, {unescape(_TITLE_RE)} AS title, "
        "regexp_extract(html, '<a href=\"([^\"]*)\"', 1) AS first_link FROM pages",
        "htm_find_all": """
SELECT page_id, k::BIGINT AS k, href FROM (
  SELECT page_id, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS k
  FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages))""",
        "htm_nodes": """
SELECT page_id, len(regexp_extract_all(html, '<p>'))::BIGINT AS n_p, len(regexp_extract_all(html, '<a '))::BIGINT AS n_a,
       len(regexp_extract_all(html, '<li>'))::BIGINT AS n_li, len(regexp_extract_all(html, '<!--'))::BIGINT AS n_comments,
       len(regexp_extract_all(html, '<b>'))::BIGINT AS n_b FROM pages""",
        "htm_text": f"SELECT page_id, {unescape(_H1_RE)} AS heading FROM pages",
        "htm_attr": "SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages",
        "htm_walk_until": """
SELECT page_id, len(regexp_extract_all(split_part(html, '<h1>', 1), '<a href='))::BIGINT AS links_before_h1 FROM pages""",
        "htm_outermost": _with(
            "SELECT page_id, count(*)::BIGINT AS n_items FROM doc GROUP BY page_id"
        ),
        "htm_outermost_rows": _with(
            "SELECT page_id, count(*)::BIGINT AS n_items FROM doc GROUP BY page_id"
        ),
        "htm_subtree_rows": _with(
            """SELECT page_id, (count(*) + count(*) FILTER (WHERE n_chars % 4 <> 0))::BIGINT AS n_links,
       (count(*) + count(*) FILTER (WHERE n_chars % 9 = 0))::BIGINT AS n_articles,
       (count(*) + 2 * count(*) FILTER (WHERE n_chars % 9 = 0))::BIGINT AS n_pairs FROM doc GROUP BY page_id"""
        ),
        "htm_outermost_until": _with(
            """SELECT page_id, count(*)::BIGINT AS n_items FROM (SELECT page_id, coalesce(sum(CASE WHEN n_chars % 3 = 2 THEN 1 ELSE 0 END)
       OVER (PARTITION BY page_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS videos FROM doc)
WHERE videos = 0 GROUP BY page_id"""
        ),
        "htm_rule_dispatch": _with(
            """SELECT page_id, 'page' AS level, unnest(range(len(rules))) AS at, unnest(rules) AS rule FROM (
  SELECT doc_id AS page_id, ['title', 'description', 'published', 'updated'] || CASE WHEN n_chars % 7 = 6 THEN [] ELSE ['author'] END
    || CASE WHEN kind_b = 'Photo' THEN ['slider'] ELSE ['main'] END AS rules FROM doc)
UNION ALL SELECT page_id, 'block', row_number() OVER (PARTITION BY page_id ORDER BY i, k) - 1, rule FROM (
  SELECT doc_id AS page_id, -1 AS i, 'top' AS rule, 1 AS k FROM doc WHERE kind_b = 'Article' AND n_chars % 8 <> 4
  UNION ALL SELECT doc_id, i, 'slide', 1 FROM line WHERE kind_b = 'Photo'
  UNION ALL SELECT doc_id, i, unnest(rules), generate_subscripts(rules, 1) FROM (
    SELECT doc_id, i, CASE i % 6 WHEN 2 THEN ['section'] WHEN 3 THEN ['image'] WHEN 4 THEN ['skip']
      WHEN 5 THEN ['skip', 'skip', 'image'] ELSE ['paragraph'] END AS rules
    FROM line WHERE kind_b = 'Article'))"""
        ),
        "htm_subtree": _with(
            """SELECT d.doc_id AS page_id, count(i) FILTER (WHERE i % 6 IN (0, 1, 4, 5))::BIGINT AS n_paragraphs
FROM doc d LEFT JOIN line l ON l.doc_id = d.doc_id AND l.kind_b = 'Article' GROUP BY d.doc_id"""
        ),
        "htm_outer_html": _with(
            f"SELECT doc_id AS page_id, i::BIGINT AS line, '<a href=\"https://x.example/' || i || '?a=1&amp;b=2\">ref &amp; more</a>' AS html "
            "FROM line WHERE kind_a = 'singlepage' AND i % 7 = 1"
        ),
        # listings
        "idx_detik": _with("SELECT * FROM item_a", ITEMS_A),
        "idx_liputan6": _with("SELECT * FROM item_b", ITEMS_B),
        # articles, site A
        "dtk_kind": _with(plain.format("kind", "a"), ARTICLES_A),
        "dtk_author": _with(plain.format("author", "a"), ARTICLES_A),
        "dtk_duration": _with(plain.format("duration", "a"), ARTICLES_A),
        "dtk_jsonld": _with(plain.format("description, published_s, updated_s", "a"), ARTICLES_A),
        "dtk_headline_image": _with(
            """SELECT page_id, 'https://h.example/' || doc_id || '.jpg' AS url, source AS title, nullif(title, '') AS alt,
       trim(title || ' Foto', ' ' || chr(9)) AS caption FROM art_a WHERE has_figure""",
            ARTICLES_A,
        ),
        "dtk_main": _with(body_a + " WHERE d.kind_a = 'singlepage'", BLOCKS_A),
        "dtk_published_from": _with(plain.format("published_from", "a"), ARTICLES_A),
        "dtk_paragraph": _with(_member("block_a", _PAR, "b.text"), BLOCKS_A),
        "dtk_embedded_video": _with(
            _member("block_a", _VID, "b.vid_embed AS embedded_url", "b.ord >= 0"), BLOCKS_A
        ),
        "dtk_section": _with(_member("block_a", _SEC, "b.text"), BLOCKS_A),
        "dtk_reference": _with(
            _member("block_a", _LNK, "b.ref_headline AS headline, b.ref_link AS article_link"), BLOCKS_A
        ),
        "dtk_image": _with(
            _member(
                "block_a", _IMG, "b.img_url AS url, b.img_alt AS alt, b.img_title AS title, b.img_caption AS caption",
                "d.kind_a = 'singlepage'",
            ),
            BLOCKS_A,
        ),
        "dtk_photo": _with(body_a + " WHERE d.kind_a = 'multiplefoto'", BLOCKS_A),
        "dtk_photo_headline": _with(
            "SELECT page_id, headline FROM art_a WHERE kind = 'multiplefoto'", ARTICLES_A
        ),
        "dtk_photo_slider": _with(
            _member(
                "block_a", _IMG, "b.img_url AS url, b.img_alt AS alt, b.img_title AS title, b.img_caption AS caption",
                "d.kind_a = 'multiplefoto'",
            ),
            BLOCKS_A,
        ),
        "dtk_video": _with(
            """SELECT b.doc_id AS page_id, b.pos, b.type, b.text, b.vid_url AS url, b.vid_embed AS embedded_url, b.vid_title AS title,
       b.vid_desc AS description, b.vid_dur AS duration, b.vid_thumb AS thumbnail
FROM block_a b JOIN doc d ON d.doc_id = b.doc_id WHERE d.kind_a = 'video'""",
            BLOCKS_A,
        ),
        "dtk_related": _with("SELECT doc_id AS page_id, pos, title, article_link FROM related_a", RELATED_A),
        "dtk_article": _with(_record("a"), *_ALL_A),
        # articles, site B
        "lpt_headline": _with(plain.format("headline", "b"), ARTICLES_B),
        "lpt_description": _with(plain.format("description", "b"), ARTICLES_B),
        "lpt_published_at": _with(plain.format("published_s", "b"), ARTICLES_B),
        "lpt_updated_at": _with(plain.format("updated_s", "b"), ARTICLES_B),
        "lpt_kind": _with(plain.format("kind", "b"), ARTICLES_B),
        "lpt_author": _with(plain.format("author_name, author_url", "b"), ARTICLES_B),
        "lpt_main": _with(
            "SELECT doc_id AS page_id, unnest(CASE WHEN n_chars % 5 = 1 THEN ['content'] ELSE ['related', 'content'] END) AS part "
            "FROM doc WHERE kind_b = 'Article'"
        ),
        "lpt_content": _with(
            "SELECT doc_id AS page_id, unnest(CASE WHEN n_chars % 8 = 4 THEN ['body'] ELSE ['top', 'body'] END) AS part "
            "FROM doc WHERE kind_b = 'Article'"
        ),
        "lpt_top_image": _with(
            _member("block_b", _IMG, "b.img_url AS url, b.img_caption AS caption, b.img_w AS width, b.img_h AS height", "b.ord < 0"),
            BLOCKS_B,
        ),
        "lpt_body": _with(
            "SELECT d.doc_id AS page_id, count(b.doc_id)::BIGINT AS n_blocks FROM doc d "
            "LEFT JOIN block_b b ON d.doc_id = b.doc_id AND b.ord >= 0 WHERE d.kind_b = 'Article' GROUP BY d.doc_id",
            BLOCKS_B,
        ),
        "lpt_page_item": _with(
            """SELECT doc_id AS page_id, count(*) FILTER (WHERE i % 6 < 5)::BIGINT + 2 * count(*) FILTER (WHERE i % 6 = 5)::BIGINT
       + count(*) FILTER (WHERE i % 6 = 5)::BIGINT AS n_claimed FROM line WHERE kind_b = 'Article' GROUP BY doc_id"""
        ),
        "lpt_skip_ads": _with(
            """SELECT doc_id AS page_id, (count(*) FILTER (WHERE i % 6 = 4) + 2 * count(*) FILTER (WHERE i % 6 = 5))::BIGINT AS n_skipped
FROM line WHERE kind_b = 'Article' GROUP BY doc_id"""
        ),
        "lpt_image": _with(
            _member(
                "block_b", _IMG,
                "b.img_url AS url, b.img_alt AS alt, b.img_caption AS caption, b.img_w AS width, b.img_h AS height",
                "d.kind_b = 'Article' AND b.ord >= 0",
            ),
            BLOCKS_B,
        ),
        "lpt_section": _with(_member("block_b", _SEC, "b.text"), BLOCKS_B),
        "lpt_paragraph": _with(_member("block_b", _PAR, "b.text"), BLOCKS_B),
        "lpt_related": _with(
            "SELECT doc_id AS page_id, pos, title, article_link, thumb_url, thumb_w, thumb_h FROM related_b", RELATED_B
        ),
        "lpt_photo_slider": _with(
            _member(
                "block_b", _IMG,
                "b.img_url AS url, b.img_title AS title, b.img_caption AS caption, b.img_w AS width, b.img_h AS height",
                "d.kind_b = 'Photo'",
            ),
            BLOCKS_B,
        ),
        "lpt_article": _with(_record("b"), *_ALL_B),
        # relational
        "rel_index_union": _with("SELECT * FROM listed", *listing),
        "rel_new_links": _with("SELECT * FROM listed WHERE link NOT IN (SELECT link FROM known)", *listing, KNOWN),
        "rel_frontier_sort": _with(
            "SELECT source, link, published_s, row_number() OVER (ORDER BY published_s DESC NULLS LAST, link, source) AS place FROM listed",
            *listing,
        ),
        "rel_frontier_take": _with(
            """SELECT source, link, published_s, CASE WHEN row_number() OVER (ORDER BY published_s DESC NULLS LAST, link, source) <= 100
       THEN 'next' ELSE 'rest' END AS state FROM listed WHERE link NOT IN (SELECT link FROM known)""",
            *listing, KNOWN,
        ),
        "rel_new_links_store": _with("SELECT * FROM listed WHERE link NOT IN (SELECT link FROM known)", *listing, KNOWN),
        "rel_queue_rounds": _with(
            """SELECT source, link, published_s, 1 AS taken FROM first UNION ALL SELECT source, link, published_s, 2 FROM second
UNION ALL SELECT source, link, published_s, 3 FROM third
UNION ALL SELECT source, link, published_s, 0 FROM turns WHERE (source, link) NOT IN (
  SELECT (source, link) FROM first UNION ALL SELECT (source, link) FROM second UNION ALL SELECT (source, link) FROM third)""",
            *listing,
            "turns AS (SELECT *, coalesce(published_s // 60 % 3, 0) AS turn FROM listed)",
            "first AS (SELECT * FROM turns WHERE turn = 0 ORDER BY published_s DESC NULLS LAST, link, source LIMIT 100)",
            "second AS (SELECT * FROM turns WHERE turn <= 1 AND (source, link) NOT IN (SELECT (source, link) FROM first) "
            "ORDER BY published_s DESC NULLS LAST, link, source LIMIT 100)",
            "third AS (SELECT * FROM turns WHERE (source, link) NOT IN (SELECT (source, link) FROM first "
            "UNION ALL SELECT (source, link) FROM second) ORDER BY published_s DESC NULLS LAST, link, source LIMIT 100)",
        ),
        "rel_hydrate": _with(
            """SELECT doc_id AS page_id, link_b AS link, CASE n_chars % 3 WHEN 0 THEN 'Article' WHEN 1 THEN 'Photo' ELSE 'Video' END AS kind,
       trim(title || ' - Berita', ' ' || chr(9)) AS headline FROM doc"""
        ),
        "rel_canonical": _with(_CANONICAL, *_ALL_A, *_ALL_B),
        "rel_contents": _with(
            f"SELECT id, pos, {DIGEST} AS block FROM site_blocks "
            "UNION ALL SELECT sha256(link_a), NULL, NULL FROM doc WHERE doc_id NOT IN (SELECT doc_id FROM block_a) "
            "UNION ALL SELECT sha256(link_b), NULL, NULL FROM doc WHERE doc_id NOT IN (SELECT doc_id FROM block_b)",
            BLOCKS_A, BLOCKS_B, _BLOCKS_BOTH,
        ),
        "rel_typed_block": _with(
            """SELECT id, pos, type, text, img_url, img_title, img_caption, img_alt, img_w, img_h,
       vid_url, vid_embed, vid_title, ref_headline, ref_link FROM site_blocks""",
            BLOCKS_A, BLOCKS_B, _BLOCKS_BOTH,
        ),
        "rel_block_json": _with(
            """SELECT id, pos, type, coalesce(text, ref_headline, img_url, vid_url, vid_embed) AS first_value,
       ref_link AS article_link, img_w AS width FROM site_blocks""",
            BLOCKS_A, BLOCKS_B, _BLOCKS_BOTH,
        ),
        "rel_block_store": _with(
            "SELECT id, pos, type, ref_link AS article_link, ref_headline AS headline FROM site_blocks",
            BLOCKS_A, BLOCKS_B, _BLOCKS_BOTH,
        ),
        "rel_related": _with(
            """SELECT sha256(d.link_a) AS id, r.pos, r.title, r.article_link, NULL::VARCHAR AS thumb_url FROM related_a r JOIN doc d ON d.doc_id = r.doc_id
UNION ALL SELECT sha256(d.link_b), r.pos, r.title, r.article_link, r.thumb_url FROM related_b r JOIN doc d ON d.doc_id = r.doc_id""",
            RELATED_A, RELATED_B,
        ),
        # streaming
        "str_poll": _with("SELECT source, link, max(published_s) AS published_s FROM listed GROUP BY ALL", *listing),
        "str_dedup": "SELECT DISTINCT 'Detik.com' AS source, 'https://news.detik.com/berita/d-' || user_id AS link FROM events",
        "str_sightings": """
WITH shown AS (SELECT 'https://news.detik.com/berita/d-' || user_id AS link, epoch_us(ts) // 1000 AS ms, event_id % 3 = 0 AS last FROM events),
mark AS (SELECT max(ms) - 86400000 AS low FROM shown WHERE NOT last),
before AS (SELECT link, min(ms) AS ms FROM shown WHERE NOT last GROUP BY link)
SELECT link, ms AS seen_ms, false AS late FROM before
UNION ALL SELECT link, ms, true FROM shown, mark WHERE last AND ms < low
UNION ALL SELECT link, min(ms), false FROM shown, mark WHERE last AND ms >= low AND link NOT IN (SELECT link FROM before) GROUP BY link""",
        "str_without_stored": """
SELECT event_id, 'https://news.detik.com/berita/d-' || user_id AS link FROM events
WHERE user_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""",
    }
    return {name: sql.strip() for name, sql in out.items()}
