"""Explicit schemas as DDL; nothing in the engine is inferred."""

# Raw page snapshot.  ``status`` and ``fetched_at`` may be missing in a source.
PAGE = "page_id BIGINT, url STRING, html STRING, status INT, fetched_at TIMESTAMP"
PAGE_MIN = "page_id BIGINT, url STRING, html STRING"

# One tree node.  ``pre``/``fin`` are the pre-order positions of the node and of
# its last descendant: B lies in the subtree of A iff A.pre <= B.pre <= A.fin.
NODES_DDL = (
    "ARRAY<STRUCT<pre: INT, fin: INT, parent: INT, depth: INT, kind: STRING, tag: STRING, ns: STRING, "
    "n_attrs: INT, attrs: MAP<STRING, STRING>, text: STRING>>"
)

IMAGE_DDL = "STRUCT<url: STRING, title: STRING, caption: STRING, alt: STRING, width: INT, height: INT>"
VIDEO_DDL = (
    "STRUCT<url: STRING, embedded_url: STRING, title: STRING, description: STRING, "
    "duration: BIGINT, thumbnail: STRING>"
)
REF_DDL = "STRUCT<headline: STRING, article_link: STRING>"
BLOCK_DDL = f"STRUCT<type: STRING, text: STRING, image: {IMAGE_DDL}, video: {VIDEO_DDL}, ref: {REF_DDL}>"
RELATED_DDL = f"STRUCT<title: STRING, article_link: STRING, thumbnail: {IMAGE_DDL}>"
AUTHOR_DDL = "STRUCT<name: STRING, profile_url: STRING>"

# Canonical article: what both sites are brought to and what the store holds.
ARTICLE = (
    "id STRING, source STRING, link STRING, kind STRING, headline STRING, description STRING, "
    "published_from STRING, published_at TIMESTAMP, updated_at TIMESTAMP, "
    f"author {AUTHOR_DDL}, headline_image {IMAGE_DDL}, "
    f"contents ARRAY<STRUCT<pos: INT, type: STRING, text: STRING, image: {IMAGE_DDL}, "
    f"video: {VIDEO_DDL}, ref: {REF_DDL}>>, related ARRAY<{RELATED_DDL}>"
)

ARTICLE_COLUMNS = (
    "id source link kind headline description published_from published_at updated_at author "
    "headline_image contents related".split()
)

# Frontier entry: a link waiting to be fetched.
FRONTIER = "source STRING, link STRING, published_at TIMESTAMP"
FRONTIER_COLUMNS = "source link published_at".split()
