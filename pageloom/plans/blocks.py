"""Content blocks: one typed struct with a nullable member per variant."""

from __future__ import annotations

from pageloom.functions.scalars import keep, lit, struct
from pageloom.schema import AUTHOR_DDL, BLOCK_DDL, IMAGE_DDL, REF_DDL, RELATED_DDL, VIDEO_DDL


def _typed(ddl: str, values: dict[str, str | None]) -> str:
    return f"CAST({struct(**{k: v or 'NULL' for k, v in values.items()})} AS {ddl})"


def image(url=None, title=None, caption=None, alt=None, width=None, height=None) -> str:
    return _typed(
        IMAGE_DDL, dict(url=url, title=title, caption=caption, alt=alt, width=width, height=height)
    )


def video(
    url=None, embedded_url=None, title=None, description=None, duration=None, thumbnail=None
) -> str:
    return _typed(
        VIDEO_DDL,
        dict(
            url=url, embedded_url=embedded_url, title=title, description=description,
            duration=duration, thumbnail=thumbnail,
        ),
    )


def reference(headline: str, article_link: str) -> str:
    return _typed(REF_DDL, dict(headline=headline, article_link=article_link))


def block(kind: str, text=None, image=None, video=None, ref=None) -> str:
    return _typed(BLOCK_DDL, dict(type=lit(kind), text=text, image=image, video=video, ref=ref))


def related(title: str, article_link: str, thumbnail: str | None = None) -> str:
    return _typed(
        RELATED_DDL, dict(title=title, article_link=article_link, thumbnail=thumbnail)
    )


def author(name: str, profile_url: str) -> str:
    return _typed(AUTHOR_DDL, dict(name=name, profile_url=profile_url))


NONE = f"CAST(array() AS ARRAY<{BLOCK_DDL}>)"


def present(blocks: str) -> str:
    """Drop the places of claimed nodes that produced no block."""
    return keep(blocks, lambda b: f"{b} IS NOT NULL")
