"""Text and score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of tags, mentions and links in a post's text.
HASHTAG = r"#[\p{L}\p{M}\p{Pc}\p{Po}\p{Pd}\p{S}][\p{L}\p{M}\p{N}\p{Pc}\p{Po}\p{Pd}\p{S}]*"
MENTION = r"(?i)@([a-z0-9][a-z0-9.-]{1,63})"
LINK = r"""https?://[^\s)]+[^\s).,;:!?'"]"""


def score() -> Column:
    """Engagement: likes, reposts and quotes twice, replies three times; nulls count 0."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return n("like_count") + 2 * n("repost_count") + 3 * n("reply_count") + 2 * n("quote_count")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def clean(text: Column, width: int) -> Column:
    """White space collapsed, then cut to ``width`` with ``...``."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 3), F.lit("..."))).otherwise(flat)


def hashtags_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(HASHTAG), F.lit(0)))


def mentions_in(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MENTION), F.lit(1)), F.lower))


def links_in(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)))


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def markdown_cell(text: Column, width: int = 80) -> Column:
    return F.regexp_replace(clean(text, width), r"\|", r"\\|")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
