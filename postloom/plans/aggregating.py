"""Registered queries: counts, statistics, buckets and digests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import aggregates as a
from ..operators import predicates as p
from .base import POSTS, posts, query

_DAY = "created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'"


def _day(spark, d):
    return posts(spark, d).where(p.date_range(datetime(2024, 1, 5), datetime(2024, 1, 6)).condition)


def _counted(key: str, source: str = "posts") -> str:
    return f"{POSTS} SELECT {key} AS key, count(*) AS count FROM {source} GROUP BY 1"


_TAGS = "(SELECT unnest(CASE WHEN len(hashtags) = 0 THEN ['<none>'] ELSE hashtags END) AS t FROM posts)"
_SUMS = "sum(coalesce(like_count, 0))::BIGINT AS likes, sum(repost_count)::BIGINT AS reposts, sum(reply_count)::BIGINT AS replies, sum(quote_count)::BIGINT AS quotes, sum(score)::BIGINT AS engagement"


@query(f"{POSTS} SELECT least(count(*), 700) AS count FROM posts WHERE has_media OR is_reply")
def a_count(spark, d):
    return a.count(posts(spark, d).where(F.col("has_media") | F.col("is_reply")), 700)


@query(_counted("author"))
def a_count_by_author(spark, d):
    return a.count_by(posts(spark, d), "author")


@query(_counted("author") + " ORDER BY count DESC, key LIMIT 7")
def a_count_by_author_limit(spark, d):
    return a.count_by(posts(spark, d), "author", 7)


@query(_counted("t", _TAGS))
def a_count_by_hashtag(spark, d):
    return a.count_by(posts(spark, d), "hashtag")


@query(_counted("strftime(created_at, '%Y-%m-%d')"))
def a_count_by_date(spark, d):
    return a.count_by(posts(spark, d), "date")


@query(_counted("strftime(created_at, '%Y-%m-%dT%H')"))
def a_count_by_hour(spark, d):
    return a.count_by(posts(spark, d), "hour")


@query(f"{POSTS} SELECT count(*) AS posts, count(DISTINCT author) AS authors, min(iso) AS first, max(iso) AS last FROM posts")
def a_stats(spark, d):
    return a.stats(posts(spark, d))


@query(f"{POSTS} SELECT author AS key, count(*) AS posts FROM posts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def a_top_authors(spark, d):
    return a.top(posts(spark, d), "author")


@query(f"{POSTS} SELECT t AS key, count(*) AS posts FROM (SELECT unnest(list_distinct(hashtags)) AS t FROM posts) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def a_top_tags(spark, d):
    return a.top(posts(spark, d), "hashtag")


@query(f"{POSTS} SELECT author, count(*) AS posts, max(iso) AS last_active, sum(score)::BIGINT AS engagement FROM posts GROUP BY 1")
def a_author_table(spark, d):
    return a.author_table(posts(spark, d), "engagement")


@query(f"{POSTS} SELECT strftime(created_at, '%Y-%m-%dT%H:00:00Z') AS bucket, count(*) AS posts, count(DISTINCT author) AS authors, {_SUMS} FROM posts GROUP BY 1")
def a_buckets_hour(spark, d):
    return a.buckets(posts(spark, d), "hour")


@query(f"{POSTS} SELECT strftime(created_at, '%Y-%m-%d') AS range, count(*) AS posts, sum(score)::BIGINT AS engagement, true AS close FROM posts GROUP BY 1")
def a_rolled_up(spark, d):
    """Days from the sketches of hours: sums as they are, distinct authors within five percent (and one) of the exact number."""
    rows = posts(spark, d)
    days = a.rolled_up(a.bucket_sketches(rows, "hour"), F.substring("bucket", 1, 10))
    exact = rows.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("range")).agg(F.count_distinct("author").alias("exact"))
    return days.join(exact, "range").select("range", "posts", "engagement", (F.abs(F.col("authors") - F.col("exact")) <= 1 + 0.05 * F.col("exact")).alias("close"))


@query(f"{POSTS} SELECT strftime(created_at, '%Y-%m-%d') AS bucket, count(*) AS posts, sum(score)::BIGINT AS engagement FROM posts GROUP BY 1")
def a_buckets_day(spark, d):
    return a.buckets(posts(spark, d), "day", ["posts", "engagement"])


@query(f"{POSTS} SELECT count(*) AS posts, count(DISTINCT author) AS authors FROM posts WHERE {_DAY}")
def a_digest_totals(spark, d):
    return a.digest_totals(_day(spark, d))


@query(rf"""{POSTS} SELECT uri, author, score AS engagement, CASE WHEN length(flat) > 120 THEN substring(flat, 1, 117) || '...' ELSE flat END AS text
FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM posts WHERE {_DAY}) ORDER BY score DESC, created_at DESC, uri LIMIT 5""")
def a_digest_posts(spark, d):
    return a.digest_posts(_day(spark, d))


@query(f"{POSTS} SELECT t AS tag, count(*) AS count FROM (SELECT unnest(hashtags) AS t FROM posts WHERE {_DAY}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def a_digest_tags(spark, d):
    return a.digest_tags(_day(spark, d))


@query(f"{POSTS} SELECT author, count(*) AS posts, min(iso) AS first_seen FROM posts WHERE {_DAY} GROUP BY 1 ORDER BY 2 DESC, 3, 1 LIMIT 10")
def a_digest_authors(spark, d):
    return a.digest_authors(_day(spark, d))


@query(f"{POSTS} SELECT strftime(created_at, '%Y-%m-%dT%H:00:00Z') AS bucket, count(*) AS count FROM posts WHERE {_DAY} GROUP BY 1")
def a_digest_volume(spark, d):
    return a.digest_volume(_day(spark, d), a.unit_for(datetime(2024, 1, 5), datetime(2024, 1, 6)))


@query(f"{POSTS} SELECT coalesce(reply_root_uri, uri) AS root, count(*) AS posts, min(iso) AS first FROM posts GROUP BY 1")
def a_thread_groups(spark, d):
    return a.threads(posts(spark, d))


@query(f"""{POSTS} SELECT strftime(created_at, '%Y-%m-%d') AS bucket, count(*) AS posts FROM posts GROUP BY 1
UNION ALL SELECT strftime(created_at, '%Y-%m-%dT%H:00:00Z'), count(*) FROM posts WHERE created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' GROUP BY 1""")
def a_auto_unit(spark, d):
    """Buckets of a unit that follows from the range: days for all posts, hours for those of a day."""
    rows = posts(spark, d)
    some = rows.where(p.date_range(datetime(2024, 1, 5), datetime(2024, 1, 6)).condition)
    out = None
    for part in (rows, some):
        first, last = part.agg(F.min("created_at"), F.max("created_at")).first()
        made = a.buckets(part, a.unit_for(first, last) if first else "day", ["posts"])
        out = made if out is None else out.union(made)
    return out
