"""Counts, statistics, time buckets and digests of a posts table.

Ties are ordered by the key, ascending.  All are plain grouped aggregations, so Spark
combines on the map side and a busy author or tag costs one partial row a task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, iso, score

NO_TAG = "<none>"
_SUMS = {"likes": "like_count", "reposts": "repost_count", "replies": "reply_count", "quotes": "quote_count"}


def count(posts: DataFrame, limit: int | None = None) -> DataFrame:
    n = F.count("*")
    return posts.agg((F.least(n, F.lit(limit)) if limit is not None else n).alias("count"))


def count_by(posts: DataFrame, what: str, limit: int | None = None) -> DataFrame:
    """``key`` and ``count``, most first; ``what`` is author, hashtag, date or hour.  A limit cuts groups."""
    at = F.col("created_at")
    keys: dict[str, Column] = {
        "author": F.col("author"),
        "hashtag": F.explode(F.when(F.size("hashtags") == 0, F.array(F.lit(NO_TAG))).otherwise(F.col("hashtags"))),
        "date": F.date_format(at, "yyyy-MM-dd"),
        "hour": F.date_format(at, "yyyy-MM-dd'T'HH"),
    }
    if what not in keys:
        raise ValueError(f"cannot count by {what!r}")
    out = posts.select(keys[what].alias("key")).groupBy("key").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "key")
    return out if limit is None else out.limit(limit)


def stats(posts: DataFrame) -> DataFrame:
    return posts.agg(F.count("*").alias("posts"), F.count_distinct("author").alias("authors"), iso(F.min("created_at")).alias("first"), iso(F.max("created_at")).alias("last"))


def top(posts: DataFrame, what: str, n: int = 5) -> DataFrame:
    """The ``n`` authors or tags with most posts; a post counts once a distinct tag."""
    key = F.col("author") if what == "author" else F.explode(F.array_distinct("hashtags"))
    return posts.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("posts")).orderBy(F.desc("posts"), "key").limit(n)


def author_table(posts: DataFrame, sort: str = "posts") -> DataFrame:
    if sort not in ("posts", "engagement", "last_active"):
        raise ValueError(f"cannot sort by {sort!r}")
    out = posts.groupBy("author").agg(F.count("*").alias("posts"), F.max("created_at").alias("at"), F.sum(score()).alias("engagement"))
    return out.withColumn("last_active", iso(F.col("at"))).orderBy(F.col("at" if sort == "last_active" else sort).desc(), "author").drop("at")


def bucket(unit: str, at: Column | None = None) -> Column:
    at = F.col("created_at") if at is None else at
    if unit == "hour":
        return F.date_format(at, "yyyy-MM-dd'T'HH':00:00Z'")
    if unit == "day":
        return F.date_format(at, "yyyy-MM-dd")
    raise ValueError(f"no unit named {unit!r}")


def unit_for(start: datetime, end: datetime) -> str:
    """Hours up to a range of 48 hours, else days."""
    return "hour" if (end - start).total_seconds() <= 48 * 3600 else "day"


def buckets(posts: DataFrame, unit: str, metrics: list[str] | None = None) -> DataFrame:
    """Posts, distinct authors, four sums and engagement a bucket that has posts."""
    every = {"posts": F.count("*"), "authors": F.count_distinct("author"), **{k: F.sum(F.coalesce(F.col(c), F.lit(0))) for k, c in _SUMS.items()}, "engagement": F.sum(score())}
    if bad := set(metrics or []) - set(every):
        raise ValueError(f"no metric named {sorted(bad)[0]!r}")
    return posts.groupBy(bucket(unit).alias("bucket")).agg(*[every[m].alias(m) for m in (metrics or every)]).orderBy("bucket")


#: Binary logarithm of a sketch's registers: 4096, for a relative error of about 1.6 %.
SKETCH = 12


def bucket_sketches(posts: DataFrame, unit: str) -> DataFrame:
    """Sums and a sketch of the authors a bucket, to be stored: buckets can be added up to any range later on.

    Distinct authors of a range are not the sum of its buckets'; sketches of a few kilobytes
    merge, whatever the number of posts.
    """
    return posts.groupBy(bucket(unit).alias("bucket")).agg(F.count("*").alias("posts"), F.sum(score()).alias("engagement"), F.hll_sketch_agg("author", SKETCH).alias("authors"))


def rolled_up(sketches: DataFrame, range_of: Column) -> DataFrame:
    """``range``, ``posts``, ``engagement`` and estimated ``authors`` of stored buckets by a coarser key; batches of one bucket add up too."""
    out = sketches.groupBy(range_of.alias("range")).agg(F.sum("posts").alias("posts"), F.sum("engagement").alias("engagement"), F.hll_union_agg("authors").alias("authors"))
    return out.withColumn("authors", F.hll_sketch_estimate("authors"))


def digest_totals(posts: DataFrame) -> DataFrame:
    return posts.agg(F.count("*").alias("posts"), F.count_distinct("author").alias("authors"))


def digest_posts(posts: DataFrame, n: int = 5) -> DataFrame:
    """The most engaging posts, newest first among equals."""
    best = posts.withColumn("engagement", score()).orderBy(F.desc("engagement"), F.desc("created_at"), "uri").limit(n)
    return best.select("uri", "author", "engagement", clean(F.col("text"), 120).alias("text"))


def digest_tags(posts: DataFrame, n: int = 10) -> DataFrame:
    return posts.select(F.explode("hashtags").alias("tag")).groupBy("tag").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "tag").limit(n)


def digest_authors(posts: DataFrame, n: int = 10) -> DataFrame:
    """The most active authors; of equals, who was seen first."""
    out = posts.groupBy("author").agg(F.count("*").alias("posts"), F.min("created_at").alias("at"))
    return out.orderBy(F.desc("posts"), "at", "author").limit(n).select("author", "posts", iso(F.col("at")).alias("first_seen"))


def digest_volume(posts: DataFrame, unit: str) -> DataFrame:
    return posts.groupBy(bucket(unit).alias("bucket")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "bucket")


def threads(posts: DataFrame) -> DataFrame:
    """One row a thread root: posts in the thread and its first time."""
    return posts.groupBy(F.coalesce("reply_root_uri", "uri").alias("root")).agg(F.count("*").alias("posts"), iso(F.min("created_at")).alias("first"))
