"""Orders, pages and merged stores; all ties end in the uri."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import score
from .predicates import Predicate

METRICS = {"likes": "like_count", "reposts": "repost_count", "replies": "reply_count", "quotes": "quote_count"}


def metric(name: str) -> Column:
    if name == "engagement":
        return score()
    if name not in METRICS:
        raise ValueError(f"no metric named {name!r}")
    return F.coalesce(F.col(METRICS[name]), F.lit(0))


def by_time(posts: DataFrame, descending: bool = False) -> DataFrame:
    way = F.desc if descending else F.asc
    return posts.orderBy(way("created_at"), way("uri"))


def by_metric(posts: DataFrame, name: str) -> DataFrame:
    return posts.orderBy(metric(name).desc(), F.desc("created_at"), F.desc("uri"))


def page_after(posts: DataFrame, name: str, last: tuple, size: int) -> DataFrame:
    """The next ``size`` rows of ``by_metric`` after the row (metric, created_at, uri)."""
    m, (value, at, uri) = metric(name), last
    after = (m < value) | ((m == value) & ((F.col("created_at") < F.lit(at)) | ((F.col("created_at") == F.lit(at)) & (F.col("uri") < uri))))
    return by_metric(posts.where(after), name).limit(size)


def scan_limited(posts: DataFrame, predicate: Predicate, scan: int | None = None) -> DataFrame:
    """Matches among the first ``scan`` posts by time, or among all."""
    return (posts if scan is None else by_time(posts).limit(scan)).where(predicate.condition)


def merge_stores(stores: dict[str, DataFrame], descending: bool = False) -> DataFrame:
    """All stores' rows in one time order, each with its ``store``."""
    if not stores:
        raise ValueError("no stores")
    both = functools.reduce(lambda a, b: a.unionByName(b), [df.withColumn("store", F.lit(n)) for n, df in sorted(stores.items())])
    way = F.desc if descending else F.asc
    return both.orderBy(way("created_at"), way("uri"), F.asc("store"))
