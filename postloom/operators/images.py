"""Image references against a manifest of cached files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def references(posts: DataFrame, thumbs: bool = False) -> DataFrame:
    """Distinct ``variant`` and ``url`` of all images."""
    i = F.col("i")
    one = F.array(F.struct(F.lit("full").alias("variant"), i["fullsize"].alias("url")))
    both = F.array_append(one, F.struct(F.lit("thumb").alias("variant"), i["thumb"].alias("url"))) if thumbs else one
    return posts.select(F.explode("images").alias("i")).select(F.inline(both)).where("url is not null").distinct()


def coverage(refs: DataFrame, manifest: DataFrame) -> DataFrame:
    """``total``, ``cached`` and ``missing`` by variant."""
    known = manifest.select("variant", "url").distinct().withColumn("hit", F.lit(1))
    joined = refs.join(known, ["variant", "url"], "left")
    return joined.groupBy("variant").agg(F.count("*").alias("total"), F.count("hit").alias("cached"), (F.count("*") - F.count("hit")).alias("missing"))


def orphans(refs: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(refs, ["variant", "url"], "left_anti")


def expired(manifest: DataFrame, now, ttl_seconds: int) -> DataFrame:
    """Files at least as old as the limit; a limit of 0 takes all."""
    if ttl_seconds == 0:
        return manifest
    return manifest.where(F.col("cached_at") <= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(ttl_seconds)))
