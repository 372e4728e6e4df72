"""A store on disk: posts by day and their log by batch, as Parquet."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Columns that single posts are looked up by: row groups have Bloom filters of their values.
LOOKUPS = ("uri", "author")
#: Bytes of a row group: small enough that a lookup skips most of a large file.
ROW_GROUP = 16 << 20


def write_posts(posts: DataFrame, path: str, row_group: int = ROW_GROUP) -> None:
    """One folder a day; rows of a day are dealt to several files where there are many.

    Files are sorted by author and time, so statistics part authors; Bloom filters by row
    group let a lookup of a uri pass over the rest.
    """
    dealt = posts.hint("rebalance", "created_date").sortWithinPartitions("created_date", "author", "created_at")
    writer = dealt.write.mode("overwrite").partitionBy("created_date").option("parquet.block.size", str(row_group))
    for column in LOOKUPS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(f"{path}/posts")


def read_posts(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/posts")


def append_log(rows: DataFrame, path: str, batch: int) -> None:
    """A batch of log rows; a second try of the same batch replaces the first."""
    rows.write.mode("overwrite").parquet(f"{path}/log/batch={batch}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/log")


def by_uri(posts: DataFrame, uri: str) -> DataFrame:
    return posts.where(F.col("uri") == uri)


def by_date(posts: DataFrame, day: date) -> DataFrame:
    return posts.where(F.col("created_date") == F.lit(day)).orderBy("created_at", "uri")


def by_hashtag(posts: DataFrame, tag: str) -> DataFrame:
    return posts.where(F.array_contains("hashtags", tag)).orderBy("uri")


def by_author(posts: DataFrame, author: str) -> DataFrame:
    return posts.where(F.col("author") == author.lower()).orderBy("created_at", "uri")


def exists(posts: DataFrame, uri: str) -> bool:
    return not by_uri(posts, uri).isEmpty()


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if it does not exist."""
    fs, where = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def reset(spark: SparkSession, path: str) -> None:
    """Clear a store's posts, log, checkpoints and cursors, so that a derivation can start over."""
    for part in ("posts", "log", "checkpoints", "cursors", "state"):
        fs, where = file_system(spark, f"{path}/{part}")
        fs.delete(where, True)
