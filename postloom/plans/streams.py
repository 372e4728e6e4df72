"""Registered queries that run a stream over the tables to its end and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changelog as c
from ..operators import predicates as p
from ..operators.graph import saved
from ..streaming import ingest
from .base import LOG, POSTS, log, posts, query

_COLUMNS = ["seq", "op", "uri", "author", "like_count", "hashtags"]


def new_folder(spark: SparkSession) -> str:
    """A new folder beside the session's checkpoints."""
    saved(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _commits(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("op") == "D", "delete").when(F.col("seq") % 10 == 3, "update").otherwise("create")
    return log(spark, d).withColumn("op", op).select(_COLUMNS)


def _staged(rows: DataFrame, path: str, order: Column, rows_a_file: int = 1_000_000) -> None:
    """Files written one after another, in ranges of the order, as a source would have: a bounded one each, more for more rows.

    The rows are worked out once, into a table dealt by range; each range is then read alone.
    """
    n = rows.count()
    parts = max(3, -(-n // rows_a_file))
    dealt = rows.withColumn("_order", order).repartitionByRange(parts, "_order").withColumn("_part", F.spark_partition_id()).drop("_order")
    dealt.write.partitionBy("_part").parquet(f"{path}-ranges")
    spark = rows.sparkSession
    for k in range(parts):
        part = spark.read.schema(rows.schema).parquet(f"{path}-ranges/_part={k}*")
        part.coalesce(1).write.mode("append").parquet(path)


@query(f"""{LOG}, kept AS (SELECT *, lag(op) OVER (PARTITION BY uri ORDER BY seq) AS b FROM post_log WHERE op = 'D' OR coalesce(like_count, 0) >= 3),
took AS (SELECT * FROM kept WHERE seq % 10 = 3 OR CASE WHEN op = 'D' THEN b IS NOT NULL AND b = 'U' ELSE b IS NULL OR b = 'D' END),
current AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY seq DESC) AS n FROM took) WHERE n = 1 AND op = 'U')
SELECT uri, seq, like_count FROM current""")
def s_commits_stream(spark, d):
    root = new_folder(spark)
    _staged(_commits(spark, d), f"{root}/in", F.col("seq"))
    schema = spark.read.parquet(f"{root}/in").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    ingest.ingest_commits(rows, root, p.engagement(likes=3)).awaitTermination()
    return c.replay(ingest.read_log(spark, root, schema)).select("uri", "seq", "like_count")


@query(f"""{LOG}, part AS (SELECT *, seq > (SELECT max(seq) // 2 FROM post_log) AS late FROM post_log), kept AS (SELECT *, lag(op) OVER (PARTITION BY uri ORDER BY seq) AS b FROM part WHERE op = 'D' OR CASE WHEN late THEN coalesce(like_count, 0) >= 8 ELSE coalesce(like_count, 0) >= 3 END),
took AS (SELECT * FROM kept WHERE seq % 10 = 3 OR CASE WHEN op = 'D' THEN b IS NOT NULL AND b = 'U' ELSE b IS NULL OR b = 'D' END)
SELECT uri, seq, CASE WHEN op = 'D' THEN 'D' ELSE 'U' END AS op, like_count FROM took""")
def s_commits_resumed(spark, d):
    """The log after two runs with two filters: the second one starts from what the first has stored."""
    root, rows = new_folder(spark), _commits(spark, d)
    cut = (rows.agg(F.max("seq")).first()[0] or 0) // 2
    for number, (part, likes) in enumerate(((F.col("seq") <= cut, 3), (F.col("seq") > cut, 8))):
        _staged(rows.where(part), f"{root}/in{number}", F.col("seq"))
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in{number}")
        ingest.ingest_commits(stream, root, p.engagement(likes=likes)).awaitTermination()
    return ingest.read_log(spark, root, rows.schema).select("uri", "seq", "op", "like_count")


@query(f"""{POSTS}, hours AS (SELECT date_trunc('hour', created_at) AS h, count(*) AS posts, count(DISTINCT author) AS authors, sum(score)::BIGINT AS engagement FROM posts GROUP BY 1)
SELECT strftime(h, '%Y-%m-%dT%H:00:00Z') AS bucket, posts, authors, engagement FROM hours WHERE h + INTERVAL 1 HOUR <= (SELECT max(created_at) - INTERVAL 1 HOUR FROM posts)""")
def s_live_buckets(spark, d):
    root = new_folder(spark)
    rows = posts(spark, d).select("uri", "author", F.col("created_at").cast("timestamp").alias("created_at"), "like_count", "repost_count", "reply_count", "quote_count")
    _staged(rows, f"{root}/in", F.unix_micros("created_at"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    with ingest.stateful(spark):
        done = ingest.exact_buckets(stream).writeStream.outputMode("append").option("checkpointLocation", f"{root}/checkpoints/buckets").trigger(availableNow=True).start(f"{root}/out", format="parquet")
    done.awaitTermination()
    return spark.read.parquet(f"{root}/out").select(F.date_format("start", "yyyy-MM-dd'T'HH':00:00Z'").alias("bucket"), "posts", "authors", "engagement")


@query(f"{LOG} SELECT seq, op, uri FROM post_log")
def s_log_tail(spark, d):
    root = new_folder(spark)
    rows = log(spark, d).select(_COLUMNS)
    _staged(rows, f"{root}/in", F.col("seq"))
    stream = ingest.tail_log(spark, f"{root}/in", rows.schema, 1)
    stream.writeStream.option("checkpointLocation", f"{root}/checkpoints/tail").trigger(availableNow=True).start(f"{root}/out", format="parquet").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("seq", "op", "uri")
