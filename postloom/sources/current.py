"""Current posts on disk, kept up by merging increments into the buckets that they touch.

``state/version=v/bucket=b`` holds the posts whose uri falls into bucket ``b`` as version ``v``
wrote them.  A merge reads the newest version of the touched buckets alone, applies the
increment and writes these buckets as a new version; a version counts when its commit mark is
there, so a reader sees all of a merge or nothing.  Versions that no bucket needs any more are
deleted by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import file_system, folders

BUCKETS = 64
#: Uris up to which an increment's are sent to all tasks; with more the state is shuffled.
SMALL = 200_000


def bucket_of(uri: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(uri), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, path: str) -> dict[int, int]:
    """The newest committed version of every bucket that has one."""
    newest: dict[int, int] = {}
    for name in sorted(folders(spark, f"{path}/state"), key=lambda x: int(x.partition("=")[2])):
        inside = folders(spark, f"{path}/state/{name}")
        if "_SUCCESS" in inside:
            newest |= {int(x.partition("=")[2]): int(name.partition("=")[2]) for x in inside if x.startswith("bucket=")}
    return newest


def read_state(spark: SparkSession, path: str, schema, buckets: list[int] | None = None) -> DataFrame:
    """The current posts, of some buckets or of all, with the log's columns."""
    wanted = {b: v for b, v in versions(spark, path).items() if buckets is None or b in set(buckets)}
    if not wanted:
        return spark.createDataFrame([], schema)
    places = [f"{path}/state/version={v}/bucket={b}" for b, v in sorted(wanted.items())]
    return spark.read.schema(schema).option("basePath", f"{path}/state").parquet(*places)


def touched(uris: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The buckets of some uris: as many numbers as there are buckets at most."""
    return sorted(r[0] for r in uris.select(bucket_of(F.col("uri"), buckets)).distinct().collect())


def held(spark: SparkSession, path: str, uris: DataFrame, schema) -> DataFrame:
    """Those of ``uris(uri)`` that the state holds: of the touched buckets only the uris are read."""
    own = uris.select("uri").distinct()
    state = read_state(spark, path, schema, touched(own)).select("uri")
    few = own.limit(SMALL + 1).count() <= SMALL
    return state.join(F.broadcast(own) if few else own, "uri", "left_semi")


def merge(spark: SparkSession, path: str, rows: DataFrame, schema, buckets: int = BUCKETS) -> list[int]:
    """Apply log rows (``seq``, ``op``, ``uri`` and a post's columns, those of ``schema``) to the state; returns the buckets that were written anew.

    Of each uri the last row counts: an upsert replaces or adds the post, a delete takes it
    out.  A merge that is tried again gives the same state.
    """
    names = [c for c in schema.names if c != "uri"]
    parts = touched(rows, buckets)
    if not parts:
        return parts
    state = read_state(spark, path, schema, parts)
    # a uri's row in the state is one more row of it, with a lower seq
    both = state.select("uri", F.struct(*names).alias("row")).unionByName(rows.select("uri", F.struct(*names).alias("row")))
    now = both.groupBy("uri").agg(F.max_by("row", F.col("row.seq")).alias("last")).where("last.op = 'U'").select("uri", "last.*").select(*schema.names)
    version = max((int(x.partition("=")[2]) for x in folders(spark, f"{path}/state")), default=-1) + 1
    # a bucket that loses all its posts gets a folder too, else its older version would come back; the commit mark comes last
    for b in parts:
        fs, where = file_system(spark, f"{path}/state/version={version}/bucket={b}")
        fs.mkdirs(where)
    out = now.withColumn("bucket", bucket_of(F.col("uri"), buckets)).repartition("bucket").sortWithinPartitions("bucket", "uri")
    out.write.mode("append").partitionBy("bucket").parquet(f"{path}/state/version={version}")
    return parts


def clean(spark: SparkSession, path: str) -> None:
    """Delete what newer versions have replaced; no plan may still read it."""
    newest = versions(spark, path)
    for name in folders(spark, f"{path}/state"):
        v = int(name.partition("=")[2])
        for x in folders(spark, f"{path}/state/{name}"):
            if x.startswith("bucket=") and newest.get(int(x.partition("=")[2]), v) > v:
                fs, where = file_system(spark, f"{path}/state/{name}/{x}")
                fs.delete(where, True)
