"""Structured Streaming: commits into the log, log tails, live buckets.

State and offsets live in the query's checkpoint.  ``foreachBatch`` may run a batch twice,
so each batch is written to its own folder, replacing what an earlier try left there.

A store has one ingest at a time.  Every ingest has a run: a name that follows the filter and
a number.  It goes on with the newest run if that has the same filter; else it begins a new
one, whose state starts from the posts that are in the store's log by then.  Log and rejects
are kept by run and batch, so no run ever writes over another's.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import time

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.text import score
from ..operators.changelog import replay
from ..operators.predicates import Predicate
from ..sources.store import file_system, folders

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTS = "spark.sql.shuffle.partitions"
#: Keys that uris and bad commits are dealt to.
_SPREAD = 4096
#: Rows that a key's present uris are dealt to when a run begins.
_ROWS = 16


def filter_hash(predicate: Predicate | None) -> str:
    return hashlib.sha256((predicate.signature() if predicate else "").encode()).hexdigest()[:12]


def query_name(base: str, predicate: Predicate | None) -> str:
    """A name that changes with the filter, so that another filter starts from its own checkpoint."""
    return f"{base}-{filter_hash(predicate)}"


def log_folder(root: str) -> str:
    return f"{root}/log"


def read_log(spark: SparkSession, root: str, schema) -> DataFrame:
    """What all runs have logged."""
    return spark.read.schema(schema).parquet(f"{log_folder(root)}/*/*")


def current_run(spark: SparkSession, root: str, name: str) -> tuple[str, bool]:
    """The run to use, and whether it is new: ``number.name``, the newest if its name is the same."""
    runs = sorted((x for x in folders(spark, f"{root}/checkpoints") if x.partition(".")[0].isdigit()), key=lambda x: int(x.partition(".")[0]))
    if runs and runs[-1].partition(".")[2] == name:
        return runs[-1], False
    return f"{int(runs[-1].partition('.')[0]) + 1 if runs else 0}.{name}", True


class _Presence(StatefulProcessor):
    """Which uris are present, as a map's entry for each present uri; yields the commits that take effect.

    A key is a share of all uris, since Spark makes a batch of its own of what each key yields.
    """

    def init(self, handle) -> None:
        self.present = handle.getMapState("present", T.StructType([T.StructField("uri", T.StringType())]), T.StructType([T.StructField("here", T.BooleanType())]))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for uri in initialState["uris"]:
            self.present.updateValue((uri,), (True,))

    def handleInputRows(self, key, rows, timerValues):
        commits = {}
        for row in rows:
            if row["_bad"]:
                yield row
            else:
                commits.setdefault(row["uri"], []).append(row)
        empty = not self.present.exists()
        for uri, some in commits.items():
            some.sort(key=lambda r: r["seq"])
            # an update takes effect whether or not the uri is present, so it needs no look at the state
            was = present = False if empty else None if some[0]["op"] == "update" else self.present.containsKey((uri,))
            for row in some:
                op = row["op"]
                if op == "update" or present == (op == "delete"):
                    yield Row(**row.asDict() | {"op": "D" if op == "delete" else "U"})
                present = op != "delete"
            if present and not was:
                self.present.updateValue((uri,), (True,))
            elif not present and was is not False:
                self.present.removeKey((uri,))

    def close(self) -> None:
        pass


def ingest_commits(commits: DataFrame, root: str, predicate: Predicate | None = None, most_errors: int | None = None, trigger: dict | None = None, parts: int | None = None) -> StreamingQuery:
    """Apply a stream of commits (``seq``, ``op``, ``uri`` and a post's columns) to the log under ``root``.

    Whether a uri is present is keyed state in RocksDB, so a batch's work does not grow with
    the log; a new run's state begins with the posts that the log holds (see ``state_size``
    for its rows and bytes).  Creates and updates that fail the filter are passed over.  Rows
    without a uri or a known op are errors: they go to ``rejects``, and more than
    ``most_errors`` of them in a batch end the query.

    A run's state lies in ``parts`` partitions (see ``stateful``).

    The query observes, as ``commits``, how many were seen before the filter and the largest
    ``time_us`` (or ``seq`` where there is none), for ``keep_cursor``.
    """
    spark, schema = commits.sparkSession, commits.schema
    run, new = current_run(spark, root, query_name("commits", predicate))
    good = F.coalesce(F.col("uri").isNotNull() & F.col("op").isin("create", "update", "delete"), F.lit(False))
    seen = commits.observe("commits", F.count(F.lit(1)).alias("seen"), F.max("time_us" if "time_us" in commits.columns else "seq").alias("cursor"))
    rows = seen.withColumn("_bad", ~good)
    if predicate is not None:
        rows = rows.where(F.col("_bad") | (F.col("op") == "delete") | predicate.condition)
    share = lambda *of: F.pmod(F.xxhash64(*of), F.lit(_SPREAD))
    rows = rows.withColumn("_key", F.when(F.col("_bad"), share(*[c for c in ("seq", "op", "uri") if c in schema.names])).otherwise(share("uri")))
    held = None
    if new and folders(spark, log_folder(root)):
        # a key's uris in rows of some: each row costs a call
        held = replay(read_log(spark, root, schema)).groupBy(share("uri").alias("_key"), F.pmod(F.crc32(F.col("uri").cast("binary")), F.lit(_ROWS)).alias("_row")).agg(F.collect_list("uri").alias("uris"))
    out = T.StructType([*schema.fields, T.StructField("_bad", T.BooleanType()), T.StructField("_key", T.LongType())])
    done = rows.groupBy("_key").transformWithState(_Presence(), out, "Append", "None", held.groupBy("_key") if held is not None else None)

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        bad = rows.where("_bad").select(schema.names)
        try:
            if most_errors is not None and bad.limit(most_errors + 1).count() > most_errors:
                raise ValueError(f"more than {most_errors} bad commits in batch {number}")
            bad.write.mode("overwrite").parquet(f"{root}/rejects/run={run}/batch={number}")
            rows.where("not _bad").select(schema.names).write.mode("overwrite").parquet(f"{log_folder(root)}/run={run}/batch={number}")
        finally:
            rows.unpersist()

    with stateful(spark, parts):
        return done.writeStream.foreachBatch(batch).queryName(run).option("checkpointLocation", f"{root}/checkpoints/{run}").trigger(**(trigger or {"availableNow": True})).outputMode("append").start()


@contextlib.contextmanager
def stateful(spark: SparkSession, parts: int | None = None):
    """Settings for a query that starts within: a query copies the session's when it starts.

    State in RocksDB, in ``parts`` partitions for good, two a core if not given (the session's
    ``spark.sql.shuffle.partitions`` at most): each costs every batch a fixed time, however few
    its rows.
    """
    own = {_PROVIDER: ROCKS, _PARTS: str(parts or min(int(spark.conf.get(_PARTS)), 2 * spark.sparkContext.defaultParallelism))}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_size(query: StreamingQuery) -> dict[str, int]:
    """Uris that a query's state holds and the bytes of its files, after its latest batch; bytes a uri are their quotient."""
    done = [p for p in query.recentProgress if p["stateOperators"]]
    state = done[-1]["stateOperators"] if done else []
    return {"uris": sum(o["numRowsTotal"] for o in state), "bytes": sum(o["customMetrics"].get("rocksdbSstFileSize", 0) or o["memoryUsedBytes"] for o in state)}


# --- how far a source has been read


def _cursor_file(root: str, source: str, predicate: Predicate | None) -> str:
    return f"{root}/cursors/{filter_hash(predicate)}/{hashlib.sha256(source.encode()).hexdigest()[:16]}.json"


def read_cursor(spark: SparkSession, root: str, source: str, predicate: Predicate | None) -> int | None:
    """Where a source was left under this filter; None under another one, or where it was never read."""
    path = _cursor_file(root, source, predicate)
    fs, where = file_system(spark, path)
    if not fs.exists(where):
        return None
    return spark.read.schema("cursor bigint").json(path).agg(F.max("cursor")).first()[0]


def write_cursor(spark: SparkSession, root: str, source: str, predicate: Predicate | None, cursor: int, seen: int) -> None:
    """One row a source and filter, replaced as a whole."""
    path = _cursor_file(root, source, predicate)
    fs, where = file_system(spark, path)
    new = file_system(spark, f"{path}.new")[1]
    out = fs.create(new, True)
    out.write(bytearray(json.dumps({"source": source, "filter": predicate.signature() if predicate else "", "cursor": cursor, "seen": seen, "updated_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}).encode()))
    out.close()
    fs.delete(where, False)
    fs.rename(new, where)


class Cursors:
    """Keeps a source's cursor from what a query of ``ingest_commits`` observes: it never goes back, and holds for this filter alone.

    ``absorb`` is called as batches end (``run_until`` does); a batch counts once.
    """

    def __init__(self, spark: SparkSession, root: str, source: str, predicate: Predicate | None = None):
        self.spark, self.where = spark, (root, source, predicate)
        self.cursor, self.seen, self.batch = read_cursor(spark, root, source, predicate), 0, -1

    def absorb(self, query: StreamingQuery) -> None:
        before = self.cursor
        for p in query.recentProgress:
            row = (p["observedMetrics"] or {}).get("commits")
            if p["batchId"] > self.batch and row is not None:
                self.batch, self.seen = p["batchId"], self.seen + row["seen"]
                if row["cursor"] is not None:
                    self.cursor = row["cursor"] if self.cursor is None else max(self.cursor, row["cursor"])
        if self.cursor != before:
            write_cursor(self.spark, *self.where, self.cursor, self.seen)


def run_until(query: StreamingQuery, seconds: float | None = None, rows: int | None = None, batches: int | None = None, every: float = 0.5, cursors: Cursors | None = None) -> str:
    """Let a query run until one of the limits is met, then stop it; returns which one, or ``end``.

    ``rows`` counts what was read, before any filter.  A batch that runs when a limit is met is
    not counted and, if it has not ended, is run again when the query is started anew.  The
    source's cursor, if one is given, is kept as batches end.
    """
    began, seen = time.monotonic(), {}
    while True:
        over = query.awaitTermination(every)
        seen |= {p["batchId"]: p["numInputRows"] for p in query.recentProgress}
        if cursors is not None:
            cursors.absorb(query)
        if over:
            return "end"
        for name, limit, now in (("seconds", seconds, time.monotonic() - began), ("rows", rows, sum(seen.values())), ("batches", batches, sum(n > 0 for n in seen.values()))):
            if limit is not None and now >= limit:
                query.stop()
                return name


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query has dropped since they came after the watermark, in the batches whose progress Spark still holds."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def tail_log(spark: SparkSession, path: str, schema, files_a_batch: int = 100) -> DataFrame:
    """A log directory as a stream of its new rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def live_buckets(posts: DataFrame, late: str = "1 hour", unit: str = "1 hour") -> DataFrame:
    """Buckets that close when the watermark passes; authors are counted approximately, in one small sketch a bucket."""
    return (
        posts.withWatermark("created_at", late)
        .groupBy(F.window("created_at", unit).alias("w"))
        .agg(F.count("*").alias("posts"), F.approx_count_distinct("author").alias("authors"), F.sum(score()).alias("engagement"))
        .select(F.col("w.start").alias("start"), "posts", "authors", "engagement")
    )


def exact_buckets(posts: DataFrame, late: str = "1 hour", unit: str = "1 hour") -> DataFrame:
    """The same with exact authors: sums are kept by bucket and author, and added up by bucket when they close."""
    each = posts.withWatermark("created_at", late).groupBy(F.window("created_at", unit).alias("w"), "author").agg(F.count("*").alias("posts"), F.sum(score()).alias("engagement"))
    return (
        each.groupBy("w")
        .agg(F.sum("posts").alias("posts"), F.count("*").alias("authors"), F.sum("engagement").alias("engagement"))
        .select(F.col("w.start").alias("start"), "posts", "authors", "engagement")
    )


def deduplicated(posts: DataFrame, late: str = "1 hour") -> DataFrame:
    """First sight of each uri within the watermark."""
    return posts.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["uri"])
