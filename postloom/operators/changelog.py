"""The change log of posts: replay, ingest policies, commits, derived stores.

A log row has ``seq`` (unique, ascending), ``op`` (U or D) and ``uri`` beside the post's
columns.  A sequential fold per uri becomes a grouped ``max_by`` or a window over the uri's
own rows; nothing is ordered over the whole log.
"""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .predicates import Predicate


def replay(log: DataFrame) -> DataFrame:
    """The current posts: of each uri the last row, if that is an upsert.  Partial maxima keep a busy uri cheap.

    Each column has a maximum of its own, by the unique ``seq``: those that nobody reads are
    neither read nor shuffled.
    """
    names = [c for c in log.columns if c not in ("uri", "seq", "op")]
    last = log.groupBy("uri").agg(F.max_by(F.col("op") == "U", "seq").alias("_there"), F.max("seq").alias("seq"), *[F.max_by(c, "seq").alias(c) for c in names])
    return last.where("_there").select("uri", *[c for c in log.columns if c not in ("uri", "op")])


def tail(log: DataFrame, after: int) -> DataFrame:
    return log.where(F.col("seq") > after)


def last_seq(log: DataFrame) -> DataFrame:
    return log.agg(F.max("seq").alias("last_seq"))


def append(log: DataFrame, rows: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with the next seqs after ``log``, in the given order.

    Numbers come from a range partitioning (into ``parts``, else as many as shuffles have) and
    its partition counts, a row a part, so no task sees all rows.
    """
    parts = parts or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order)
    inside = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = inside.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a part
    base = log.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_base"))  # one row
    joined = inside.join(F.broadcast(before), "_part").join(F.broadcast(base))
    return joined.withColumn("seq", F.col("_base") + F.col("_before") + F.col("_at")).drop("_part", "_at", "_before", "_base")


def dedupe(existing: DataFrame, upserts: DataFrame) -> DataFrame:
    """First write wins: of each new uri the first upsert; existing uris are left alone."""
    names = [c for c in upserts.columns if c not in ("uri", "seq")]
    first = upserts.groupBy("uri").agg(F.min("seq").alias("seq"), *[F.min_by(c, "seq").alias(c) for c in names]).select("uri", *[c for c in upserts.columns if c != "uri"])
    return first.join(existing.select("uri"), "uri", "left_anti")


def refresh(log: DataFrame, upserts: DataFrame) -> DataFrame:
    """Every upsert is logged; the log to replay."""
    return log.unionByName(upserts, allowMissingColumns=True)


def ingest_batch(existing: DataFrame, lines: DataFrame, predicate: Predicate | None = None, order: tuple[str, ...] = ("created_at", "uri")) -> tuple[DataFrame, DataFrame]:
    """A batch of lines parsed, filtered and cut down to new uris: the posts to store, and the batch's counts.

    Of several posts with one uri the first in ``order`` is stored.  The counts come from one
    pass over the lines: ``added``, ``skipped`` (errors too) and ``errors``.
    """
    from ..sources.ndjson import decode, parsed_lines
    from .normalize import posts_of

    candidates, _ = decode(lines)
    kept = candidates if predicate is None else candidates.where(predicate.condition)
    first = kept.groupBy("uri").agg(F.min_by(F.struct(*[c for c in kept.columns if c != "uri"]), F.struct(*order)).alias("p")).select("uri", "p.*")
    stored = first.join(existing.select("uri"), "uri", "left_anti")
    # lines that are no posts stay in the pass, as rows of nulls that only count
    parsed = parsed_lines(lines)
    rows = posts_of(parsed.withColumn("shape", F.when(F.col("reason").isNull(), F.col("shape"))).select("parsed", "shape"))
    good = F.col("uri").isNotNull()
    taken = good if predicate is None else good & predicate.column
    by_uri = rows.groupBy(F.when(taken, F.col("uri")).alias("uri")).agg(F.count("*").alias("lines"), F.count_if(~good).alias("errors"))
    known = existing.select("uri").distinct().withColumn("_known", F.lit(True))
    added = F.count_if(F.col("uri").isNotNull() & F.col("_known").isNull())
    counts = by_uri.join(known, "uri", "left").agg(added.alias("added"), F.coalesce(F.sum("lines"), F.lit(0)).alias("_lines"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"))
    return stored, counts.select("added", (F.col("_lines") - F.col("added")).alias("skipped"), "errors")


def ingest_counts(candidates: DataFrame, stored: DataFrame, errors: DataFrame) -> DataFrame:
    """``added``, ``skipped`` (errors too) and ``errors`` of one batch."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(candidates, "seen").join(F.broadcast(n(stored, "added"))).join(F.broadcast(n(errors, "errors")))  # one row each
    return out.select("added", (F.col("seen") - F.col("added") + F.col("errors")).alias("skipped"), "errors")


def applied_commits(existing: DataFrame, commits: DataFrame, predicate: Predicate | None = None) -> DataFrame:
    """The commits of one batch that take effect, in a log's form.

    ``commits`` has ``seq``, ``op`` (create, update, delete), ``uri`` and a post's columns.  A
    create counts where the uri is absent at that moment, a delete where it is present, an
    update always; creates and updates that fail the filter are passed over, deletes are not.
    """
    kept = commits if predicate is None else commits.where((F.col("op") == "delete") | predicate.condition)
    known = existing.select("uri").distinct().withColumn("_known", F.lit(True))
    rows = kept.join(known, "uri", "left")
    before = F.lag("op").over(Window.partitionBy("uri").orderBy("seq"))
    # after a create or an update the uri is there, after a delete it is not, whether that took effect or not
    present = F.when(before.isNull(), F.col("_known").isNotNull()).otherwise(before != "delete")
    rows = rows.withColumn("_present", present)
    took = F.when(F.col("op") == "create", ~F.col("_present")).when(F.col("op") == "delete", F.col("_present")).otherwise(True)
    return rows.where(took).withColumn("op", F.when(F.col("op") == "delete", "D").otherwise("U")).drop("_known", "_present")


def fold_commits(existing: DataFrame, commits: DataFrame, predicate: Predicate | None = None) -> DataFrame:
    """The posts after one batch of commits; ``existing`` has the columns of ``commits`` without ``op``."""
    done = applied_commits(existing, commits, predicate)
    return replay(existing.withColumn("seq", F.lit(-1).cast("bigint")).withColumn("op", F.lit("U")).unionByName(done)).drop("seq")


def derive_kinds(log: DataFrame, match: Column, target: DataFrame | None = None) -> DataFrame:
    """The log with ``kind``: delete, matched (to be copied) or skipped.

    Deletes part a uri's rows into epochs; of each epoch the first matching upsert is copied,
    in the first epoch only if the target lacks the uri.
    """
    own = Window.partitionBy("uri").orderBy("seq")
    rows = log.withColumn("_match", (F.col("op") == "U") & F.coalesce(match, F.lit(False)))
    rows = rows.withColumn("_epoch", F.sum((F.col("op") == "D").cast("int")).over(own))
    rows = rows.withColumn("_rank", F.sum(F.col("_match").cast("int")).over(Window.partitionBy("uri", "_epoch").orderBy("seq")))
    if target is None:
        rows = rows.withColumn("_held", F.lit(False))
    else:
        rows = rows.join(target.select("uri").distinct().withColumn("_held", F.lit(True)), "uri", "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    copied = F.col("_match") & (F.col("_rank") == 1) & ~(F.col("_held") & (F.col("_epoch") == 0))
    kind = F.when(F.col("op") == "D", "delete").when(copied, "matched").otherwise("skipped")
    return rows.withColumn("kind", kind).drop("_match", "_epoch", "_rank", "_held")


def derive(log: DataFrame, predicate: Predicate, source_store: str, target: DataFrame | None = None) -> DataFrame:
    """Rows that the target's log gets: all deletes and the copied upserts, with where they came from."""
    rows = derive_kinds(log, predicate.condition, target).where("kind <> 'skipped'").drop("kind")
    return rows.withColumn("source_store", F.lit(source_store))


def derive_incremental(log: DataFrame, predicate: Predicate, source_store: str, target_log: DataFrame, after: int) -> DataFrame:
    """The further rows after a checkpoint, given what the target's log holds."""
    return derive(tail(log, after), predicate, source_store, replay(target_log))


def derive_onto(log: DataFrame, predicate: Predicate, source_store: str, path: str, schema, after: int) -> DataFrame:
    """The further rows after a checkpoint, given the target's current posts under ``path`` (see ``sources.current``).

    Reads the log's tail and the uris of the buckets that it touches; the cost follows the
    tail and not the target's log.  Merge the rows into the state once they are in the log.
    """
    from ..sources import current

    rows = tail(log, after)
    return derive(rows, predicate, source_store, current.held(log.sparkSession, path, rows, schema))


def derive_counts(log: DataFrame, predicate: Predicate, target: DataFrame | None = None) -> DataFrame:
    """``processed`` = ``matched`` + ``skipped`` + ``deletes``; the dry run."""
    n = lambda k: F.coalesce(F.sum((F.col("kind") == k).cast("bigint")), F.lit(0))
    return derive_kinds(log, predicate.column, target).agg(F.count("*").alias("processed"), n("matched").alias("matched"), n("skipped").alias("skipped"), n("delete").alias("deletes"))


def check_derivation(source: str, target: str, predicate: Predicate, mode: str, checkpoint: dict | None, target_empty: bool) -> None:
    """Raise ``ValueError`` where a derivation may not start."""
    if source == target:
        raise ValueError("a store cannot be derived from itself")
    if mode not in ("event-time", "derive-time"):
        raise ValueError(f"no mode named {mode!r}")
    if mode == "event-time" and any(t in predicate.signature() for t in ('"HasValidLinks"', '"Trending"')):
        raise ValueError("a filter with lookups needs derive-time")
    if checkpoint is None and not target_empty:
        raise ValueError("the target holds posts but no checkpoint")
    if checkpoint is not None and (checkpoint["filter"] != predicate.signature() or checkpoint["mode"] != mode):
        raise ValueError("filter or mode differ from the checkpoint's")


def prune_author(posts: DataFrame, author: str) -> DataFrame:
    """A delete for each of the author's posts, to be appended."""
    return posts.where(F.col("author") == author.lower()).select(F.lit("D").alias("op"), "uri", "author")


def lineage_row(df: DataFrame, source: str, target: str, predicate: Predicate, mode: str, now: datetime) -> DataFrame:
    """One row that says how a store was made: with the filter, its hash, and when."""
    signature = predicate.signature()
    row = (target, source, signature, hashlib.sha256(signature.encode()).hexdigest(), mode, now)
    return df.sparkSession.createDataFrame([row], "target string, source string, filter string, filter_hash string, mode string, updated_at timestamp_ntz")


def staleness(lineage: DataFrame, checkpoints: DataFrame, last: DataFrame) -> DataFrame:
    """``target``, ``source`` and ``state``: without checkpoint or seq stale, source empty fresh, else by comparison."""
    out = lineage.join(checkpoints, ["target", "source"], "left").join(last.withColumnRenamed("store", "source"), "source", "left")
    state = F.when(F.col("checkpoint_seq").isNull() & F.col("has_checkpoint").isNull(), "stale").when(F.col("last_seq").isNull(), "fresh").when(F.col("checkpoint_seq").isNull(), "stale").when(F.col("last_seq") > F.col("checkpoint_seq"), "stale").otherwise("fresh")
    return out.select("target", "source", state.alias("state"))


def store_status(stores: DataFrame, states: DataFrame) -> DataFrame:
    """Each store's ``status``: source where it is never a target, else stale if any of its sources is, else ready; unknown where its only lineage names no source."""
    by = states.groupBy(F.col("target").alias("store")).agg(F.count("source").alias("sources"), F.max((F.col("state") == "stale").cast("int")).alias("stale"))
    status = F.when(F.col("sources").isNull(), "source").when(F.col("sources") == 0, "unknown").when(F.col("stale") == 1, "stale").otherwise("ready")
    return stores.join(by, "store", "left").select("store", status.alias("status"))


def sync_status(stores: DataFrame, last: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Each store's ``sync``: empty without a log, unknown without a checkpoint, else whether the newest one is at the log's end.

    ``last`` has ``store`` and ``last_seq``; ``checkpoints`` has ``store``, ``checkpoint_seq`` and ``updated_at``.
    """
    newest = checkpoints.groupBy("store").agg(F.max_by(F.struct("checkpoint_seq"), "updated_at").alias("newest"))
    out = stores.join(last.select("store", "last_seq"), "store", "left").join(newest, "store", "left")
    state = F.when(F.col("last_seq").isNull(), "empty").when(F.col("newest").isNull(), "unknown").when(F.col("newest.checkpoint_seq") == F.col("last_seq"), "current").otherwise("stale")
    return out.select("store", state.alias("sync"))


def store_table(stores: DataFrame, status: DataFrame, posts: DataFrame) -> DataFrame:
    """Each store with its status and its number of posts (``posts`` has a row a post and its ``store``)."""
    counts = posts.groupBy("store").agg(F.count("*").alias("posts"))
    return stores.join(status, "store", "left").join(counts, "store", "left").select("store", "status", F.coalesce("posts", F.lit(0)).alias("posts"))


def topology_edges(lineage: DataFrame) -> DataFrame:
    """``source``, ``target`` of every derivation, once each."""
    return lineage.where("source is not null").select("source", "target").distinct()


def topology(stores: DataFrame, lineage: DataFrame) -> DataFrame:
    """Each store with its numbers of sources and of derived stores, and whether it is a root."""
    sources = lineage.groupBy(F.col("target").alias("store")).agg(F.count_distinct("source").alias("sources"))
    derived = lineage.groupBy(F.col("source").alias("store")).agg(F.count_distinct("target").alias("derived"))
    out = stores.join(sources, "store", "left").join(derived, "store", "left")
    zero = F.lit(0).cast("bigint")
    return out.select("store", F.coalesce("sources", zero).alias("sources"), F.coalesce("derived", zero).alias("derived"), F.col("sources").isNull().alias("is_root"))


def fold_results(results: DataFrame) -> DataFrame:
    """Sums of added, deleted and skipped over batches, and the number of errors."""
    return results.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("added", "deleted", "skipped", "errors")])


def stores_summary(posts: DataFrame, stores: DataFrame, lineage: DataFrame, store_of: str) -> DataFrame:
    """How many stores, sources and derived stores there are, and posts in all."""
    kinds = topology(stores, lineage).agg(F.count("*").alias("stores"), F.sum(F.col("is_root").cast("bigint")).alias("sources"), F.sum((~F.col("is_root")).cast("bigint")).alias("derived"))
    return kinds.join(F.broadcast(posts.agg(F.count(store_of).alias("posts"))))  # one row each


def match_rates(source_posts: int, derived: DataFrame) -> DataFrame:
    """Derived posts as a percentage of the source's."""
    return derived.withColumn("percent", F.round(100.0 * F.col("posts") / F.lit(max(source_posts, 1)), 6))
