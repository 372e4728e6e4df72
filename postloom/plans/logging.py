"""Registered queries: the change log and derived stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changelog as c
from ..operators import predicates as p
from ..operators.graph import saved
from ..sources import current
from .base import LOG, log, made_before, posts, query
from .streams import new_folder

_MATCH = "list_contains(hashtags, '#click') AND coalesce(like_count, 0) >= 5"
_KINDS = f"""{LOG}, marked AS (SELECT *, op = 'U' AND ({_MATCH}) AS m, sum(CASE WHEN op = 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY uri ORDER BY seq) AS epoch FROM post_log),
ranked AS (SELECT *, sum(CASE WHEN m THEN 1 ELSE 0 END) OVER (PARTITION BY uri, epoch ORDER BY seq) AS r FROM marked),
kinds AS (SELECT *, CASE WHEN op = 'D' THEN 'delete' WHEN m AND r = 1 THEN 'matched' ELSE 'skipped' END AS kind FROM ranked)"""
_STATE = "current AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY seq DESC) AS n FROM post_log) WHERE n = 1 AND op = 'U')"


def _filter():
    return p.hashtag("#click") & p.engagement(likes=5)


def _cut(rows) -> int:
    """A seq about two thirds into the log."""
    return int((rows.agg(F.max("seq")).first()[0] or 0) * 2 // 3)


_CUT = "(SELECT max(seq) * 2 // 3 FROM post_log)"


@query(f"{LOG}, {_STATE} SELECT uri, seq, like_count FROM current")
def l_replay(spark, d):
    return c.replay(log(spark, d)).select("uri", "seq", "like_count")


@query(f"{LOG} SELECT seq, op, uri FROM post_log WHERE seq > {_CUT}")
def l_tail(spark, d):
    rows = log(spark, d)
    return c.tail(rows, _cut(rows)).select("seq", "op", "uri")


@query(f"{LOG} SELECT max(seq) AS last_seq FROM post_log")
def l_last_seq(spark, d):
    return c.last_seq(log(spark, d))


@query(f"""{LOG}, old AS (SELECT DISTINCT uri FROM post_log WHERE seq <= {_CUT})
SELECT uri, min(seq) AS seq, first(like_count ORDER BY seq) AS like_count FROM post_log WHERE op = 'U' AND seq > {_CUT} AND uri NOT IN (SELECT uri FROM old) GROUP BY 1""")
def l_dedupe(spark, d):
    rows = log(spark, d)
    cut = _cut(rows)
    return c.dedupe(rows.where(F.col("seq") <= cut), c.tail(rows, cut).where("op = 'U'")).select("uri", "seq", "like_count")


@query(f"{LOG} SELECT uri, (SELECT max(seq) FROM post_log) + row_number() OVER (ORDER BY created_at, uri) AS seq FROM posts WHERE event_id % 4 = 1")
def l_append(spark, d):
    return c.append(log(spark, d), posts(spark, d).where("event_id % 4 = 1"), ["created_at", "uri"]).select("uri", "seq")


def _commits(spark, d):
    rows = log(spark, d)
    op = F.when(F.col("op") == "D", "delete").when(F.col("seq") % 10 == 3, "update").otherwise("create")
    return rows.withColumn("op", op)


_COMMITS = f"""{LOG}, seen AS (SELECT *, lag(op) OVER (PARTITION BY uri ORDER BY seq) AS b FROM post_log WHERE seq > {_CUT} AND (op = 'D' OR coalesce(like_count, 0) >= 3)),
old AS (SELECT uri FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY seq DESC) AS n FROM post_log WHERE seq <= {_CUT}) WHERE n = 1 AND op = 'U'),
took AS (SELECT seen.seq, seen.op, seen.uri, seen.like_count, CASE WHEN b IS NULL THEN old.uri IS NOT NULL ELSE b = 'U' END AS present FROM seen LEFT JOIN old USING (uri)),
done AS (SELECT * FROM took WHERE seq % 10 = 3 OR CASE WHEN op = 'D' THEN present ELSE NOT present END)"""


@query(f"{_COMMITS} SELECT seq, op, uri FROM done")
def l_commits(spark, d):
    rows = log(spark, d)
    cut = _cut(rows)
    before = c.replay(rows.where(F.col("seq") <= cut))
    return c.applied_commits(before, c.tail(_commits(spark, d), cut), p.engagement(likes=3)).select("seq", "op", "uri")


@query(f"{_KINDS} SELECT seq, op, uri, 'all' AS source_store FROM kinds WHERE kind <> 'skipped'")
def l_derive(spark, d):
    return c.derive(log(spark, d), _filter(), "all").select("seq", "op", "uri", "source_store")


@query(f"{_KINDS} SELECT seq, op, uri FROM kinds WHERE kind <> 'skipped' AND seq > {_CUT}")
def l_derive_incremental(spark, d):
    """The further rows of a derived store whose current posts are on disk, by bucket."""
    rows = _read_often(spark, d)
    path = made_before(spark, d, "derived", derived_state(spark, d, rows))
    return c.derive_onto(rows, _filter(), "all", path, _schema(rows), _cut(rows)).select("seq", "op", "uri")


def _schema(rows):
    return rows.select("seq", "op", "uri", "like_count").schema


def _read_often(spark, d):
    """The log's columns that derivations and their filter read, worked out once: an increment and its merge read its rows several times."""
    return saved(log(spark, d).select("seq", "op", "uri", "hashtags", "like_count"))


def derived_state(spark, d, log_rows=None):
    """Makes the current posts of the store derived from the log's first part."""

    def make(path):
        rows = log(spark, d) if log_rows is None else log_rows
        first = c.derive(rows.where(F.col("seq") <= _cut(rows)), _filter(), "all").select("seq", "op", "uri", "like_count")
        current.merge(spark, path, first, first.schema)

    return make


@query(f"""{_KINDS} SELECT uri, seq, like_count FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY seq DESC) AS last FROM kinds WHERE kind <> 'skipped') WHERE last = 1 AND op = 'U'""")
def l_state_merged(spark, d):
    """A derived store's current posts after three increments, each merged into the buckets that it touches."""
    rows = _read_often(spark, d)
    path, schema, end = new_folder(spark), _schema(rows), int(rows.agg(F.max("seq")).first()[0] or 0)
    for k in range(3):
        part = rows.where(F.col("seq") <= (k + 1) * end // 3) if k < 2 else rows
        more = c.derive_onto(part, _filter(), "all", path, schema, k * end // 3 if k else -1).select(*schema.names)
        current.merge(spark, path, saved(more), schema)
    current.clean(spark, path)
    return current.read_state(spark, path, schema).select("uri", "seq", "like_count")


@query(f"{_KINDS} SELECT count(*) AS processed, count(*) FILTER (kind = 'matched') AS matched, count(*) FILTER (kind = 'skipped') AS skipped, count(*) FILTER (kind = 'delete') AS deletes FROM kinds")
def l_derive_counts(spark, d):
    return c.derive_counts(log(spark, d), _filter())


@query(f"{LOG} SELECT seq, op, uri FROM post_log WHERE op = 'D' OR regexp_matches(text, '(?i)tion') AND op = 'U' AND seq % 10 = 0 OR (op = 'U' AND seq % 10 = 3 AND event_id % 10 = 6 AND regexp_matches(text, '(?i)tion'))")
def l_derive_regex(spark, d):
    return c.derive(log(spark, d), p.regex(["tion"], "i"), "all").select("seq", "op", "uri")


@query(f"{LOG} SELECT seq, op, uri FROM post_log WHERE op = 'D' OR (NOT list_contains(hashtags, '#click') AND (seq % 10 = 0 OR event_id % 10 = 6))")
def l_derive_not(spark, d):
    return c.derive(log(spark, d), ~p.hashtag("#click"), "all").select("seq", "op", "uri")


@query(f"{LOG}, {_STATE} SELECT 'D' AS op, uri, author FROM current WHERE author = 'u3.test'")
def l_prune_author(spark, d):
    return c.prune_author(c.replay(log(spark, d)), "U3.test")


def _stores(spark, d):
    """A store of all posts, one a type made from it, and one of popular posts made from two of these."""
    rows = log(spark, d)
    kinds = rows.select(F.col("event_type").alias("store")).distinct()
    stores = kinds.union(rows.limit(1).select(F.lit("all"))).union(rows.limit(1).select(F.lit("popular")))
    lineage = kinds.select(F.col("store").alias("target"), F.lit("all").alias("source")).union(kinds.where("store in ('click', 'view')").select(F.lit("popular"), "store"))
    last = rows.groupBy(F.col("event_type").alias("store")).agg(F.max("seq").alias("last_seq")).union(rows.agg(F.lit("all"), F.max("seq")))
    points = last.select(F.lit("popular").alias("target"), F.col("store").alias("source"), F.col("last_seq").alias("checkpoint_seq")).where("source = 'click'")
    ends = last.where("store not in ('all', 'error')").select(F.col("store").alias("target"), F.lit("all").alias("source"), F.when(F.col("store") != "view", 10 * F.col("last_seq")).alias("checkpoint_seq"))
    return stores, lineage, points.union(ends).withColumn("has_checkpoint", F.lit(True)), last


_KIND = "kinds AS (SELECT event_type AS store, max(seq) AS last_seq FROM post_log GROUP BY 1)"


@query(f"""{LOG}, {_KIND} SELECT store AS target, 'all' AS source, CASE WHEN store IN ('error', 'view') OR 10 * last_seq < (SELECT max(seq) FROM post_log) THEN 'stale' ELSE 'fresh' END AS state FROM kinds
UNION ALL SELECT 'popular', store, CASE WHEN store = 'click' THEN 'fresh' ELSE 'stale' END FROM kinds WHERE store IN ('click', 'view')""")
def l_staleness(spark, d):
    _, lineage, points, last = _stores(spark, d)
    return c.staleness(lineage, points, last)


@query(f"""{LOG}, {_KIND} SELECT store, CASE WHEN store IN ('error', 'view') OR 10 * last_seq < (SELECT max(seq) FROM post_log) THEN 'stale' ELSE 'ready' END AS status FROM kinds
UNION ALL SELECT 'all', 'source' UNION ALL SELECT 'popular', 'stale'""")
def l_store_status(spark, d):
    stores, lineage, points, last = _stores(spark, d)
    return c.store_status(stores, c.staleness(lineage, points, last))


@query(f"""{LOG}, {_KIND} SELECT store, 1 AS sources, CASE WHEN store IN ('click', 'view') THEN 1 ELSE 0 END AS derived, false AS is_root FROM kinds
UNION ALL SELECT 'all', 0, (SELECT count(*) FROM kinds), true UNION ALL SELECT 'popular', (SELECT count(*) FROM kinds WHERE store IN ('click', 'view')), 0, false""")
def l_topology(spark, d):
    stores, lineage, _, _ = _stores(spark, d)
    return c.topology(stores, lineage)


@query(f"{LOG}, {_KIND} SELECT (SELECT count(*) FROM kinds) + 2 AS stores, 1::BIGINT AS sources, (SELECT count(*) FROM kinds) + 1 AS derived, (SELECT count(*) FROM posts) AS posts")
def a_stores_summary(spark, d):
    stores, lineage, _, _ = _stores(spark, d)
    return c.stores_summary(posts(spark, d), stores, lineage, "uri")


@query(f"{LOG}, {_STATE} SELECT event_type AS store, count(*) AS posts, round(100.0 * count(*) / (SELECT count(*) FROM current), 6) AS percent FROM current GROUP BY 1")
def a_match_rates(spark, d):
    now = c.replay(log(spark, d))
    return c.match_rates(now.count(), now.groupBy(F.col("event_type").alias("store")).agg(F.count("*").alias("posts")))


@query(f"{LOG} SELECT count(*) FILTER (op = 'U' AND seq % 10 = 0) AS added, count(*) FILTER (op = 'D') AS deleted, count(*) FILTER (seq % 10 = 3) AS skipped, 0::BIGINT AS errors FROM post_log")
def a_ingest_fold(spark, d):
    n = lambda x: F.sum(x.cast("bigint"))
    batches = log(spark, d).groupBy(F.floor(F.col("seq") / 1000).alias("batch")).agg(n((F.col("op") == "U") & (F.col("seq") % 10 == 0)).alias("added"), n(F.col("op") == "D").alias("deleted"), n(F.col("seq") % 10 == 3).alias("skipped"), F.lit(0).cast("bigint").alias("errors"))
    return c.fold_results(batches)


@query(f"""{LOG}, {_KIND}, ends AS (SELECT store, last_seq FROM kinds UNION ALL SELECT 'all', (SELECT max(seq) FROM post_log))
SELECT store, CASE WHEN store = 'click' THEN 'current' WHEN store IN ('error', 'all') THEN 'unknown' ELSE 'stale' END AS sync FROM ends UNION ALL SELECT 'popular', 'empty'""")
def l_sync_status(spark, d):
    stores, _, _, last = _stores(spark, d)
    points = last.where("store not in ('error', 'all')").select("store", F.when(F.col("store") == "click", F.col("last_seq")).otherwise(F.col("last_seq") - 1).alias("checkpoint_seq"), F.lit(2).alias("updated_at"))
    return c.sync_status(stores, last, points.union(points.select("store", F.lit(0), F.lit(1))))


@query(f"""{LOG}, {_KIND}, per AS (SELECT event_type AS store, count(*) AS n FROM posts GROUP BY 1)
SELECT kinds.store, CASE WHEN kinds.store IN ('error', 'view') OR 10 * last_seq < (SELECT max(seq) FROM post_log) THEN 'stale' ELSE 'ready' END AS status, coalesce(n, 0) AS posts FROM kinds LEFT JOIN per USING (store)
UNION ALL SELECT 'all', 'source', (SELECT count(*) FROM posts) UNION ALL SELECT 'popular', 'stale', 0""")
def l_store_table(spark, d):
    stores, lineage, points, last = _stores(spark, d)
    status = c.store_status(stores, c.staleness(lineage, points, last))
    p = posts(spark, d)
    return c.store_table(stores, status, p.select(F.col("event_type").alias("store")).union(p.select(F.lit("all"))))


@query(f"{LOG}, {_KIND} SELECT 'all' AS source, store AS target FROM kinds UNION ALL SELECT store, 'popular' FROM kinds WHERE store IN ('click', 'view')")
def l_topology_edges(spark, d):
    return c.topology_edges(_stores(spark, d)[1])


@query(f"{LOG}, {_STATE} SELECT uri, seq, like_count FROM current")
def l_refresh(spark, d):
    """Upserts logged after the rest of the log, and replayed."""
    rows = log(spark, d)
    again = rows.where("op = 'U' and seq % 10 = 3")
    return c.replay(c.refresh(rows.where("op = 'D' or seq % 10 <> 3"), again)).select("uri", "seq", "like_count")
