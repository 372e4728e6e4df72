"""Streams on a store that holds posts already, their cursors, stop rules and late rows."""

import random

from pyspark.sql import functions as F

from postloom.operators import changelog as c
from postloom.operators import predicates as p
from postloom.streaming import ingest

SCHEMA = "seq bigint, op string, uri string, like_count bigint"


def stream_of(spark, rows, path, batches=1):
    size = -(-len(rows) // batches)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def likes(n):
    return p.engagement(likes=n)


def with_counts(df):
    return df.withColumns({x: F.lit(0) for x in ("repost_count", "reply_count", "quote_count")})


def ingested(spark, rows, root, name, predicate=None, batches=1, **more):
    return ingest.ingest_commits(with_counts(stream_of(spark, rows, f"{root}/{name}", batches)), str(root), predicate, **more)


def logged(spark, root):
    return sorted((r["seq"], r["op"], r["uri"]) for r in ingest.read_log(spark, str(root), SCHEMA).collect())


def test_another_filter_goes_on_from_the_store(spark, tmp_path):
    ingested(spark, [(1, "create", "u1", 5), (2, "create", "u2", 5), (3, "create", "u0", 0)], tmp_path, "a", likes(3)).awaitTermination()
    query = ingested(spark, [(4, "delete", "u1", 0), (5, "create", "u2", 9), (6, "create", "u3", 9), (7, "create", "u0", 9), (8, "update", "u2", 9)], tmp_path, "b", likes(4))
    query.awaitTermination()
    assert logged(spark, tmp_path) == [(1, "U", "u1"), (2, "U", "u2"), (4, "D", "u1"), (6, "U", "u3"), (7, "U", "u0"), (8, "U", "u2")]
    size = ingest.state_size(query)
    assert size["uris"] == 3 and 0 < size["bytes"] / size["uris"]
    # the first filter again: a third run, which knows what the second one did
    ingested(spark, [(9, "create", "u1", 5), (10, "create", "u3", 5), (11, "delete", "u0", 0)], tmp_path, "c", likes(3)).awaitTermination()
    assert logged(spark, tmp_path)[-2:] == [(9, "U", "u1"), (11, "D", "u0")]
    assert {x.partition(".")[0] for x in ingest.folders(spark, f"{tmp_path}/checkpoints")} == {"0", "1", "2"}


def test_runs_and_restarts_against_a_model(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, rng.choice(["create", "update", "delete"]), f"u{rng.randrange(15)}", rng.randrange(10)) for k in range(240)]
    present, want = set(), []
    for part, least in ((rows[:80], 3), (rows[80:160], 6), (rows[160:], 6)):
        for seq, op, uri, n in part:
            if op == "delete":
                if uri in present:
                    present.discard(uri)
                    want.append((seq, "D", uri))
            elif n >= least and (op == "update" or uri not in present):
                present.add(uri)
                want.append((seq, "U", uri))
    ingested(spark, rows[:80], tmp_path, "first", likes(3)).awaitTermination()
    ingested(spark, rows[80:160], tmp_path, "second", likes(6), 2).awaitTermination()
    ingested(spark, rows[160:], tmp_path, "second", likes(6)).awaitTermination()  # the same run goes on with new files
    assert logged(spark, tmp_path) == want
    state = c.replay(ingest.read_log(spark, str(tmp_path), SCHEMA))
    assert {r["uri"] for r in state.collect()} == present


def test_cursor_never_goes_back(spark, tmp_path):
    root = str(tmp_path)
    first = ingest.Cursors(spark, root, "jet", likes(3))
    assert first.cursor is None
    assert ingest.run_until(ingested(spark, [(5, "create", "u1", 5), (9, "create", "u2", 0)], tmp_path, "a", likes(3), 2), cursors=first) == "end"
    assert first.cursor == 9 and first.seen == 2 == ingest.Cursors(spark, root, "jet", likes(3)).cursor - 7
    again = ingest.Cursors(spark, root, "jet", likes(3))
    ingest.run_until(ingested(spark, [(4, "create", "u3", 5)], tmp_path, "a", likes(3)), cursors=again)
    assert again.cursor == 9 == ingest.read_cursor(spark, root, "jet", likes(3))
    assert ingest.read_cursor(spark, root, "jet", likes(4)) is None and ingest.read_cursor(spark, root, "other", likes(3)) is None


def test_stop_rules_and_rejects(spark, tmp_path):
    rows = [(k, "create", f"u{k}", 1) for k in range(30)] + [(90, "twist", "u1", 1), (91, "delete", None, 1)]
    query = ingested(spark, rows, tmp_path, "a", batches=8, trigger={"processingTime": "0 seconds"})
    assert ingest.run_until(query, batches=2, every=0.05) == "batches"
    assert not query.isActive
    query = ingested(spark, rows[:1], tmp_path, "a", trigger={"processingTime": "0 seconds"})  # goes on
    assert ingest.run_until(query, rows=1, seconds=60, every=0.05) in ("rows", "seconds")
    query = ingested(spark, rows[:1], tmp_path, "a", trigger={"processingTime": "0 seconds"})
    assert ingest.run_until(query, seconds=0.1, every=0.05) == "seconds"
    assert ingest.run_until(ingested(spark, rows[:1], tmp_path, "a"), every=0.05) == "end"
    assert [r[0] for r in logged(spark, tmp_path)] == list(range(30))
    assert sorted(r["seq"] for r in spark.read.parquet(f"{tmp_path}/rejects").collect()) == [90, 91]


def timed(spark, rows, path):
    for row in rows:
        spark.createDataFrame([row], "uri string, author string, at string").selectExpr("uri", "author", "cast(at as timestamp) as created_at", "1L as like_count", "0L as repost_count", "0L as reply_count", "0L as quote_count").coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


ROWS = [("a", "x", "2026-01-01 10:05:00"), ("b", "x", "2026-01-01 10:15:00"), ("a", "y", "2026-01-01 10:25:00"), ("c", "y", "2026-01-01 13:00:00"), ("c2", "y", "2026-01-01 13:05:00"), ("d", "z", "2026-01-01 10:30:00"), ("e", "z", "2026-01-01 18:00:00"), ("f", "z", "2026-01-01 18:01:00")]


def written(spark, stream, path):
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out", format="parquet")
    query.awaitTermination()
    return query, spark.read.parquet(f"{path}/out").collect()


def test_late_rows_and_exact_authors(spark, tmp_path):
    query, rows = written(spark, ingest.exact_buckets(timed(spark, ROWS, f"{tmp_path}/in")), tmp_path)
    assert sorted((str(r["start"]), r["posts"], r["authors"], r["engagement"]) for r in rows) == [("2026-01-01 10:00:00", 3, 2, 3), ("2026-01-01 13:00:00", 2, 1, 2)]
    assert ingest.late_rows(query) == 1  # d, after the watermark had passed its hour


def test_first_sight_within_the_watermark(spark, tmp_path):
    _, rows = written(spark, ingest.deduplicated(timed(spark, ROWS, f"{tmp_path}/in")), tmp_path)
    uris = [r["uri"] for r in rows]
    assert uris.count("a") == 1 and {"a", "b", "c", "e", "f"} <= set(uris)
