"""What is kept on disk and kept up: the inverted index, current posts by bucket, Bloom filters; lookups as of a time."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postloom.operators import aggregates as a
from postloom.operators import changelog as c
from postloom.operators import predicates as p
from postloom.operators import search as s
from postloom.operators import search_index as si
from postloom.sources import current, store


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


POSTS = "uri string, text string, images array<struct<fullsize:string,thumb:string,alt:string>>"


def some_posts(spark, n=60, seed=1):
    rng = random.Random(seed)
    words = ["red", "green", "blue", "Red", "a", "1", "été", "sky"]
    rows = [(f"at://p/{k}", rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 12))) + "."]), [("f", "t", rng.choice([None, "red sky", "a blue a"]))] * rng.randint(0, 2)) for k in range(n)]
    return spark.createDataFrame(rows, POSTS)


def uris(df):
    return sorted(r["uri"] for r in df.collect())


def ranks(df):
    return {r["uri"]: round(r["rank"], 9) for r in df.collect()}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    posts = some_posts(spark)
    si.add_posts(posts, path, 0)
    return posts, path


def test_index_finds_what_a_scan_finds(spark, index):
    posts, path = index
    for query in ("red", "RED sky", "a", "nothing", "été 1"):
        assert ranks(si.bm25(spark, path, query)) == ranks(s.bm25(posts, query))
    for text in ("red sky", "a a", "a blue a", "blue", "sky red green", "nothing here"):
        for fields in (("text",), ("alt",)):
            assert uris(si.phrase(spark, path, text, fields)) == uris(s.indexed(posts, fields).where(s.matches(phrase=text))), (text, fields)
    want = s.indexed(posts).where(s.matches(["red"], ["sky", "blue"], ["green"]))
    assert uris(si.matching(spark, path, ["red"], ["sky", "blue"], ["green"])) == uris(want)
    with pytest.raises(ValueError):
        si.matching(spark, path, none_of=["red"])
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != "500"


def test_index_reads_the_terms_postings_only(spark, index):
    plan = plan_of(si.bm25(spark, index[1], "red sky"))
    scans = [x for x in plan.split("\n\n") if "Scan parquet" in x and "postings" in x]
    assert scans and all("bucket" in re.search(r"PartitionFilters: (.*)", x)[1] and "In(term, [red,sky])" in re.search(r"PushedFilters: (.*)", x)[1] for x in scans)
    assert "positions" not in "".join(re.findall(r"ReadSchema: (.*)", plan)) and "Python" not in plan


def test_copies_share_their_postings(spark, tmp_path):
    path, n = str(tmp_path), 100
    rows = [(f"at://p/{k}", "red sky" if k else "blue", [("f", "t", "sky a")] if k % 2 else None) for k in range(n)]
    posts = spark.createDataFrame(rows, POSTS)
    si.add_posts(posts, path, 0)
    # blue; red and sky without alt texts; red and sky with two words of an alt text
    assert spark.read.parquet(f"{path}/postings").count() == 1 + 2 + 4 and spark.read.parquet(f"{path}/posts").count() == n
    si.remove_posts(posts.where("uri = 'at://p/2'"), path, 1)
    left = posts.where("uri <> 'at://p/2'")
    assert len(uris(si.matching(spark, path, ["red"]))) == n - 2 and ranks(si.bm25(spark, path, "sky red")) == ranks(s.bm25(left, "sky red"))
    # the same words, dealt to the fields in another way, are another content
    si.add_posts(spark.createDataFrame([("at://q/1", "red", [("f", "t", "sky")]), ("at://q/2", "redsky", None)], POSTS), path, 2)
    assert [u for u in uris(si.phrase(spark, path, "red sky", ("text",))) if "/q/" in u] == [] and "at://q/1" in uris(si.matching(spark, path, ["red", "sky"]))


def test_index_is_kept_up_by_batches(spark, tmp_path):
    posts, path = some_posts(spark, seed=2), str(tmp_path)
    old = posts.where("uri like '%1'").withColumn("text", F.lit("red red sky blue"))
    si.add_posts(old, path, 0)
    si.remove_posts(old, path, 1)
    si.add_posts(posts, path, 2)
    gone = posts.where("uri like '%3'")
    si.remove_posts(gone, path, 3)
    si.remove_posts(gone, path, 3)  # tried again
    left = posts.where("uri not like '%3'")
    for query in ("red", "red sky"):
        assert ranks(si.bm25(spark, path, query)) == ranks(s.bm25(left, query))
    assert uris(si.phrase(spark, path, "red sky", ("alt",))) == uris(s.indexed(left, ("alt",)).where(s.matches(phrase="red sky")))


SCHEMA = "seq bigint, op string, uri string, like_count bigint"


def test_state_is_merged_by_bucket(spark, tmp_path):
    rng, path, seq, want = random.Random(4), str(tmp_path), 0, {}
    for step in range(5):
        rows = []
        for _ in range(40 if step else 120):
            seq += 1
            rows.append((seq, rng.choice("UUD"), f"u{rng.randrange(60)}", seq))
        for number, op, uri, likes in rows:
            want.pop(uri, None)
            if op == "U":
                want[uri] = (number, likes)
        df = spark.createDataFrame(rows, SCHEMA)
        current.merge(spark, path, df, df.schema, 8)
        if step == 2:
            current.merge(spark, path, df, df.schema, 8)  # tried again
            current.clean(spark, path)
        assert {r["uri"]: (r["seq"], r["like_count"]) for r in current.read_state(spark, path, df.schema).collect()} == want
    every = spark.createDataFrame([(seq + k, "D", f"u{k}", 0) for k in range(60)], SCHEMA)
    current.merge(spark, path, every, every.schema, 8)
    assert current.read_state(spark, path, every.schema).count() == 0


def test_one_increment_touches_few_buckets(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(2000).selectExpr("id as seq", "'U' as op", "concat('u', id) as uri", "id as like_count")
    current.merge(spark, path, rows, rows.schema)
    more = spark.createDataFrame([(5000, "U", "u7", 1), (5001, "U", "new", 50)], SCHEMA)
    assert len(current.merge(spark, path, more, rows.schema)) == 2
    assert sorted(current.versions(spark, path).values()).count(1) == 2
    state = spark.createDataFrame([(5000, "U", "u7", 90), (5001, "U", "u9999", 90), (5002, "D", "u8", 0)], SCHEMA).withColumns({x: F.lit(0) for x in ("repost_count", "reply_count", "quote_count")})
    found = c.derive_onto(state, p.engagement(likes=4), "all", path, rows.schema, 4999)
    assert sorted((r["seq"], r["op"]) for r in found.collect()) == [(5001, "U"), (5002, "D")]
    plan = plan_of(current.held(spark, path, state, rows.schema))
    assert "Exchange hashpartitioning(uri" not in plan.split("BroadcastHashJoin")[0].split("Scan parquet")[-1] and "ReadSchema: struct<uri:string>" in plan and "SortMergeJoin" not in plan


def test_lookups_skip_row_groups(spark, tmp_path):
    """Of one file with many row groups, a lookup by uri reads one."""
    rows = spark.range(60_000).selectExpr("concat('at://p/', id) as uri", "concat('a', id % 700) as author", "repeat(md5(cast(id as string)), 4) as text", "timestamp_ntz'2026-01-01 00:00:00' as created_at", "date'2026-01-01' as created_date")
    store.write_posts(rows.coalesce(1), str(tmp_path), row_group=300_000)
    read = store.by_uri(store.read_posts(spark, str(tmp_path)), "at://p/31337")
    assert [r["uri"] for r in read.select("uri").collect()] == ["at://p/31337"]
    read.select("uri", "text").write.format("noop").mode("overwrite").save()
    scanned = scan_rows(spark, read.select("uri", "text"))
    assert 0 < scanned < 60_000 / 4


def scan_rows(spark, df):
    """Rows that the scan of a plan gives on, after skipped row groups."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    stack = [plan]
    while stack:
        node = stack.pop()
        if node.nodeName().startswith("Scan parquet"):
            return node.metrics().get("numOutputRows").get().value()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            stack.append(node.executedPlan())
        stack += [node.children().apply(k) for k in range(node.children().size())]


NOW = datetime(2026, 3, 1, 12)


def test_newest_check_as_of_now(spark):
    hours = lambda n: NOW - timedelta(hours=n)
    rows = [("https://a", 200, hours(5)), ("https://a", 404, hours(1)), ("https://a", 200, hours(-1)), ("https://b", 404, hours(5.5)), ("https://b", 301, hours(0)), ("https://c", 200, hours(6)), ("https://d", 404, hours(2)), ("https://d", 200, hours(2)), ("ftp://e", 200, hours(1))]
    checks = spark.createDataFrame(rows, "url string, status int, checked_at timestamp_ntz")
    posts = spark.createDataFrame([(u, [u]) for u in ("https://a", "https://b", "https://c", "https://d", "ftp://e")] + [("none", [])], "uri string, links array<string>")
    found = lambda **more: {r["uri"]: r["has_valid_links"] for r in p.with_valid_links(posts, checks, now=NOW, **more).collect()}
    assert found() == {"https://a": False, "https://b": True, "https://c": False, "https://d": False, "ftp://e": False, "none": False}
    assert found(on_error="include")["https://c"] and not found(on_error="include")["ftp://e"]
    assert found(age=timedelta(hours=7))["https://c"]
    with pytest.raises(Exception, match="a lookup failed"):
        found(on_error="strict")


def test_newest_topics_as_of_now(spark):
    at = lambda n: NOW - timedelta(minutes=n)
    topics = spark.createDataFrame([("Spark", at(10)), (" #News ", at(3)), ("later", at(-1)), ("old", at(15))], "topic string, checked_at timestamp_ntz")
    posts = spark.createDataFrame([("x",)], "uri string")
    trending = lambda tag, rows=topics, **more: p.with_trending(posts, rows, tag, now=NOW, **more).first()["is_trending"]
    assert trending("#news") and not trending("spark") and not trending("later")
    assert trending("anything", topics.where("topic = 'old'"), on_error="include") and not trending("old", topics.where("topic = 'old'"))


def test_sketches_of_ranges(spark):
    rows = spark.range(20_000).selectExpr("concat('a', id % 3000) as author", "timestamp_ntz'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id % 48 as int)) as created_at", "1L as like_count", "0L as repost_count", "0L as reply_count", "0L as quote_count")
    days = {r["range"]: r for r in a.rolled_up(a.bucket_sketches(rows, "hour"), F.substring("bucket", 1, 10)).collect()}
    assert sum(r["posts"] for r in days.values()) == 20_000 == sum(r["engagement"] for r in days.values())
    exact = {str(r["d"]): r["n"] for r in rows.groupBy(F.to_date("created_at").alias("d")).agg(F.count_distinct("author").alias("n")).collect()}
    assert all(abs(days[d]["authors"] - n) <= 0.05 * n for d, n in exact.items())
