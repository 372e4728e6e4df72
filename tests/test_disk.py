"""What goes to disk is small beside what it is made from, and says the same."""

import random
import re

import pytest
from pyspark.sql import functions as F

from postloom.operators import predicates as p
from postloom.operators import search_index as si
from postloom.plans import QUERIES, base
from postloom.streaming import ingest


def moved(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    return [re.findall(r"([A-Za-z_]\w*)#", x) for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]


def test_packed_postings_say_the_same(spark):
    """Numbers far apart and out of order, long texts, and words of both fields."""
    rng = random.Random(3)
    words = ["a", "b", "sky", "été", "1"] + [f"w{k}" for k in range(300)]
    some = [(rng.randrange(4) << 33 | k, rng.choices(words, k=rng.choice([0, 1, 7, 400])), rng.choices(words[:5], k=rng.choice([0, 0, 2])), 1) for k in range(300)]
    some += [(7 << 40, ["x"] * 20_000 + ["sky"] + ["a"] * 3, [], 1), ((7 << 40) + 1, [], [], 1)]
    contents = spark.createDataFrame(some, "doc bigint, text array<string>, alt array<string>, posts bigint").coalesce(2)
    got = si.postings_of(si.blocks_of(si.packed_of(contents))).withColumn("right", F.col("bucket") == si.bucket_of(F.col("term"))).collect()
    want = set()
    for doc, text, alt, _ in some:
        for field, found in (("text", text), ("alt", alt)):
            for term in set(found):
                places = tuple(k for k, w in enumerate(found) if w == term)
                want.add((term, field, doc, len(places), places, len(text) + len(alt)))
    assert all(r["right"] for r in got) and len(got) == len(want)
    assert {(r["term"], r["field"], r["doc"], r["f"], tuple(r["positions"]), r["n"]) for r in got} == want
    assert si.postings_of(si.blocks_of(si.packed_of(contents.where("size(text) + size(alt) = 0")))).count() == 0


def test_no_posting_is_shuffled_as_a_row(spark, sf_dir, tmp_path, monkeypatch):
    """Postings move packed, less than a byte for each byte of text, and carry no content's name of many bytes."""
    found, kept = {}, si._append
    monkeypatch.setattr(si, "_append", lambda rows, path, *more: (found.setdefault(path.rsplit("/", 1)[1], rows), kept(rows, path, *more)))
    posts = base.made_posts(spark, sf_dir).where("event_id < 300")
    si.add_posts(posts, str(tmp_path), 0)
    assert moved(found["postings"]) == [["bucket", "blocks"]]
    contents = spark.read.parquet(f"{tmp_path}/contents")
    packed = si.packed_of(contents).agg(F.sum(F.length("blocks"))).first()[0]
    assert packed < contents.agg(F.sum(F.length(F.concat_ws(" ", "text", "alt")))).first()[0]
    assert dict(spark.read.parquet(f"{tmp_path}/postings").dtypes)["doc"] == "bigint"


def test_texts_are_not_shuffled_where_posts_are_dealt_by_document(spark, sf_dir, tmp_path):
    """The documents themselves move, no content does; copies of a text in other documents are contents of their own."""
    posts = base.made_posts(spark, sf_dir, "doc").where("event_id < 400")
    assert not [x for x in moved(si.contents_of(posts, within=("doc",))) if "text" in x]
    si.add_posts(posts, f"{tmp_path}/a", 0, within=("doc",))
    si.add_posts(posts, f"{tmp_path}/b", 0)
    ranks = [{(r["uri"], round(r["rank"], 9)) for r in si.bm25(spark, f"{tmp_path}/{x}", "the view").collect()} for x in "ab"]
    assert ranks[0] and ranks[0] == ranks[1]
    same = posts.withColumns({"text": F.lit("red sky"), "images": F.lit(None).cast(posts.schema["images"].dataType)})
    si.add_posts(same, f"{tmp_path}/c", 0, within=("doc",))
    assert si.phrase(spark, f"{tmp_path}/c", "red sky").count() == same.count()


def test_a_search_of_one_field_indexes_that_field(spark, sf_dir, monkeypatch):
    made, kept = [], si.add_posts
    monkeypatch.setattr(si, "add_posts", lambda posts, path, *more, **named: (made.append(path), kept(posts, path, *more, **named)))
    for name, field, other in (("t_alt_only", "alt", "text"), ("t_phrase", "text", "alt"), ("t_boolean_index", "text", "alt")):
        assert QUERIES[name](spark, sf_dir).count() > 0
        contents = spark.read.parquet(f"{made[-1]}/contents")
        assert contents.where(F.size(other) > 0).isEmpty() and not contents.where(F.size(field) > 0).isEmpty()


def test_a_streams_uris_share_keys(spark, tmp_path):
    """Spark makes a batch of its own of what a key yields: many uris share one, and each present uri is an entry of a map."""
    rows = spark.createDataFrame([(k, "create", f"u{k}", k) for k in range(6000)] + [(6000 + k, "delete", f"u{k}", k) for k in range(500)], "seq bigint, op string, uri string, like_count bigint")
    for likes, part in enumerate(("seq < 4000", "seq >= 4000")):
        rows.where(part).coalesce(1).write.parquet(f"{tmp_path}/in{likes}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in{likes}").withColumns({x: F.lit(0) for x in ("repost_count", "reply_count", "quote_count")})
        query = ingest.ingest_commits(stream, f"{tmp_path}/store", p.engagement(likes=likes))
        query.awaitTermination()
    assert ingest.state_size(query)["uris"] == 5500  # the second run took over what the first had stored
    logged = ingest.read_log(spark, f"{tmp_path}/store", rows.schema).groupBy("op").count().collect()
    assert {r["op"]: r["count"] for r in logged} == {"U": 6000, "D": 500}
    assert query.lastProgress["stateOperators"][0]["customMetrics"]["numMapStateVars"] > 0


@pytest.mark.parametrize("documents,a_task", [(1, 700), (3, 700), (3, 20_000), (499, 700), (700, 20_000), (1777, 700), (5000, 20_000)])
def test_blocks_of_posts_lie_in_one_task(spark, tmp_path, monkeypatch, documents, a_task):
    """Whatever the number of documents: the posts are the same, a block is in one task, and no exchange moves a post's text."""
    monkeypatch.setattr(base, "POSTS_A_TASK", a_task)
    spark.range(4000).selectExpr("id as event_id", "timestamp'2024-01-01' as ts", "id % 7 as user_id", "'view' as event_type", "1.5D as value").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(documents).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang", "'web' as source").write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["event_id", "text", "uri", "reply_parent_uri", "quote_uri", "langs"]
    want = base.made_posts(spark, str(tmp_path)).select(columns)
    with base.dealt_once(spark):
        made = base.made_posts(spark, str(tmp_path), block=500).select(*columns, F.floor(F.col("event_id") / 500).alias("k"), F.spark_partition_id().alias("task")).persist()
        assert made.count() == 4000
        assert [x for x in moved(base.made_posts(spark, str(tmp_path), block=500).select("event_id", "text")) if {"body", "text"} & set(x)] == [["doc", "body", "near", "share"]]
    assert made.select(columns).exceptAll(want).isEmpty() and made.select("k", "task").distinct().count() == 8
    made.unpersist()
