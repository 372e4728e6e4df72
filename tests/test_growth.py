"""What moves between tasks and goes to disk does not carry more than a query needs."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postloom.functions.text import tokens
from postloom.operators import changelog as c
from postloom.operators import predicates as p
from postloom.operators import search_index as si
from postloom.plans import QUERIES
from postloom.plans.base import log, made_posts
from postloom.sources import ndjson
from postloom.streaming import ingest


@pytest.fixture
def no_broadcast(spark):
    """Joins as they are with tables too large to be broadcast."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in names}
    for k in names:
        spark.conf.set(k, "-1")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def moved(df):
    """The columns that each exchange of a plan moves."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(mode)
    return [re.findall(r"([A-Za-z_]\w*)#", x) for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)]


def test_no_join_carries_the_posts_texts(spark, sf_dir, no_broadcast):
    found = [x for x in moved(made_posts(spark, sf_dir)) if {"body", "text"} & set(x)]
    assert found == [["doc", "body", "lang", "source"]]  # the documents themselves


def test_posts_are_not_broadcast_to_the_texts(spark, sf_dir):
    """Small tables too: the tasks that read the texts are few, those that they are dealt to are many."""
    plan = made_posts(spark, sf_dir).select("uri", "text")._jdf.queryExecution().executedPlan().toString()
    first = next(x for x in plan.split("\n") if "Join" in x)
    assert "SortMergeJoin [doc#" in first


def test_a_text_is_cut_into_words_once_a_batch(spark, tmp_path, monkeypatch):
    """Postings, terms and totals come from the words that are written."""
    posts = spark.createDataFrame([("at://p/1", "Red sky, red", [("f", "t", "A sky")]), ("at://p/2", None, None)], "uri string, text string, images array<struct<fullsize:string,thumb:string,alt:string>>")
    made = []
    monkeypatch.setattr(si, "tokens", lambda text: made.append(1) or tokens(text))
    si.add_posts(posts, str(tmp_path), 0)
    assert len(made) == 2  # a text and its alt texts
    held = spark.read.parquet(f"{tmp_path}/postings").select("field", "term", "f", "positions", "n").collect()
    assert sorted(map(tuple, held)) == [("alt", "a", 1, [0], 5), ("alt", "sky", 1, [1], 5), ("text", "red", 2, [0, 2], 5), ("text", "sky", 1, [1], 5)]
    assert spark.read.parquet(f"{tmp_path}/totals").select("docs", "length").first()[:] == (2, 5)
    schema = spark.read.parquet(f"{tmp_path}/contents").schema
    assert schema["text"].dataType.simpleString() == schema["alt"].dataType.simpleString() == "array<string>"


@pytest.mark.parametrize("name", ["n_rejects", "n_embed_summary", "n_links", "n_alt_text", "n_hashtags", "n_metrics", "n_mentions", "n_decoded", "l_ingest", "l_commits"])
def test_lines_and_commits_carry_no_text_but_the_documents_own(spark, sf_dir, no_broadcast, name):
    """A line is made and parsed where its post is: no exchange moves it."""
    assert not [x for x in moved(QUERIES[name](spark, sf_dir)) if {"body", "text", "line", "parsed"} & set(x) and set(x) - {"doc", "body", "lang", "source"}]


def test_replay_moves_the_columns_that_are_read(spark, sf_dir):
    found = [x for x in moved(c.replay(log(spark, sf_dir)).select("uri", "seq", "like_count")) if "uri" in x]
    assert found and not any({"text", "hashtags", "author"} & set(x) for x in found)
    new = c.dedupe(spark.createDataFrame([("a",)], "uri string"), log(spark, sf_dir).where("op = 'U'")).select("uri", "seq")
    assert not any("text" in x for x in moved(new))


@pytest.mark.parametrize("name", ["l_state_merged", "l_derive_incremental"])
def test_increments_work_the_log_out_once(spark, sf_dir, monkeypatch, name):
    rows, seen = log(spark, sf_dir).select("seq", "op", "uri", "hashtags", "like_count"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr("postloom.plans.logging.log", lambda *_: rows.mapInArrow(counted, rows.schema))
    assert QUERIES[name](spark, sf_dir).count() > 0
    assert seen.value <= 2 * rows.count()  # a checkpoint counts its rows, then writes them


def test_replay_keeps_nulls_of_the_last_row(spark):
    rows = spark.createDataFrame([(1, "U", "a", "old", 1), (3, "U", "a", None, None), (2, "D", "a", "x", 2), (4, "U", "b", "y", 3), (5, "D", "b", None, None), (6, None, "c", "z", 1)], "seq bigint, op string, uri string, text string, likes int")
    out = c.replay(rows)
    assert out.columns == ["uri", "seq", "text", "likes"] and [tuple(r) for r in out.collect()] == [("a", 3, None, None)]
    first = c.dedupe(spark.createDataFrame([("b",)], "uri string"), rows.where("op = 'U'"))
    assert [tuple(r) for r in first.collect()] == [("a", 1, "U", "old", 1)]


def test_a_store_made_for_a_search_holds_what_it_asks_for(spark, sf_dir):
    for name in ("s_stored_range", "s_by_date"):
        held = spark.read.parquet(*QUERIES[name](spark, sf_dir).inputFiles()).columns
        assert {"uri", "author", "created_at"} <= set(held) and "text" not in held


def test_whole_texts_are_written_compressed(spark, sf_dir, tmp_path):
    some = made_posts(spark, sf_dir).where("event_id < 200")
    ndjson.materialize(some, {"all": p.everything(), "replies": p.is_reply()}, str(tmp_path), datetime(2026, 1, 1))
    files = [x for x in tmp_path.glob("json/filter=*/*") if not x.name.startswith(".")]
    assert files and all(x.name.endswith(".json.gz") for x in files)
    assert sum(x.stat().st_size for x in files) < some.agg(F.sum(F.octet_length("text"))).first()[0]
    again = spark.read.schema("uri string, text string, filter string").json(f"{tmp_path}/json").where("filter = 'all'").select("uri", "text")
    assert again.exceptAll(some.select("uri", "text")).isEmpty() and again.count() == some.count()


def test_a_streams_state_has_few_partitions(spark, tmp_path):
    """Two a core, not as many as a shuffle has; a batch waits for each of them."""
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        rows = spark.createDataFrame([(k, "create", f"u{k}", k) for k in range(40)], "seq bigint, op string, uri string, like_count bigint")
        rows.coalesce(1).write.parquet(f"{tmp_path}/in")
        query = ingest.ingest_commits(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/store")
        query.awaitTermination()
        state = query.lastProgress["stateOperators"][0]
        assert state["numShufflePartitions"] == 2 * spark.sparkContext.defaultParallelism < 50 and state["numRowsTotal"] == 40
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
