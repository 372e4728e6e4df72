"""What the plans look like: pruning, pushdown, partial aggregation."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postloom.operators import aggregates as a
from postloom.operators import changelog as c
from postloom.operators import ordering as o
from postloom.operators import predicates as p
from postloom.plans.base import posts
from postloom.sources import store
from postloom.streaming import ingest


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    store.write_posts(posts(spark, sf_dir), path)
    return store.read_posts(spark, path)


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_reach_the_scan(stored):
    wanted = p.date_range(datetime(2024, 1, 3), datetime(2024, 1, 4)) & p.author("u5.test") & p.min_images(1)
    plan = plan_of(stored.where(wanted.condition).select("uri"))
    assert "PartitionFilters: [isnotnull(created_date" in plan and "EqualTo(author,u5.test)" in plan and "GreaterThanOrEqual(image_count,1)" in plan
    read = plan.split("ReadSchema:")[1].split("\n")[0]
    assert "text" not in read and "images" not in read.replace("image_count", "")


def test_top_k_is_not_a_full_sort(stored):
    plan = plan_of(o.by_metric(stored, "engagement").limit(10).select("uri"))
    assert "TakeOrderedAndProject" in plan


def test_counts_combine_before_the_shuffle(stored):
    for df in (a.count_by(stored, "hashtag"), a.author_table(stored), c.replay(stored.withColumns({"op": F.lit("U"), "seq": F.col("event_id")}).select("op", "seq", "uri", "author"))):
        assert "partial_" in plan_of(df)
    assert "Python" not in plan_of(a.buckets(stored, "hour"))


def test_names_follow_the_filter():
    assert ingest.query_name("x", p.author("a")) != ingest.query_name("x", p.author("b"))
    assert ingest.query_name("x", p.author("a")) == ingest.query_name("x", p.author("A"))


def test_bad_commits_are_kept_apart(spark, tmp_path):
    rows = spark.createDataFrame([(1, "create", "at://a", 5), (2, "twist", "at://b", 5), (3, "delete", None, 5)], "seq bigint, op string, uri string, like_count bigint")
    rows.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    ingest.ingest_commits(stream(), f"{tmp_path}/a").awaitTermination()
    assert [r["uri"] for r in c.replay(ingest.read_log(spark, f"{tmp_path}/a", rows.schema)).collect()] == ["at://a"]
    assert spark.read.parquet(f"{tmp_path}/a/rejects").count() == 2
    with pytest.raises(Exception, match="bad commits"):
        ingest.ingest_commits(stream(), f"{tmp_path}/b", most_errors=1).awaitTermination()
