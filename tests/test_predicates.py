from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postloom.operators import ordering as o
from postloom.operators import predicates as p
from postloom.operators import projection as j
from postloom.plans.base import posts


@pytest.fixture(scope="module")
def some(spark, sf_dir):
    return posts(spark, sf_dir).limit(300).cache()


def test_arguments_are_checked(spark):
    for wrong in (lambda: p.author_in([]), lambda: p.hashtag_in([]), lambda: p.regex(["("]), lambda: p.regex([]), lambda: p.min_images(0), lambda: p.engagement(), lambda: p.engagement(likes=-1), lambda: p.language([]),
                  lambda: p.date_range(datetime(2024, 1, 2), datetime(2024, 1, 1)), lambda: p.duration("3 days"), lambda: p.regex(["a"], "q"), lambda: p.named({}, "@x")):
        with pytest.raises(ValueError):
            wrong()


def test_signature_is_stable():
    assert p.author_in(["b", "a"]).signature() == p.author_in(["a", "b", "a"]).signature()
    assert (p.author("a") & p.is_reply()).signature() != (p.is_reply() & p.author("a")).signature()


def test_laws(some):
    a, b = p.hashtag("#click"), p.engagement(likes=10)
    count = lambda x: some.where(x.condition).count()
    assert count(p.all_of()) == some.count() and count(p.any_of()) == 0
    assert count(a) + count(~a) == some.count()
    assert count(~(a & b)) == count(~a | ~b) and count(~(a | b)) == count(~a & ~b)
    assert count(p.all_of(a, b)) == count(a & b)


def test_null_is_false(spark):
    rows = spark.createDataFrame([("x", None, None), ("y", "a", 5)], "uri string, text string, like_count int").withColumns({"repost_count": F.lit(None).cast("int")})
    assert rows.where((~p.contains("a")).condition).count() == 1
    assert rows.where(p.engagement(likes=0, reposts=0).condition).count() == 2


def test_end_of_text_is_not_before_a_newline(spark):
    rows = spark.createDataFrame([("end",), ("end\n",)], "text string")
    assert rows.where(p.regex(["end$"]).condition).count() == 1
    assert rows.where(p.regex(["end$"], "m").condition).count() == 2


def test_lookup_policies(spark):
    rows = spark.createDataFrame([("a", ["http://x/"]), ("b", ["http://y/"]), ("c", [])], "uri string, links array<string>")
    status = spark.createDataFrame([("http://x/", 200)], "url string, status int")
    valid = lambda policy: {r["uri"] for r in p.with_valid_links(rows, status, on_error=policy).where("has_valid_links").collect()}
    assert valid("exclude") == {"a"} and valid("include") == {"a", "b"}
    with pytest.raises(Exception, match="lookup failed"):
        valid("strict")


def test_projection(some):
    assert j.fields("uri,@minimal") == ["uri", "author", "text", "created_at", "embed_summary"]
    assert j.project(some, ["images.*.alt", "images.*.thumb"]).schema["images"].dataType.elementType.names == ["alt", "thumb"]
    for wrong in (["*.x"], ["images.*.*"], ["nothing"], ["images.alt"], ["uri.x"], ["images.*.nothing"]):
        with pytest.raises(ValueError):
            j.project(some, wrong)
    with pytest.raises(ValueError):
        j.fields("@full,uri")


def test_pages_cover_all(some):
    whole = [r["uri"] for r in o.by_metric(some, "likes").collect()]
    seen, last = [], None
    while True:
        page = (o.by_metric(some, "likes").limit(70) if last is None else o.page_after(some, "likes", last, 70)).select("uri", F.coalesce("like_count", F.lit(0)).alias("m"), "created_at").collect()
        if not page:
            break
        seen += [r["uri"] for r in page]
        last = (page[-1]["m"], page[-1]["created_at"], page[-1]["uri"])
    assert seen == whole
