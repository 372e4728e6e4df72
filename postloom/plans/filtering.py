"""Registered queries: predicates, projection, order and limits."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import iso, score
from ..operators import ordering as o
from ..operators import predicates as p
from ..operators import projection as j
from .base import IMAGES, POSTS, posts, query, table


def _uris(spark, d, predicate):
    return posts(spark, d).where(predicate.condition).select("uri")


def _where(condition: str) -> str:
    return f"{POSTS} SELECT uri FROM posts WHERE {condition}"


def _register(name: str, make, condition: str) -> None:
    def run(spark, d):
        return _uris(spark, d, make())

    run.__name__ = name
    run.__doc__ = f"Posts where {condition}"
    query(_where(condition))(run)


_JAN = (datetime(2024, 1, 1, 6), datetime(2024, 1, 9, 18, 30))
_RANGE = "created_at BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-09 18:30:00'"
_LIBRARY = {"popular": p.engagement(likes=20, reposts=3), "shown": p.any_of(p.has_images(), p.has_video())}

for _name, _make, _condition in [
    ("p_all", p.everything, "true"),
    ("p_none", p.nothing, "false"),
    ("p_author", lambda: p.author("U7.test"), "author = 'u7.test'"),
    ("p_author_in", lambda: p.author_in(["u7.test", "u8.test", "u9.test"]), "author IN ('u7.test', 'u8.test', 'u9.test')"),
    ("p_hashtag", lambda: p.hashtag("#click"), "list_contains(hashtags, '#click')"),
    ("p_hashtag_in", lambda: p.hashtag_in(["#error", "#src3"]), "list_has_any(hashtags, ['#error', '#src3'])"),
    ("p_contains", lambda: p.contains("THE "), "contains(lower(text), 'the ')"),
    ("p_contains_cs", lambda: p.contains("The", case_sensitive=True), "contains(text, 'The')"),
    ("p_regex", lambda: p.regex(["TION[ .]", "#view$"], "i"), r"regexp_matches(text, '(?i)TION[ .]') OR regexp_matches(text, '(?i)#view\z')"),
    ("p_language", lambda: p.language(["DE", "fr "]), "list_has_any(langs, ['de', 'fr'])"),
    ("p_date_range", lambda: p.date_range(*_JAN), _RANGE),
    ("p_since", lambda: p.since("7d", datetime(2024, 1, 15)), "created_at BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-15'"),
    ("p_until", lambda: p.until("36h", datetime(2024, 1, 10)), "created_at <= TIMESTAMP '2024-01-08 12:00:00'"),
    ("p_is_reply", p.is_reply, "is_reply"),
    ("p_is_quote", p.is_quote, "is_quote"),
    ("p_is_repost", p.is_repost, "is_repost"),
    ("p_is_original", p.is_original, "is_original"),
    ("p_engagement", lambda: p.engagement(likes=20, reposts=4, replies=1), "coalesce(like_count, 0) >= 20 AND repost_count >= 4 AND reply_count >= 1"),
    ("p_images", p.has_images, "has_images"),
    ("p_min_images", lambda: p.min_images(2), "image_count >= 2"),
    ("p_has_alt_text", p.has_alt_text, "has_alt_text"),
    ("p_no_alt_text", p.no_alt_text, "image_count > 0 AND NOT has_alt_text"),
    ("p_video", p.has_video, "has_video"),
    ("p_links", p.has_links, "has_links"),
    ("p_link_contains", lambda: p.link_contains("HOST2.example"), "len(list_filter(list_concat(links, [external_link]), lambda u: contains(lower(u), 'host2.example'))) > 0"),
    ("p_link_regex", lambda: p.link_regex(r"host[34]\.|^https://card.*[05]$"), r"len(list_filter(list_concat(links, [external_link]), lambda u: regexp_matches(u, 'host[34]\.|^https://card.*[05]$'))) > 0"),
    ("p_card_link", lambda: p.link_contains("Card.example"), "external_link IS NOT NULL"),
    ("p_media", p.has_media, "has_media"),
    ("p_embed", p.has_embed, "has_embed"),
    ("p_and_or_not", lambda: (p.hashtag("#click") & ~p.is_reply()) | (p.engagement(likes=40) & p.language(["en"])), "(list_contains(hashtags, '#click') AND NOT is_reply) OR (coalesce(like_count, 0) >= 40 AND list_contains(langs, 'en'))"),
    ("p_not_language", lambda: ~p.language(["en"]), "NOT list_contains(langs, 'en')"),
    ("p_not_engagement", lambda: ~p.engagement(likes=10), "NOT coalesce(like_count, 0) >= 10"),
    ("p_named", lambda: p.named(_LIBRARY, "@popular") & ~p.named(_LIBRARY, "shown"), "coalesce(like_count, 0) >= 20 AND repost_count >= 3 AND NOT (has_images OR has_video)"),
    ("p_for_authors", lambda: p.for_authors(p.has_media(), ["u1.test", "u2.test", "u3.test"], ["u3.test"]), "has_media AND author IN ('u1.test', 'u2.test')"),
]:
    _register(_name, _make, _condition)


@query(f"{IMAGES} SELECT DISTINCT uri FROM images WHERE contains(lower(alt), 'of view')")
def p_alt_text(spark, d):
    return _uris(spark, d, p.alt_text("Of View"))


@query(rf"{IMAGES} SELECT DISTINCT uri FROM images WHERE regexp_matches(alt, '^photo [12]')")
def p_alt_regex(spark, d):
    return _uris(spark, d, p.alt_text_regex("^photo [12]"))


def _status(spark, d):
    """Answers of hosts 0, 1 and 2 for every link in the table; hosts 3 and 4 were never asked."""
    link = posts(spark, d).select(F.explode("links").alias("url")).distinct()
    n = F.regexp_extract("url", r"//host(\d)", 1).cast("int")
    return link.select("url", F.when(n < 2, 200).when(n == 2, 404).alias("status")).where("status is not null")


@query(f"{POSTS} SELECT uri, len(links) > 0 AND event_id // 20 % 5 < 2 AS has_valid_links FROM posts")
def p_valid_links(spark, d):
    return p.with_valid_links(posts(spark, d), _status(spark, d)).select("uri", "has_valid_links")


@query(f"{POSTS} SELECT uri FROM posts WHERE len(links) > 0 AND event_id // 20 % 5 <> 2")
def p_valid_links_include(spark, d):
    return p.with_valid_links(posts(spark, d), _status(spark, d), on_error="include").where("has_valid_links").select("uri")


_NOW = datetime(2024, 1, 10, 12)


def _checks(spark, d):
    """Several checks of every link: an old one 200, a newer one by the host's number, one from the future, and stale ones alone for host 4."""
    link = posts(spark, d).select(F.explode("links").alias("url")).distinct().withColumn("n", F.regexp_extract("url", r"//host(\d)", 1).cast("int"))
    ago = lambda hours, status: F.struct(F.lit(hours).cast("double").alias("hours"), F.lit(status).alias("status"))
    newer = F.when(F.col("n") == 0, F.array(ago(5, 404), ago(1, 200))).when(F.col("n") == 1, F.array(ago(5, 200), ago(1, 404))).when(F.col("n") == 2, F.array(ago(5.9, 302), ago(-1, 500))).when(F.col("n") == 3, F.array(ago(6, 200), ago(-1, 200))).otherwise(F.array(ago(30, 200)))
    checks = link.select("url", F.explode(newer).alias("c"))
    at = F.lit(str(_NOW)).cast("timestamp_ntz") - F.make_dt_interval(secs=(F.col("c.hours") * 3600).cast("decimal(18,6)"))
    return checks.select("url", F.col("c.status").alias("status"), at.alias("checked_at"))


@query(f"{POSTS} SELECT uri, len(links) > 0 AND event_id // 20 % 5 IN (0, 2) AS has_valid_links FROM posts")
def p_valid_links_as_of(spark, d):
    """Only the newest check of a link counts, if it is younger than six hours."""
    return p.with_valid_links(posts(spark, d), _checks(spark, d), now=_NOW).select("uri", "has_valid_links")


@query(f"{POSTS} SELECT uri FROM posts WHERE len(links) > 0 AND event_id // 20 % 5 <> 1")
def p_valid_links_as_of_include(spark, d):
    return p.with_valid_links(posts(spark, d), _checks(spark, d), on_error="include", now=_NOW).where("has_valid_links").select("uri")


@query(f"""{POSTS}, topics AS (SELECT event_type AS topic, row_number() OVER (ORDER BY sum(score) DESC, event_type) AS n FROM posts GROUP BY event_type)
SELECT uri, (SELECT count(*) FROM topics WHERE n > 2 AND topic = 'view') > 0 AS is_trending FROM posts""")
def p_trending_as_of(spark, d):
    """Two lists of topics are fresh, a newer one is from the future; the newest fresh one has all but the two most popular."""
    all_ = posts(spark, d)
    ranked = all_.groupBy(F.col("event_type").alias("topic")).agg(F.sum(score()).alias("s")).withColumn("n", F.row_number().over(Window.orderBy(F.desc("s"), "topic")))  # a row a type
    lists = lambda condition, minutes: ranked.where(condition).select(F.concat(F.lit(" #"), F.upper("topic")).alias("topic"), F.lit(str(_NOW - timedelta(minutes=minutes))).cast("timestamp_ntz").alias("checked_at"))
    return p.with_trending(all_, lists("n <= 2", 9).union(lists("n > 2", 4)).union(lists("n > 0", -1)), "#View", now=_NOW).select("uri", "is_trending")


@query(f"""{POSTS}, topics AS (SELECT event_type AS topic FROM posts GROUP BY event_type ORDER BY sum(score) DESC, event_type LIMIT 2)
SELECT uri, (SELECT count(*) FROM topics WHERE topic = 'view') > 0 AS is_trending FROM posts""")
def p_trending(spark, d):
    all_ = posts(spark, d)
    topics = all_.groupBy(F.col("event_type").alias("topic")).agg(F.sum(score()).alias("s")).orderBy(F.desc("s"), "topic").limit(2)
    return p.with_trending(all_, topics, "#View").select("uri", "is_trending")


@query(f"""{POSTS} SELECT uri, f AS filter FROM posts, unnest(list_filter([CASE WHEN coalesce(like_count, 0) >= 20 AND repost_count >= 3 THEN 'popular' END, CASE WHEN is_reply THEN 'reply' END, CASE WHEN has_images OR has_video THEN 'shown' END], lambda x: x IS NOT NULL)) AS t(f)""")
def p_multi_filter(spark, d):
    return p.tag_matches(posts(spark, d), {**_LIBRARY, "reply": p.is_reply()}).select("uri", "filter")


@query(f"""{POSTS}, n AS (SELECT uri, is_reply AS a, coalesce(like_count, 0) >= 20 AS b, has_media AS c FROM posts)
SELECT uri, '0' AS path, 'Or' AS kind, (a AND b) OR c AS ok, false AS skipped FROM n
UNION ALL SELECT uri, '0.0', 'And', a AND b, false FROM n UNION ALL SELECT uri, '0.0.0', 'IsReply', a, false FROM n
UNION ALL SELECT uri, '0.0.1', 'Engagement', CASE WHEN a THEN b END, NOT a FROM n
UNION ALL SELECT uri, '0.1', 'HasMedia', CASE WHEN NOT (a AND b) THEN c END, a AND b FROM n""")
def p_explain(spark, d):
    return p.explain(posts(spark, d), (p.is_reply() & p.engagement(likes=20)) | p.has_media())


@query(f"""{POSTS} SELECT count(*) AS processed, sum(CASE WHEN has_images THEN 1 ELSE 0 END)::BIGINT AS matched, round(100.0 * sum(CASE WHEN has_images THEN 1 ELSE 0 END) / greatest(count(*), 1), 6) AS percent
FROM (SELECT * FROM posts ORDER BY created_at DESC, uri DESC LIMIT 1000)""")
def p_match_rate(spark, d):
    return p.match_rate(posts(spark, d), p.has_images())


@query(f"{POSTS} SELECT uri, author, text, iso AS created_at, embed_type FROM posts")
def j_minimal(spark, d):
    return j.project(posts(spark, d), j.preset("minimal")).select("uri", "author", "text", iso(F.col("created_at")).alias("created_at"), F.col("embed_summary.type").alias("embed_type"))


@query(f"{POSTS} SELECT uri, author, text, like_count, repost_count, reply_count, quote_count, array_to_string(hashtags, '|') AS hashtags, embed_type, external_link AS card, quote_uri AS record FROM posts")
def j_social(spark, d):
    """The summary is made when projecting."""
    shown = j.project(posts(spark, d).drop("embed_summary"), j.fields("@social"))
    summary = [F.col(f"embed_summary.{a}").alias(b) for a, b in (("type", "embed_type"), ("external_uri", "card"), ("record_uri", "record"))]
    return shown.select("uri", "author", "text", "like_count", "repost_count", "reply_count", "quote_count", F.array_join("hashtags", "|").alias("hashtags"), *summary)


@query(f"{POSTS} SELECT uri, author, text, iso AS created_at, image_count::INT AS images, has_alt_text AS all_alt, CASE WHEN has_images THEN 'https://img.example/' || event_id || '/0/thumb' END AS first_thumb FROM posts")
def j_media(spark, d):
    shown = j.project(posts(spark, d), j.fields("@media"))
    return shown.select("uri", "author", "text", iso(F.col("created_at")).alias("created_at"), F.size("images").alias("images"), F.coalesce("embed_summary.all_alt", F.lit(False)).alias("all_alt"), F.col("embed_summary.first_thumb").alias("first_thumb"))


@query(f"{POSTS} SELECT uri, author, text, iso AS created_at, image_count::INT AS images FROM posts")
def j_images(spark, d):
    return j.project(posts(spark, d), j.fields("@images")).select("uri", "author", "text", iso(F.col("created_at")).alias("created_at"), F.size("images").alias("images"))


@query(f"{POSTS} SELECT uri, author, text, iso AS created_at, embed_type, quote_author_did AS record_author FROM posts")
def j_embeds(spark, d):
    shown = j.project(posts(spark, d), j.fields("@embeds"))
    return shown.select("uri", "author", "text", iso(F.col("created_at")).alias("created_at"), F.col("embed_summary.type").alias("embed_type"), F.col("embed_summary.record_author").alias("record_author"))


@query(f"""{IMAGES}, firsts AS (SELECT uri, string_agg(coalesce(alt, '-'), '|' ORDER BY i) AS alts, string_agg(fullsize, '|' ORDER BY i) AS urls FROM images GROUP BY uri)
SELECT uri, author AS by_handle, alts, urls FROM posts JOIN firsts USING (uri)""")
def j_nested(spark, d):
    shown = j.project(posts(spark, d).where("has_images"), ["uri", "author", "images.*.alt", "images.*.fullsize"])
    return shown.select("uri", F.col("author").alias("by_handle"), F.concat_ws("|", F.transform("images", lambda i: F.coalesce(i["alt"], F.lit("-")))).alias("alts"), F.concat_ws("|", F.transform("images", lambda i: i["fullsize"])).alias("urls"))


@query(f"{IMAGES} SELECT uri, author, fullsize, thumb, alt FROM images")
def j_extract_images(spark, d):
    return j.images(posts(spark, d))


@query(f"{POSTS} SELECT uri, iso AS created FROM posts ORDER BY created_at, uri LIMIT 50")
def o_time(spark, d):
    return o.by_time(posts(spark, d)).limit(50).select("uri", iso(F.col("created_at")).alias("created"))


@query(f"{POSTS} SELECT uri, coalesce(like_count, 0) AS likes FROM posts ORDER BY coalesce(like_count, 0) DESC, created_at DESC, uri DESC LIMIT 50")
def o_likes(spark, d):
    return o.by_metric(posts(spark, d), "likes").limit(50).select("uri", F.coalesce("like_count", F.lit(0)).alias("likes"))


@query(f"{POSTS} SELECT uri, author, score AS engagement FROM posts WHERE list_contains(hashtags, '#click') AND coalesce(like_count, 0) >= 5 ORDER BY score DESC, created_at DESC, uri DESC LIMIT 10")
def o_engagement_topk(spark, d):
    kept = posts(spark, d).where((p.hashtag("#click") & p.engagement(likes=5)).condition)
    return o.by_metric(kept, "engagement").limit(10).select("uri", "author", score().alias("engagement"))


@query(f"""{POSTS}, top AS (SELECT uri, score, created_at, row_number() OVER (ORDER BY score DESC, created_at DESC, uri DESC) AS n FROM posts)
SELECT uri, score AS engagement FROM top WHERE n BETWEEN 26 AND 50""")
def o_keyset(spark, d):
    all_ = posts(spark, d)
    last = o.by_metric(all_, "engagement").limit(25).select(score().alias("s"), "created_at", "uri").orderBy("s", "created_at", "uri").first()
    return o.page_after(all_, "engagement", (last["s"], last["created_at"], last["uri"]), 25).select("uri", score().alias("engagement"))


@query(f"{POSTS} SELECT uri FROM (SELECT * FROM posts ORDER BY created_at, uri LIMIT 500) WHERE has_media")
def o_scan_limit(spark, d):
    return o.scan_limited(posts(spark, d), p.has_media(), 500).select("uri")


@query(f"{POSTS} SELECT event_type AS store, uri, iso AS created FROM posts WHERE event_type IN ('click', 'view', 'error') ORDER BY created_at, uri, event_type LIMIT 200")
def o_multi_store(spark, d):
    all_ = posts(spark, d)
    stores = {n: all_.where(F.col("event_type") == n) for n in ("click", "view", "error")}
    return o.merge_stores(stores).limit(200).select("store", "uri", iso(F.col("created_at")).alias("created"))


@query(f"{POSTS} SELECT uri, nullif(regexp_extract(links[1], '://([^/]+)', 1), '') AS host, length(text) AS n FROM posts WHERE has_links")
def j_link_host(spark, d):
    from ..functions.text import host

    return posts(spark, d).where("has_links").select("uri", host(F.try_element_at("links", F.lit(1))).alias("host"), F.length("text").cast("bigint").alias("n"))


@query(f"""{POSTS} SELECT uri, CASE WHEN embed_type IS NOT NULL THEN 'type|image_count|all_alt' || CASE WHEN has_images THEN '|first_thumb' ELSE '' END || CASE WHEN external_link IS NOT NULL THEN '|external_uri' ELSE '' END ||
CASE WHEN quote_uri IS NOT NULL THEN '|record_uri|record_author' ELSE '' END END AS children FROM posts""")
def j_wildcard(spark, d):
    """All children of the summary; those without a value are left out when lines of JSON are made."""
    shown = j.project(posts(spark, d), ["uri", "embed_summary.*"])
    return shown.select("uri", F.array_join(F.json_object_keys(F.to_json(F.when(F.col("embed_summary.type").isNotNull(), F.col("embed_summary")))), "|").alias("children"))


@query(f"{POSTS} SELECT uri, author_did, like_count, is_reply, reply_root_uri FROM posts")
def j_full(spark, d):
    return j.project(posts(spark, d), j.fields("@full")).select("uri", "author_did", "like_count", "is_reply", "reply_root_uri")


@query(f"{IMAGES} SELECT i.uri, i.author, fullsize, thumb, alt FROM images i")
def j_image_rows(spark, d):
    return j.images(posts(spark, d)).select("uri", "author", "fullsize", "thumb", "alt")
