"""Registered queries: raw JSON lines to posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import HASHTAG, LINK, MENTION, iso
from ..operators import changelog as c
from ..operators import normalize as n
from ..operators import predicates as p
from ..sources import ndjson
from .base import POSTS, dealt_once, did, posts, posts_in_blocks, query
from .streams import new_folder

_BROKEN = "event_id % 50 = 49"


def _zoned():
    """A post's time, of some with an offset."""
    with_offset = lambda hours, text: F.date_format(F.col("created_at") + F.expr(f"interval {hours} hours"), f"yyyy-MM-dd'T'HH:mm:ss.SSS'{text}'")
    return F.when(F.col("event_id") % 9 == 2, with_offset(2, "+02:00")).when(F.col("event_id") % 9 == 5, with_offset(-8, "-0800")).otherwise(iso(F.col("created_at")))


def raw_lines(spark, d):
    return lines_of(posts(spark, d))


def lines_of(p):
    """Every post as a line of raw JSON; unknown likes are -1, some lines are broken, some counts below -1 or text, and some times have an offset."""
    e = F.col("event_id")
    image = F.when(F.size("images") > 0, F.struct(F.lit("Images").alias("type"), F.transform("images", lambda i: F.struct(i["fullsize"].alias("fullsize"), i["thumb"].alias("thumb"), F.coalesce(i["alt"], F.lit("  ")).alias("alt"))).alias("images")))
    quote = F.when(F.col("is_quote"), F.struct(F.lit("Record").alias("type"), F.struct(F.col("quote_uri").alias("uri"), F.col("quote_author_did").alias("authorDid")).alias("record")))
    video = F.when(F.col("has_video"), F.struct(F.lit("Video").alias("type")))
    card = F.when(F.col("external_link").isNotNull(), F.struct(F.lit("External").alias("type"), F.struct(F.col("external_link").alias("uri"), F.lit("a card").alias("title")).alias("external")))
    embed = F.coalesce(*map(F.to_json, (image, quote, video, card)))
    facets = F.when(F.size("mention_dids") > 0, F.array(F.struct(F.transform("mention_dids", lambda m: F.struct(F.lit("mention").alias("type"), m.alias("did"))).alias("features"))))
    reply = F.when(F.col("is_reply"), F.struct(F.struct(F.col("reply_root_uri").alias("uri")).alias("root"), F.struct(F.col("reply_parent_uri").alias("uri")).alias("parent")))
    record = F.struct(F.concat("text", F.lit(" @U"), "user_id", F.lit(".Test see https://a.example/"), e % 4, F.lit(". #"), "source").alias("text"), _zoned().alias("createdAt"), facets.alias("facets"), reply.alias("reply"), F.transform("langs", F.upper).alias("langs"), F.array("source").alias("tags"))
    metrics = F.struct(F.when(e % 70 == 69, -2).otherwise(F.coalesce("like_count", F.lit(-1))).alias("likeCount"), F.col("repost_count").alias("repostCount"), F.col("reply_count").alias("replyCount"), F.col("quote_count").alias("quoteCount"), F.when(e % 70 == 68, -5).when(e % 2 == 0, 3).alias("bookmarkCount"))
    feed = F.when(F.col("is_repost"), F.struct(F.struct(F.lit("repost").alias("type"), F.col("repost_by_did").alias("byDid")).alias("reason")))
    line = F.to_json(F.struct("uri", F.upper("author").alias("author"), F.col("author_did").alias("authorDid"), metrics.alias("metrics"), record.alias("record"), feed.alias("feed")))
    # each step through explode: its text is made once, however often it is used
    line = F.when(e % 70 == 67, F.regexp_replace(line, r'"likeCount":-?\d+', '"likeCount":"many"')).otherwise(line)
    p = p.select("event_id", embed.alias("embed"), F.explode(F.array(line)).alias("line"))
    whole = F.when(F.col("embed").isNotNull(), F.concat(F.regexp_replace("line", r"\}$", ""), F.lit(',"embed":'), "embed", F.lit("}"))).otherwise(F.col("line"))
    return p.select("event_id", F.explode(F.array(F.when(e % 50 == 49, F.substring(whole, 1, 40)).otherwise(whole))).alias("line"))


def _posts(spark, d):
    return ndjson.decode(raw_lines(spark, d))[0]


RAW = f"""{POSTS}, taken AS (SELECT *, text || ' @U' || user_id || '.Test see https://a.example/' || (event_id % 4) || '. #' || source AS whole FROM posts WHERE NOT ({_BROKEN}) AND event_id % 70 < 67)"""


@query(f"{RAW} SELECT uri, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), '|') AS hashtags FROM (SELECT uri, list_concat(regexp_extract_all(whole, '{HASHTAG}'), ['#' || source]) AS t FROM taken)")
def n_hashtags(spark, d):
    return _posts(spark, d).select("uri", F.array_join("hashtags", "|").alias("hashtags"))


@query(f"""{RAW} SELECT uri, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), '|') AS mentions, array_to_string(mention_dids, '|') AS dids
FROM (SELECT uri, mention_dids, list_transform(regexp_extract_all(whole, '{MENTION}', 1), lambda x: lower(x)) AS t FROM taken)""")
def n_mentions(spark, d):
    return _posts(spark, d).select("uri", F.array_join("mentions", "|").alias("mentions"), F.array_join("mention_dids", "|").alias("dids"))


@query(f"""{RAW} SELECT uri, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), '|') AS links
FROM (SELECT uri, regexp_extract_all(whole, '{LINK.replace("'", "''")}') AS t FROM taken)""")
def n_links(spark, d):
    return _posts(spark, d).select("uri", F.array_join("links", "|").alias("links"))


@query(f"""{RAW} SELECT uri, author, iso AS created, is_reply, is_quote, is_repost, is_original, image_count::INT AS image_count, has_images, has_alt_text, has_video, true AS has_links, has_media, has_embed,
array_to_string(list_transform(langs, lambda x: lower(x)), '|') AS langs FROM taken""")
def n_flags(spark, d):
    return _posts(spark, d).select("uri", "author", iso(F.col("created_at")).alias("created"), "is_reply", "is_quote", "is_repost", "is_original", "image_count", "has_images", "has_alt_text", "has_video", "has_links", "has_media", "has_embed", F.array_join("langs", "|").alias("langs"))


@query(f"{RAW} SELECT uri, like_count, repost_count, reply_count, quote_count FROM taken")
def n_metrics(spark, d):
    return _posts(spark, d).select("uri", "like_count", "repost_count", "reply_count", "quote_count")


@query(f"""{RAW} SELECT uri, embed_type AS type, external_link AS external_uri, image_count::INT AS image_count, has_alt_text AS all_alt,
CASE WHEN has_images THEN 'https://img.example/' || event_id || '/0/thumb' END AS first_thumb, quote_uri AS record_uri, quote_author_did AS record_author FROM taken WHERE has_embed""")
def n_embed_summary(spark, d):
    return _posts(spark, d).where("embed_summary is not null").select("uri", *[F.col(f"embed_summary.{c}").alias(c) for c in ("type", "image_count", "all_alt", "first_thumb", "external_uri", "record_uri", "record_author")])


@query(f"{POSTS} SELECT event_id, CASE WHEN {_BROKEN} THEN 'not a post' ELSE 'bad metric' END AS reason FROM posts WHERE {_BROKEN} OR event_id % 70 >= 67")
def n_rejects(spark, d):
    return ndjson.apply_policy(ndjson.decode(raw_lines(spark, d))[1], "report").select("event_id", "reason")


@query(f"""{POSTS}, named AS (SELECT event_id, event_id // 500 AS k, {_BROKEN} AS broken, event_id % 70 >= 67 AS bad, row_number() OVER (PARTITION BY event_id // 500 ORDER BY event_id) AS number FROM posts)
SELECT k::BIGINT AS k, number, CASE WHEN broken THEN 'not a post' ELSE 'bad metric' END AS reason FROM named WHERE broken OR bad""")
def n_reject_lines(spark, d):
    """Where bad lines are in their files, of which each holds five hundred posts."""
    path = new_folder(spark)
    k = F.floor(F.col("event_id") / 500)
    rows, together = posts_in_blocks(spark, d, 500)
    # some lines have a blank one after them
    halves = F.when(F.col("event_id") % 10 == 3, F.array("line", F.lit("  "))).otherwise(F.array("line"))
    lines = lines_of(rows).select("event_id", k.alias("k"), F.posexplode(halves).alias("half", "line"))
    dealt = (lines if together else lines.repartition("k")).sortWithinPartitions("k", "event_id", "half").select("k", "line")
    with dealt_once(spark):
        dealt.write.option("maxRecordsPerFile", 0).partitionBy("k").text(path, compression="gzip")
    read = ndjson.read_lines(spark, path)
    rejects = ndjson.with_line_numbers(ndjson.decode(read)[1], read)
    return rejects.select(F.regexp_extract("file", r"k=(\d+)", 1).cast("bigint").alias("k"), "number", "reason")


def mixed_lines(spark, d):
    """Lines of all shapes: raw, normalised posts, and these with their store; some are broken."""
    p = posts(spark, d)
    likes = F.when(F.col("event_id") % 70 >= 67, 1.5).otherwise(F.coalesce("like_count", F.lit(-1)))
    own = F.struct("uri", "author", F.col("author_did").alias("authorDid"), "text", _zoned().alias("createdAt"), "hashtags", "links", "langs", F.struct(likes.alias("likeCount")).alias("metrics"))
    stored = F.struct(F.lit("main").alias("store"), own.alias("post"))
    line = F.when(F.col("event_id") % 50 == 49, "{broken").when(F.col("event_id") % 3 == 1, F.to_json(own)).otherwise(F.to_json(stored))
    return raw_lines(spark, d).where("event_id % 3 = 0").unionByName(p.where("event_id % 3 <> 0").select("event_id", line.alias("line")))


@query(f"{POSTS} SELECT event_id, CASE WHEN {_BROKEN} THEN NULL WHEN event_id % 3 = 0 THEN 'raw' WHEN event_id % 3 = 1 THEN 'post' ELSE 'stored' END AS shape FROM posts")
def n_shapes(spark, d):
    return ndjson.shape_of(mixed_lines(spark, d)).select("event_id", "shape")


@query(f"""{RAW} SELECT uri, author, iso AS created, CASE WHEN event_id % 3 = 0 THEN whole ELSE text END AS text, like_count, array_to_string(langs, '|') AS langs
FROM (SELECT *, text || ' @U' || user_id || '.Test see https://a.example/' || (event_id % 4) || '. #' || source AS whole FROM posts WHERE NOT ({_BROKEN}) AND event_id % 70 < 67)""")
def n_decoded(spark, d):
    """Posts of all three shapes."""
    return ndjson.decode(mixed_lines(spark, d))[0].select("uri", "author", iso(F.col("created_at")).alias("created"), "text", "like_count", F.array_join("langs", "|").alias("langs"))


@query(f"{POSTS} SELECT count(*) FILTER (event_id >= 40 AND coalesce(like_count, 0) >= 2) AS added, count(*) FILTER (NOT (event_id >= 40 AND coalesce(like_count, 0) >= 2)) + (SELECT count(*) FROM posts WHERE {_BROKEN} OR event_id % 70 >= 67) AS skipped, (SELECT count(*) FROM posts WHERE {_BROKEN} OR event_id % 70 >= 67) AS errors FROM posts WHERE NOT ({_BROKEN} OR event_id % 70 >= 67)")
def l_ingest(spark, d):
    """Counts of one batch: the first forty posts are there already, and a filter is on."""
    return c.ingest_batch(posts(spark, d).where("event_id < 40"), mixed_lines(spark, d), p.engagement(likes=2))[1]


@query(f"{POSTS}, ids AS (SELECT author_did, min(author) AS handle FROM posts WHERE user_id % 4 <> 3 GROUP BY 1) SELECT uri, handle AS author FROM posts JOIN ids USING (author_did)")
def n_handles(spark, d):
    p = posts(spark, d)
    ids = p.where("user_id % 4 <> 3").select(F.col("author_did").alias("did"), F.upper("author").alias("handle"))
    return n.with_handles(p.drop("author"), ids)[0].select("uri", "author")


@query(rf"""{POSTS} SELECT '| ' || iso || ' | @' || author || ' | ' || replace(CASE WHEN length(flat) > 80 THEN substring(flat, 1, 77) || '...' ELSE flat END, '|', '\|') || ' | ' ||
CASE embed_type WHEN 'Images' THEN image_count || 'img' WHEN 'Video' THEN 'video' WHEN 'External' THEN 'link:card.example' WHEN 'Record' THEN 'quote:@' || quote_author_did ELSE '' END || ' | ' || uri || ' |' AS value
FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM posts WHERE has_embed OR is_reply)""")
def s_markdown(spark, d):
    return ndjson.markdown_rows(posts(spark, d).where("has_embed or is_reply"))


@query(f"{POSTS} SELECT op, 'at://' || author_did || '/app.bsky.feed.post/' || event_id AS uri, event_id * 1000 AS time_us FROM posts, unnest(CASE WHEN event_id % 10 = 6 THEN ['create', 'delete'] ELSE ['create'] END) AS t(op) WHERE event_id % 8 <> 7")
def s_commits(spark, d):
    p = posts(spark, d)
    op = F.explode(F.when(F.col("event_id") % 10 == 6, F.array(F.lit("create"), F.lit("delete"))).otherwise(F.array(F.lit("create"))))
    collection = F.when(F.col("event_id") % 8 == 7, "app.bsky.feed.like").otherwise(ndjson.POST_COLLECTION)
    lines = p.select("event_id", "author_did", "text", op.alias("op"), collection.alias("kind"))
    commit = F.struct(F.col("op").alias("operation"), F.col("kind").alias("collection"), F.col("event_id").cast("string").alias("rkey"), F.struct("text").alias("record"))
    return ndjson.commits(lines.select(F.to_json(F.struct(F.col("author_did").alias("did"), (F.col("event_id") * 1000).alias("time_us"), F.lit("commit").alias("kind"), commit.alias("commit"))).alias("line"))).select("op", "uri", "time_us")


@query(f"""{RAW}, alts AS (SELECT uri, string_agg('photo ' || i || ' of ' || event_type, chr(10) ORDER BY i) AS alt_text FROM (SELECT uri, event_id, event_type, unnest(range(0, image_count)) AS i FROM taken WHERE image_count > 0) WHERE (event_id + i) % 4 <> 0 GROUP BY uri)
SELECT uri, coalesce(alt_text, '') AS alt_text FROM taken LEFT JOIN alts USING (uri)""")
def n_alt_text(spark, d):
    """The alt texts of a post's images, one a line; blank ones count as none."""
    return _posts(spark, d).select("uri", "alt_text")
