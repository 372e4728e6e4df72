"""From raw posts to rows of the posts table; whole-column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hashtags_in, links_in, mentions_in
from ..sources.schema import EMBED

_NONE = "array<string>"


def merge(*lists: Column) -> Column:
    """Distinct non-empty values in order of first sight; nulls are empty lists."""
    whole = F.concat(*[F.coalesce(x, F.array().cast(_NONE)) for x in lists])
    return F.array_distinct(F.filter(whole, lambda x: x.isNotNull() & (x != "")))


def facet_values(facets: Column, field: str) -> Column:
    """One field of all features of all facets, blanks dropped."""
    features = F.flatten(F.transform(F.filter(facets, lambda f: f["features"].isNotNull()), lambda f: f["features"]))
    return F.filter(F.transform(features, lambda x: x[field]), lambda x: x.isNotNull() & (x != ""))


def tagged(tags: Column) -> Column:
    return F.transform(tags, lambda t: F.when(t.startswith("#"), t).otherwise(F.concat(F.lit("#"), t)))


#: Counts of a post's metrics and the columns they go to; those without a column are checked only.
COUNTS = {"likeCount": "like_count", "repostCount": "repost_count", "replyCount": "reply_count", "quoteCount": "quote_count", "bookmarkCount": None}


def metric(metrics: Column, name: str) -> Column:
    """A count; -1 stands for unknown."""
    return F.nullif(F.try_variant_get(metrics, f"$.{name}", "bigint"), F.lit(-1))


def bad_metric(metrics: Column) -> Column:
    """Whether any count is not a whole number of 0 or more, or -1; a missing or null one is fine."""
    out = F.lit(False)
    for name in COUNTS:
        kind = F.schema_of_variant(F.try_variant_get(metrics, f"$.{name}", "variant"))
        value = F.try_variant_get(metrics, f"$.{name}", "double")
        number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        out |= F.coalesce(kind != "VOID", F.lit(False)) & ~(number & (value == F.floor(value)) & ((value >= 0) | (value == -1)))
    return F.coalesce(out, F.lit(False))


def instant(text: Column) -> Column:
    """A time as text in UTC without zone, cut to milliseconds; null where it is none.

    An offset (``Z``, ``+02:00``, ``+0200``) is taken into account; without one the time is UTC.
    """
    zoned = F.when(text.rlike(r"T.*(Z|[+-]\d\d(:?\d\d)?)$"), F.regexp_replace(text, r"(T.*[+-]\d\d)(\d\d)$", "$1:$2")).when(text.rlike(r"^\d+-\d+-\d+$"), F.concat(text, F.lit("T00:00:00Z"))).otherwise(F.concat(text, F.lit("Z")))
    millis = F.floor(F.unix_micros(F.try_to_timestamp(zoned)) / 1000)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=(millis / F.lit(1000).cast("decimal(4,0)")).cast("decimal(18,6)"))


def languages(langs: Column) -> Column:
    return merge(F.transform(langs, lambda x: F.lower(F.trim(x))))


def images_of(embed: Column) -> Column:
    """Images of the embed itself, of its media, or of an unknown payload that says it is images; blank alt text is null."""
    unknown = F.when((embed["type"] == "Unknown") & embed["rawType"].contains("images"), F.from_json(embed["data"], "images array<struct<fullsize:string,thumb:string,alt:string,aspectRatio:struct<width:double,height:double>>>")["images"])
    found = F.coalesce(F.when(embed["type"] == "Images", embed["images"]), F.when(embed["media"]["type"] == "Images", embed["media"]["images"]), unknown)
    aspect = lambda i: F.when(i["aspectRatio"]["width"].isNotNull() & i["aspectRatio"]["height"].isNotNull(), i["aspectRatio"])
    tidy = F.transform(found, lambda i: F.struct(i["fullsize"].alias("fullsize"), i["thumb"].alias("thumb"), F.nullif(F.trim(i["alt"]), F.lit("")).alias("alt"), aspect(i).alias("aspect")))
    return F.coalesce(tidy, F.array().cast("array<struct<fullsize:string,thumb:string,alt:string,aspect:struct<width:double,height:double>>>"))


def embed_summary(embed: Column) -> Column:
    """Type, images, whether all have alt text, first thumb, external link and quoted record."""
    images = images_of(embed)
    external = F.coalesce(embed["external"], embed["media"]["external"])
    return F.when(
        embed["type"].isNotNull(),
        F.struct(
            embed["type"].alias("type"), F.size(images).alias("image_count"), ((F.size(images) > 0) & F.forall(images, lambda i: i["alt"].isNotNull())).alias("all_alt"),
            F.try_element_at(images, F.lit(1))["thumb"].alias("first_thumb"), external["uri"].alias("external_uri"), external["title"].alias("external_title"),
            embed["record"]["uri"].alias("record_uri"), F.coalesce(embed["record"]["authorHandle"], embed["record"]["authorDid"]).alias("record_author"),
        ),
    )


def flat_summary() -> Column:
    """The same summary from the flat columns of a posts table."""
    shown, quoted, card = F.size("images") > 0, F.col("quote_uri").isNotNull(), F.col("external_link").isNotNull()
    media = shown | F.col("has_video") | card
    kind = F.when(quoted & media, "RecordWithMedia").when(quoted, "Record").when(shown, "Images").when(F.col("has_video"), "Video").when(card, "External")
    return F.when(
        kind.isNotNull(),
        F.struct(
            kind.alias("type"), F.size("images").alias("image_count"), (shown & F.forall("images", lambda i: F.coalesce(F.trim(i["alt"]), F.lit("")) != "")).alias("all_alt"),
            F.try_element_at("images", F.lit(1))["thumb"].alias("first_thumb"), F.col("external_link").alias("external_uri"), F.lit(None).cast("string").alias("external_title"),
            F.col("quote_uri").alias("record_uri"), F.col("quote_author_did").alias("record_author"),
        ),
    )


def embed_cell(summary: Column) -> Column:
    """An embed in a few characters: ``2img``, ``video``, ``link:host``, ``quote:@author`` or nothing."""
    shown = F.when(summary["image_count"] > 0, F.concat(summary["image_count"].cast("string"), F.lit("img")))
    host = F.try_parse_url(summary["external_uri"], F.lit("HOST"))
    card = F.when(summary["external_uri"].isNotNull(), F.when(host.isNotNull(), F.concat(F.lit("link:"), host)).otherwise(F.lit("link")))
    quote = F.when(summary["record_author"].isNotNull(), F.concat(F.lit("quote:@"), summary["record_author"])).otherwise(F.lit("quote"))
    kind = summary["type"]
    media = F.coalesce(shown, card, F.when(kind == "Video", "video"))
    return F.coalesce(
        F.when(kind == "Images", F.coalesce(shown, F.lit("img"))).when(kind == "Video", "video").when(kind == "External", F.coalesce(card, F.lit("link")))
        .when(kind == "Record", quote).when(kind == "RecordWithMedia", F.concat_ws("+", quote, media)).otherwise(F.lit("")), F.lit("")
    )


def reject_reason(parsed: Column, shape: Column) -> Column:
    """Why a decoded line cannot be taken as a post, or null."""
    own = shape == "raw"
    text, created, metrics = shaped(parsed, shape, "text"), shaped(parsed, shape, "createdAt"), shaped(parsed, shape, "metrics")
    uri = F.coalesce(shaped(parsed, shape, "uri"), parsed["uri"])  # a line with no more than a uri has no shape
    return (
        F.when(uri.isNull(), F.lit("not a post"))
        .when(~uri.rlike(r"^at://\S+"), F.lit("bad uri"))
        .when(text.isNull() | (~own & shaped(parsed, shape, "author").isNull()) | instant(created).isNull(), F.lit("bad record"))
        .when(bad_metric(metrics), F.lit("bad metric"))
    )


#: Fields that a raw post has in its record.
_OF_RECORD = ("text", "createdAt", "langs", "reply")


def shaped(parsed: Column, shape: Column, field: str) -> Column:
    """A field of a decoded line of any shape: raw, post or (within ``post``) stored."""
    raw = parsed["record"][field] if field in _OF_RECORD else parsed[field]
    return F.when(shape == "raw", raw).when(shape == "stored", parsed["post"][field]).when(shape == "post", parsed[field])


def posts_of(lines: DataFrame) -> DataFrame:
    """Rows of the posts table from ``lines(parsed, shape)`` that have no reject reason, in one pass.

    Raw posts get their tags, mentions and links from text, facets and tags; the other shapes
    have them already.
    """
    parsed, shape = F.col("parsed"), F.col("shape")
    raw, get = shape == "raw", lambda field: shaped(parsed, shape, field)
    inner = parsed["record"]["embed"]
    unknown = F.when(raw & inner.isNotNull(), F.struct(*[(F.lit("Unknown") if f.name == "type" else F.get_json_object(inner, "$.type") if f.name == "rawType" else inner if f.name == "data" else F.lit(None).cast(f.dataType)).alias(f.name) for f in EMBED]))
    out = lines.withColumn("_embed", F.explode(F.array(F.coalesce(get("embed"), unknown))))  # worked out once a row
    embed, reason, created, text, metrics, reply = F.col("_embed"), get("feed")["reason"], instant(get("createdAt")), get("text"), get("metrics"), get("reply")
    facets = parsed["record"]["facets"]
    own = lambda field: F.coalesce(get(field), F.array().cast(_NONE))
    either = lambda made, field: F.when(raw, made).otherwise(own(field))
    out = out.select(
        get("uri").alias("uri"), F.lower(get("author")).alias("author"), get("authorDid").alias("author_did"), created.alias("created_at"), created.cast("date").alias("created_date"), text.alias("text"),
        languages(own("langs")).alias("langs"),
        either(merge(hashtags_in(text), tagged(facet_values(facets, "tag")), tagged(parsed["record"]["tags"])), "hashtags").alias("hashtags"),
        either(mentions_in(text), "mentions").alias("mentions"), either(merge(facet_values(facets, "did")), "mentionDids").alias("mention_dids"),
        either(merge(links_in(text), facet_values(facets, "uri")), "links").alias("links"), F.coalesce(embed["external"]["uri"], embed["media"]["external"]["uri"]).alias("external_link"),
        *[metric(metrics, name).alias(column) for name, column in COUNTS.items() if column],
        reply["parent"]["uri"].alias("reply_parent_uri"), reply["root"]["uri"].alias("reply_root_uri"), reply.isNotNull().alias("is_reply"),
        embed["type"].isin("Record", "RecordWithMedia").alias("is_quote"), embed["record"]["uri"].alias("quote_uri"), embed["record"]["authorDid"].alias("quote_author_did"),
        (reason["type"] == "repost").alias("is_repost"), F.when(reason["type"] == "repost", reason["byDid"]).alias("repost_by_did"),
        images_of(embed).alias("images"), ((embed["type"] == "Video") | (embed["media"]["type"] == "Video")).alias("has_video"),
        embed.isNotNull().alias("has_embed"), embed_summary(embed).alias("embed_summary"),
    )
    return flags(out.withColumn("images", F.explode(F.array("images"))))


def flags(p: DataFrame) -> DataFrame:
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    p = p.withColumns({c: known(c) for c in ("is_reply", "is_quote", "is_repost", "has_video", "has_embed")} | {"image_count": F.size("images")})
    return p.withColumns({
        "is_original": ~F.col("is_reply") & ~F.col("is_quote") & ~F.col("is_repost"),
        "has_images": F.col("image_count") > 0,
        "has_alt_text": (F.col("image_count") > 0) & F.forall("images", lambda i: i["alt"].isNotNull()),
        "alt_text": F.array_join(F.transform("images", lambda i: i["alt"]), "\n"),
        "has_links": (F.size("links") > 0) | F.col("external_link").isNotNull(),
        "has_media": (F.col("image_count") > 0) | F.col("has_video") | F.col("external_link").isNotNull(),
        "primary_lang": F.try_element_at("langs", F.lit(1)),
    })


def with_handles(posts: DataFrame, identities: DataFrame, small: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """``posts`` with ``author`` looked up by ``author_did`` in ``identities(did, handle)``, and those without a match.

    The table is broadcast if it has at most ``small`` rows, else joined by shuffle.
    """
    names = identities.select(F.col("did").alias("author_did"), F.lower("handle").alias("_handle")).dropDuplicates(["author_did"])
    if names.limit(small + 1).count() <= small:
        names = F.broadcast(names)
    joined = posts.join(names, "author_did", "left")
    found = joined.where("_handle is not null").withColumn("author", F.col("_handle")).drop("_handle")
    return found, joined.where("_handle is null").drop("_handle")
