"""Threads and the interaction graph.

Iterations write their tables to the shared folder that ``spark.checkpoint.dir`` names, so
that plans stay short and a lost executor costs no more than a reread.  A busy node is many
edges of one key: sums and minima are combined on the map side first.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def saved(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; where none is named, in a temporary one if all tasks run in this process, else an error."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where or f"file://{tempfile.mkdtemp(prefix='spark-shared-')}")
    return df.checkpoint()


def thread(posts: DataFrame, uri: str) -> DataFrame:
    """All posts of the thread that a post is in, by time."""
    root = posts.where(F.col("uri") == uri).select(F.coalesce("reply_root_uri", "uri").alias("_root")).limit(1)  # one row
    joined = posts.join(F.broadcast(root), (F.col("uri") == F.col("_root")) | (F.col("reply_root_uri") == F.col("_root")))
    return joined.drop("_root").orderBy("created_at", "uri")


def thread_order(posts: DataFrame) -> DataFrame:
    """``uri``, ``depth`` and ``path``: ordering by path is the depth-first order of each thread's replies.

    A post whose parent is not among the posts is a root; siblings go by time and uri.  Each
    round joins a post's path to that of the post above it, so the rounds grow with the
    logarithm of a thread's depth.  Posts whose parents go round in a circle, or lead into
    one, have no root and are left out.
    """
    rows = posts.select("uri", F.col("reply_parent_uri").alias("up"), F.concat(F.date_format("created_at", "yyyyMMddHHmmssSSS"), F.lit(" "), "uri").alias("own"))
    has = rows.select(F.col("uri").alias("up"), F.lit(True).alias("_has"))
    rows = saved(rows.join(has, "up", "left").select("uri", F.when(F.col("_has"), F.col("up")).alias("up"), "own", F.array("own").alias("path")))
    while not (waiting := rows.where("up is not null")).isEmpty():
        above = rows.select(F.col("uri").alias("up"), F.col("up").alias("_next"), F.col("path").alias("_before"))
        joined = waiting.join(above, "up").where(~F.array_contains("_before", F.col("own")))
        rows = saved(rows.where("up is null").unionByName(joined.select("uri", F.col("_next").alias("up"), "own", F.concat("_before", "path").alias("path"))))
    return rows.select("uri", (F.size("path") - 1).alias("depth"), "path")


def edges(posts: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``type`` and ``weight``: mentions, replies to posts among these, quotes and reposts; none to oneself."""
    parents = posts.select(F.col("uri").alias("reply_parent_uri"), F.col("author_did").alias("parent_did"))
    link = lambda df, a, b, kind: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("type"))
    all_ = link(posts.select("author_did", F.explode("mention_dids").alias("m")), "author_did", "m", "mention")
    all_ = all_.unionByName(link(posts.where("reply_parent_uri is not null").join(parents, "reply_parent_uri"), "author_did", "parent_did", "reply"))
    all_ = all_.unionByName(link(posts.where("quote_author_did is not null"), "author_did", "quote_author_did", "quote"))
    all_ = all_.unionByName(link(posts.where("repost_by_did is not null"), "repost_by_did", "author_did", "repost"))
    return all_.where("src is not null and dst is not null")


def weighted(links: DataFrame) -> DataFrame:
    return links.where("src <> dst").groupBy("src", "dst", "type").agg(F.count("*").alias("weight"))


def nodes(posts: DataFrame, links: DataFrame) -> DataFrame:
    """Every end of a link, links to oneself included, with the first label seen."""
    ends = links.select(F.col("src").alias("did")).union(links.select("dst")).distinct()
    names = posts.where("author is not null").groupBy(F.col("author_did").alias("did")).agg(F.min_by("author", F.struct("created_at", "uri")).alias("label"))
    return ends.join(names, "did", "left")


def summary(posts: DataFrame, people: DataFrame, links: DataFrame) -> DataFrame:
    """One row: posts scanned, links by type, actors, edges and density."""
    kinds = [F.coalesce(F.sum(F.when(F.col("type") == k, F.col("weight"))), F.lit(0)).alias(f"{k}s") for k in ("mention", "quote", "reply", "repost")]
    out = links.agg(F.count("*").alias("edges"), *kinds).join(F.broadcast(people.agg(F.count("*").alias("actors")))).join(F.broadcast(posts.agg(F.count("*").alias("posts"))))  # one row each
    n = F.col("actors")
    return out.withColumn("density", F.when(n > 1, F.round(F.col("edges") / (n * (n - 1)), 9)).otherwise(F.lit(0.0)))


def degree(people: DataFrame, links: DataFrame, direction: str = "both", weights: bool = True) -> DataFrame:
    """``did`` and ``degree``: summed weights or distinct neighbours; 0 where there is none."""
    if direction not in ("in", "out", "both"):
        raise ValueError(f"no direction named {direction!r}")
    out = links.select(F.col("src").alias("did"), F.col("dst").alias("other"), "weight")
    into = links.select(F.col("dst").alias("did"), F.col("src").alias("other"), "weight")
    both = out if direction == "out" else into if direction == "in" else out.union(into)
    found = both.groupBy("did").agg((F.sum("weight") if weights else F.count_distinct("other")).alias("degree"))
    return people.select("did").join(found, "did", "left").select("did", F.coalesce("degree", F.lit(0)).alias("degree"))


def pagerank(people: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int = 20, weights: bool = False) -> DataFrame:
    """``did`` and ``rank`` after a fixed number of rounds from equal ranks; the mass of nodes without links goes to all alike."""
    share = F.col("weight").cast("double") if weights else F.lit(1.0)
    out = saved(links.withColumn("w", share).groupBy("src", "dst").agg(F.sum("w").alias("w")))
    total = out.groupBy("src").agg(F.sum("w").alias("total"))
    out = saved(out.join(total, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("w")))
    n = people.count()
    base = saved(people.select("did").join(total.select(F.col("src").alias("did"), F.lit(True).alias("gives")), "did", "left"))
    ranks = base.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(rounds):
        given = out.join(ranks.select(F.col("did").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("did")).agg(F.sum(F.col("rank") * F.col("w")).alias("got"))
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("gives").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"))
        rank = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)
        ranks = base.join(given, "did", "left").join(F.broadcast(loose)).select("did", "gives", rank.alias("rank"))  # one row
        if k % 5 == 4:
            ranks = saved(ranks)
    return ranks.select("did", "rank")


def communities(people: DataFrame, links: DataFrame, rounds: int = 10, least: int = 1) -> DataFrame:
    """``did`` and ``community`` (its smallest member) by label propagation over links both ways.

    All nodes change at once; each also votes for its own label, as strongly as its strongest
    neighbour, so that a pair does not swap labels for ever; ties go to the smallest label.
    """
    near = links.select("src", "dst", "weight").union(links.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    own = people.select(F.col("did").alias("src")).join(near.groupBy("src").agg(F.max("w").alias("w")), "src", "left")
    near = saved(near.union(own.select("src", "src", F.coalesce("w", F.lit(1).cast("bigint")))))
    labels = people.select("did", F.col("did").alias("label"))
    for _ in range(rounds):
        votes = near.join(labels.select(F.col("did").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.sum("w").alias("w"))
        best = votes.groupBy(F.col("src").alias("did")).agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("label"))
        after = saved(best)
        if after.join(labels.select("did", F.col("label").alias("was")), "did").where("label <> was").isEmpty():
            break
        labels = after
    sizes = labels.groupBy("label").agg(F.min("did").alias("community"), F.count("*").alias("n")).where(F.col("n") >= least)
    return labels.join(sizes, "label").select("did", "community")


def community_labels(members: DataFrame, links: DataFrame, people: DataFrame) -> DataFrame:
    """Each community's size and the member with most weight inside it."""
    own = members.select(F.col("did").alias("src"), "community")
    other = members.select(F.col("did").alias("dst"), F.col("community").alias("there"))
    inside = links.join(own, "src").join(other, "dst").where("community = there")
    both = inside.select(F.col("src").alias("did"), "weight").union(inside.select("dst", "weight"))
    strength = both.groupBy("did").agg(F.sum("weight").alias("w"))
    named = members.join(strength, "did", "left").join(people, "did", "left")
    return named.groupBy("community").agg(F.count("*").alias("members"), F.min_by(F.coalesce("label", "did"), F.struct(-F.coalesce("w", F.lit(0)), "did")).alias("label"))


def relationships(actors: DataFrame, me: str, follows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Flags between ``me`` and each actor from ``follows`` and ``blocks`` (``from_did``, ``to_did``)."""
    mine = lambda df, flag: df.where(F.col("from_did") == me).select(F.col("to_did").alias("did"), F.lit(True).alias(flag)).distinct()
    theirs = lambda df, flag: df.where(F.col("to_did") == me).select(F.col("from_did").alias("did"), F.lit(True).alias(flag)).distinct()
    out = actors.select("did")
    for part in (mine(follows, "following"), theirs(follows, "followed_by"), mine(blocks, "blocking"), theirs(blocks, "blocked_by")):
        out = out.join(part, "did", "left")
    known: list[Column] = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("following", "followed_by", "blocking", "blocked_by")]
    return out.select("did", *known).withColumn("mutual", F.col("following") & F.col("followed_by"))


def ranked(scores: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` highest with ``position``."""
    top = scores.orderBy(F.desc(column), "did").limit(n)
    return top.withColumn("position", F.row_number().over(Window.orderBy(F.desc(column), "did")))
