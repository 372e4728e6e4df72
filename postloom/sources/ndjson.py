"""Posts as lines of JSON, in three shapes, and other text output."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import iso, markdown_cell
from ..operators import normalize as n
from .schema import COMMIT, LINE

#: Fixed value: the collection whose commits are posts.
POST_COLLECTION = "app.bsky.feed.post"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files that are not blank, with ``file``, ``split`` (where the piece of the file that a task reads begins) and ``place``, which ascends within a split."""
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    some = spark.read.text(path).select(F.col("value").alias("line"), *where).where(F.trim("line") != "")
    return some.withColumn("place", F.monotonically_increasing_id())


def with_line_numbers(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows`` that come from ``lines`` of ``read_lines``, with ``number``: the line's place among its file's non-blank lines, from 1.

    A split's lines have ascending places without gaps, so its first place and its number of
    lines, a row a split, with the sums over a file's earlier splits say all; no line is
    shuffled.  Both reads have to see the same files under the same settings.
    """
    splits = lines.groupBy("file", "split").agg(F.min("place").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(splits, ["file", "split"]).withColumn("number", F.col("place") - F.col("_first") + F.col("_before") + 1).drop("_first", "_before")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines with ``parsed``, ``shape`` (raw, stored, post, or null where a line is broken) and ``reason``, null where it is a post."""
    # through explode, each line is parsed once and not once a field that is read from it
    some = lines.where(F.trim("line") != "").withColumn("parsed", F.explode(F.array(F.from_json("line", LINE))))
    j = F.col("parsed")
    some = some.withColumn("shape", F.when(j["record"].isNotNull() & j["uri"].isNotNull(), "raw").when(j["post"]["uri"].isNotNull(), "stored").when(j["uri"].isNotNull() & j["text"].isNotNull(), "post"))
    return some.withColumn("reason", n.reject_reason(j, F.col("shape")))


def decode(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts from ``lines(line)`` of any of the three shapes, and the lines that are none with ``reason``.

    Raw posts are normalised, the others taken as they are.  Blank lines are dropped; other
    columns of ``lines`` stay with the rejects.  Either result parses each line once.
    """
    some = parsed_lines(lines)
    return n.posts_of(some.where("reason is null").select("parsed", "shape")), some.where("reason is not null").drop("parsed", "shape")


def shape_of(lines: DataFrame) -> DataFrame:
    """``lines`` with ``shape``: raw, stored or post, or null where a line is broken."""
    return parsed_lines(lines).drop("parsed", "reason")


def apply_policy(rejects: DataFrame, policy: str) -> DataFrame:
    """What is left of rejects: ``skip`` none, ``report`` all, ``fail`` an error at the first."""
    if policy == "skip":
        return rejects.limit(0)
    if policy == "report":
        return rejects
    if policy == "fail":
        return rejects.withColumn("reason", F.raise_error(F.concat(F.lit("bad line: "), "reason")).cast("string"))
    raise ValueError(f"no policy named {policy!r}")


def commits(lines: DataFrame) -> DataFrame:
    """Post commits from ``lines(line)``: ``op`` (create, update, delete), ``uri``, time and record."""
    c = lines.select(F.explode(F.array(F.from_json("line", COMMIT))).alias("c")).where((F.col("c.kind") == "commit") & (F.col("c.commit.collection") == POST_COLLECTION))
    m = F.col("c.commit")
    return c.where(m["operation"].isin("create", "update", "delete")).select(
        m["operation"].alias("op"), F.concat(F.lit("at://"), "c.did", F.lit("/"), m["collection"], F.lit("/"), m["rkey"]).alias("uri"), F.col("c.did").alias("author_did"),
        F.col("c.time_us").alias("time_us"), F.timestamp_micros(F.col("c.time_us")).alias("indexed_at"), m["record"]["text"].alias("text"), m["record"]["langs"].alias("langs"),
    )


def write_json(posts: DataFrame, path: str) -> None:
    posts.write.mode("overwrite").json(path)


def markdown_rows(posts: DataFrame, *keep: str) -> DataFrame:
    """One table row of text a post, beside the columns to keep."""
    cells = [iso(F.col("created_at")), F.concat(F.lit("@"), "author"), markdown_cell(F.col("text")), markdown_cell(n.embed_cell(F.col("embed_summary"))), F.col("uri")]
    return posts.select(*keep, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def materialize(posts: DataFrame, filters: dict, folder: str, now: datetime) -> DataFrame:
    """Each named filter's posts as JSON and as a markdown table in its own folder, with a manifest of all.

    The posts are scanned once a format, whatever the number of filters; the counts come with
    the JSON, whose files are compressed, since they hold whole texts.  Returns the manifest: ``name``, ``count``, ``written_at`` and ``files`` (folders
    under ``folder``), a filter without posts too.
    """
    from ..operators.predicates import tag_matches

    spark, names = posts.sparkSession, sorted(filters)
    matched = tag_matches(posts, filters)
    counts = Observation()
    seen = [F.count_if(F.col("filter") == name).alias(f"n{k}") for k, name in enumerate(names)]
    matched.observe(counts, *seen).write.mode("overwrite").partitionBy("filter").json(f"{folder}/json", compression="gzip")
    lines = markdown_rows(matched, "filter")
    lines.write.mode("overwrite").partitionBy("filter").text(f"{folder}/markdown")
    rows = [(name, counts.get[f"n{k}"], now.isoformat(), [f"json/filter={name}", f"markdown/filter={name}"]) for k, name in enumerate(names)]
    manifest = spark.createDataFrame(rows, "name string, count bigint, written_at string, files array<string>")  # a row a filter
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).json(f"{folder}/manifest")
