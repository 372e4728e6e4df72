"""Term search over text and alt text."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.2, 0.75


def terms_of(query: str) -> list[str]:
    found = [t for t in dict.fromkeys(query.lower().split()) if t]
    if not found:
        raise ValueError("no terms")
    return found


def indexed(posts: DataFrame, columns: tuple[str, ...] = ("text", "alt")) -> DataFrame:
    """``posts`` with ``words``: the tokens of the text, of the alt texts, or of both."""
    alt = F.concat_ws(" ", F.transform("images", lambda i: i["alt"]))
    parts = {"text": F.col("text"), "alt": alt}
    return posts.withColumn("words", tokens(F.concat_ws(" ", *[parts[c] for c in columns])))


def matches(all_of: list[str] = (), any_of: list[str] = (), none_of: list[str] = (), phrase: str | None = None) -> Column:
    """A condition on ``words``."""
    has = lambda t: F.array_contains("words", t)
    parts = [has(t) for t in all_of]
    if any_of:
        parts.append(functools.reduce(lambda a, b: a | b, map(has, any_of)))
    parts += [~has(t) for t in none_of]
    if phrase:
        parts.append(F.concat(F.lit(" "), F.concat_ws(" ", "words"), F.lit(" ")).contains(f" {' '.join(phrase.lower().split())} "))
    if not parts:
        raise ValueError("an empty search")
    return functools.reduce(lambda a, b: a & b, parts)


def page(found: DataFrame, order: list[Column], limit: int = 25, offset: int = 0) -> DataFrame:
    return found.orderBy(*order).offset(offset).limit(limit)


def with_cursor(found: DataFrame, order: list[Column], limit: int = 25, offset: int = 0) -> DataFrame:
    """A page with ``next_cursor``, the offset of the next one, on each of its rows: null unless the page is full."""
    rows = page(found, order, limit, offset)
    full = F.count("*").over(Window.partitionBy()) >= limit  # a window over the page alone
    return rows.withColumn("next_cursor", F.when(full, F.lit(offset + limit)))


def newest(found: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    return page(found, [F.desc("created_at"), F.desc("uri")], limit, offset)


def oldest(found: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    return page(found, [F.asc("created_at"), F.asc("uri")], limit, offset)


def times(term: str) -> Column:
    return F.size(F.filter("words", lambda w: w == term))


def bm25(posts: DataFrame, query: str) -> DataFrame:
    """``uri`` and ``rank`` (higher is better) of posts that hold all terms.

    One aggregation gives the number of posts, their mean length and each term's document
    frequency; only the query's own terms are ever counted, in the row itself.
    """
    terms = terms_of(query)
    docs = indexed(posts).select("uri", F.size("words").alias("n"), *[times(t).alias(f"f{k}") for k, t in enumerate(terms)])
    total = docs.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.sum((F.col(f"f{k}") > 0).cast("bigint")).alias(f"d{k}") for k in range(len(terms))])
    both = docs.where(functools.reduce(lambda a, b: a & b, [F.col(f"f{k}") > 0 for k in range(len(terms))])).join(F.broadcast(total))  # one row
    part = lambda k: F.log((F.col("docs") - F.col(f"d{k}") + 0.5) / (F.col(f"d{k}") + 0.5) + 1) * F.col(f"f{k}") * (K1 + 1) / (F.col(f"f{k}") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return both.select("uri", functools.reduce(lambda a, b: a + b, [part(k) for k in range(len(terms))]).alias("rank"))
