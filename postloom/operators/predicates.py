"""Predicates over a posts table.

A ``Predicate`` is a boolean Column that is never null, together with a plain description
from which a stable signature is made.  They combine with ``&``, ``|`` and ``~``.  Wrong
arguments raise ``ValueError`` before any Column is built.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FLAGS = {"i": "(?i)", "m": "(?m)", "s": "(?s)"}
_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


@dataclass(frozen=True)
class Predicate:
    spec: dict
    build: Callable[[], Column]
    parts: tuple[Predicate, ...] = ()

    @property
    def column(self) -> Column:
        """True or false for every row."""
        return F.coalesce(self.build(), F.lit(False))

    @property
    def condition(self) -> Column:
        """For ``where``, which drops null like false: plain comparisons that scans can push down."""
        return self.build()

    def signature(self) -> str:
        """Key-sorted JSON: equal for equal filters."""
        return json.dumps(self.spec, sort_keys=True, default=str)

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate({"tag": "And", "left": self.spec, "right": other.spec}, lambda: self.build() & other.build(), (self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate({"tag": "Or", "left": self.spec, "right": other.spec}, lambda: self.build() | other.build(), (self, other))

    def __invert__(self) -> Predicate:
        return Predicate({"tag": "Not", "expr": self.spec}, lambda: ~self.column, (self,))


def _leaf(kind: str, build: Callable[[], Column], /, **arguments) -> Predicate:
    return Predicate({"tag": kind, **{k: sorted(v) if isinstance(v, (set, frozenset)) else v for k, v in arguments.items()}}, build)


def _some(values: Iterable, what: str) -> list:
    values = list(dict.fromkeys(values))
    if not values:
        raise ValueError(f"{what}: at least one value is needed")
    return values


def _least(n: int, what: str) -> int:
    if n < 1:
        raise ValueError(f"{what}: 1 at least")
    return n


def pattern(expression: str, flags: str = "") -> str:
    """A Java pattern for an expression with the flags i, m and s (g and y change nothing)."""
    if not expression:
        raise ValueError("an empty pattern")
    if set(flags) - set("imsgyu"):
        raise ValueError(f"unknown flags in {flags!r}")
    if "m" not in flags:
        expression = re.sub(r"(?<!\\)((?:\\\\)*)\$$", r"\1\\z", expression)  # $ alone also stands before a last newline
    made = "".join(v for k, v in _FLAGS.items() if k in flags) + expression
    if spark := SparkSession.getActiveSession():
        try:
            spark._jvm.java.util.regex.Pattern.compile(made)
        except Exception as wrong:  # py4j's, of the class that Java throws
            raise ValueError(f"bad pattern {expression!r}") from wrong
    return made


def everything() -> Predicate:
    return _leaf("All", lambda: F.lit(True))


def nothing() -> Predicate:
    return _leaf("None", lambda: F.lit(False))


def all_of(*parts: Predicate) -> Predicate:
    """All parts hold; without parts, everything."""
    return functools.reduce(lambda a, b: a & b, parts) if parts else everything()


def any_of(*parts: Predicate) -> Predicate:
    return functools.reduce(lambda a, b: a | b, parts) if parts else nothing()


def author(name: str) -> Predicate:
    return _leaf("Author", lambda: F.col("author") == name.lower(), handle=name.lower())


def author_in(names: Iterable[str]) -> Predicate:
    names = _some((n.lower() for n in names), "authors")
    return _leaf("AuthorIn", lambda: F.col("author").isin(names), handles=sorted(names))


def hashtag(tag: str) -> Predicate:
    return _leaf("Hashtag", lambda: F.array_contains("hashtags", tag), hashtag=tag)


def hashtag_in(tags: Iterable[str]) -> Predicate:
    tags = _some(tags, "tags")
    return _leaf("HashtagIn", lambda: F.arrays_overlap("hashtags", F.array(*map(F.lit, tags))), tags=sorted(tags))


def contains(text: str, case_sensitive: bool = False) -> Predicate:
    plain = (lambda: F.col("text").contains(text)) if case_sensitive else (lambda: F.lower("text").contains(text.lower()))
    return _leaf("Contains", plain, text=text, caseSensitive=case_sensitive)


def regex(expressions: Iterable[str], flags: str = "") -> Predicate:
    made = [pattern(p, flags) for p in _some(expressions, "patterns")]
    return _leaf("Regex", lambda: functools.reduce(lambda a, b: a | b, [F.col("text").rlike(p) for p in made]), patterns=made)


def language(langs: Iterable[str]) -> Predicate:
    langs = _some((x.strip().lower() for x in langs), "languages")
    return _leaf("Language", lambda: F.arrays_overlap(F.transform("langs", lambda x: F.lower(F.trim(x))), F.array(*map(F.lit, langs))), langs=sorted(langs))


def date_range(start: datetime, end: datetime) -> Predicate:
    """From start to end, both included; the date column is compared too, so that partitions are pruned."""
    if start >= end:
        raise ValueError("the start has to be before the end")

    def build() -> Column:
        at = F.col("created_at")
        return F.col("created_date").between(F.lit(start.date()), F.lit(end.date())) & at.between(F.lit(start.isoformat(" ")).cast("timestamp_ntz"), F.lit(end.isoformat(" ")).cast("timestamp_ntz"))

    return _leaf("DateRange", build, start=start.isoformat(), end=end.isoformat())


def duration(text: str) -> timedelta:
    found = re.fullmatch(r"(\d+)(ms|s|m|h|d|w)", text.strip())
    if not found:
        raise ValueError(f"not a duration: {text!r}")
    return timedelta(milliseconds=int(found[1]) * _UNITS[found[2]])


def since(age: str, now: datetime) -> Predicate:
    return date_range(now - duration(age), now)


def until(age: str, now: datetime) -> Predicate:
    return date_range(datetime(1970, 1, 1), now - duration(age))


def _flag(tag: str, column: str) -> Callable[[], Predicate]:
    return lambda: _leaf(tag, lambda: F.col(column))


is_reply, is_quote, is_repost, is_original = _flag("IsReply", "is_reply"), _flag("IsQuote", "is_quote"), _flag("IsRepost", "is_repost"), _flag("IsOriginal", "is_original")
has_images, has_alt_text, has_video = _flag("HasImages", "has_images"), _flag("HasAltText", "has_alt_text"), _flag("HasVideo", "has_video")
has_links, has_media, has_embed = _flag("HasLinks", "has_links"), _flag("HasMedia", "has_media"), _flag("HasEmbed", "has_embed")


def engagement(likes: int | None = None, reposts: int | None = None, replies: int | None = None) -> Predicate:
    given = {k: v for k, v in {"like_count": likes, "repost_count": reposts, "reply_count": replies}.items() if v is not None}
    if not given or min(given.values()) < 0:
        raise ValueError("engagement: one threshold at least, none below 0")
    return _leaf("Engagement", lambda: functools.reduce(lambda a, b: a & b, [F.col(k) >= v if v else F.coalesce(F.col(k), F.lit(0)) >= 0 for k, v in given.items()]), **given)


def min_images(n: int) -> Predicate:
    _least(n, "images")
    return _leaf("MinImages", lambda: F.col("image_count") >= n, min=n)


def no_alt_text() -> Predicate:
    return _leaf("NoAltText", lambda: (F.col("image_count") > 0) & ~F.col("has_alt_text"))


def alt_text(text: str) -> Predicate:
    return _leaf("AltText", lambda: F.exists("images", lambda i: F.coalesce(F.lower(i["alt"]).contains(text.lower()), F.lit(False))), text=text)


def alt_text_regex(expression: str, flags: str = "") -> Predicate:
    made = pattern(expression, flags)
    return _leaf("AltTextRegex", lambda: F.exists("images", lambda i: F.coalesce(i["alt"].rlike(made), F.lit(False))), pattern=made)


def link_urls() -> Column:
    """A post's links and the link of its card, where it has one."""
    return F.concat(F.coalesce("links", F.array().cast("array<string>")), F.array_compact(F.array("external_link")))


def link_contains(text: str, case_sensitive: bool = False) -> Predicate:
    plain = (lambda u: u.contains(text)) if case_sensitive else (lambda u: F.lower(u).contains(text.lower()))
    return _leaf("LinkContains", lambda: F.exists(link_urls(), plain), text=text, caseSensitive=case_sensitive)


def link_regex(expression: str, flags: str = "") -> Predicate:
    made = pattern(expression, flags)
    return _leaf("LinkRegex", lambda: F.exists(link_urls(), lambda u: u.rlike(made)), pattern=made)


def named(library: dict[str, Predicate], name: str) -> Predicate:
    """A saved filter, by its name with or without ``@``."""
    key = name.removeprefix("@")
    if key not in library:
        raise ValueError(f"no filter named {key!r}")
    return library[key]


def for_authors(base: Predicate, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Predicate:
    include, exclude = list(include), list(exclude)
    parts = [base] + ([author_in(include)] if include else []) + ([~author_in(exclude)] if exclude else [])
    return all_of(*parts)


def _on_error(policy: str, known: Column, good: Column) -> Column:
    if policy not in ("include", "exclude", "strict"):
        raise ValueError(f"unknown policy {policy!r}")
    if policy == "strict":
        return F.when(known, good).otherwise(F.raise_error(F.lit("a lookup failed")).cast("boolean"))
    return F.when(known, good).otherwise(F.lit(policy == "include"))


#: How long a check of a link and a list of topics hold.
LINK_AGE, TOPIC_AGE = timedelta(hours=6), timedelta(minutes=15)


def _fresh(checks: DataFrame, now: datetime, age: timedelta) -> DataFrame:
    """Checks of ``checked_at`` that are not after ``now`` and younger than ``age``; the bounds reach the scan."""
    at = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    return checks.where((F.col("checked_at") <= at(now)) & (F.col("checked_at") > at(now - age)))


def newest_checks(status: DataFrame, now: datetime, age: timedelta = LINK_AGE) -> DataFrame:
    """``url`` and ``status`` of each url's newest check as of ``now`` in ``status(url, status, checked_at)``; of two at one time the higher status.

    Partial maxima keep a url that was checked very often cheap; urls without a check of that
    age have no row, so they are failed lookups.
    """
    newest = _fresh(status, now, age).groupBy("url").agg(F.max(F.struct("checked_at", "status")).alias("last"))
    return newest.select("url", F.col("last.status").alias("status"))


def newest_topics(trending: DataFrame, now: datetime, age: timedelta = TOPIC_AGE) -> DataFrame:
    """The topics of the newest list as of ``now`` in ``trending(topic, checked_at)``; none if no list is of that age."""
    fresh = _fresh(trending, now, age)
    last = fresh.agg(F.max("checked_at").alias("_last"))  # one row
    return fresh.join(F.broadcast(last), F.col("checked_at") == F.col("_last")).select("topic")


def with_valid_links(posts: DataFrame, status: DataFrame, key: str = "uri", on_error: str = "exclude", now: datetime | None = None, age: timedelta = LINK_AGE) -> DataFrame:
    """``posts`` with ``has_valid_links``: any own link is http(s) and answered 200 to 399 in ``status(url, status)``.

    With ``now``, ``status`` has ``checked_at`` too and of each url only the newest check as of
    then counts, if it is younger than ``age``.  Without, a url with several checks counts by
    its last ``checked_at`` if there is one, else by its highest status.  A link that the
    table lacks is a failed lookup and follows ``on_error``.
    """
    if now is not None:
        status = newest_checks(status, now, age)
    else:
        order = F.struct(*[c for c in ("checked_at", "status") if c in status.columns])
        status = status.groupBy("url").agg(F.max(order)["status"].alias("status"))
    links = posts.select(key, F.explode(F.array_distinct("links")).alias("url")).join(status.select("url", "status"), "url", "left")
    fine = F.col("url").rlike("^https?://") & F.col("status").between(200, 399)
    known = F.col("status").isNotNull() | ~F.col("url").rlike("^https?://")  # what is no web address is never looked up
    judged = links.groupBy(key).agg(F.bool_or(_on_error(on_error, known, fine)).alias("has_valid_links"))
    return posts.join(judged, key, "left").withColumn("has_valid_links", F.coalesce("has_valid_links", F.lit(False)))


def with_trending(posts: DataFrame, trending: DataFrame, tag: str, on_error: str = "exclude", now: datetime | None = None, age: timedelta = TOPIC_AGE) -> DataFrame:
    """``posts`` with ``is_trending``: whether the tag is among the topics now, the same for all posts.

    With ``now``, ``trending`` has ``checked_at`` and only the newest list as of then counts,
    if it is younger than ``age``.  A table without topics is a failed lookup and follows
    ``on_error``.
    """
    if now is not None:
        trending = newest_topics(trending, now, age)
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), "^#", "")
    topic = tag.strip().lower().removeprefix("#")
    found = trending.agg(F.count("topic").alias("n"), F.coalesce(F.bool_or(plain(F.col("topic")) == topic), F.lit(False)).alias("hit"))  # one row
    found = found.select(_on_error(on_error, F.col("n") > 0, F.col("hit")).alias("is_trending"))
    return posts.join(F.broadcast(found))


def tag_matches(posts: DataFrame, filters: dict[str, Predicate]) -> DataFrame:
    """One row a post and matching filter, in one scan, with the filter's name in ``filter``."""
    names = F.array_compact(F.array(*[F.when(p.column, F.lit(n)) for n, p in sorted(filters.items())]))
    return posts.withColumn("filter", F.explode(names))


def explain(posts: DataFrame, predicate: Predicate, key: str = "uri") -> DataFrame:
    """One row a post and node of the filter: ``path``, ``kind``, ``ok`` and ``skipped``.

    The right side of an and or an or is skipped where the left decides.
    """
    nodes: list[Column] = []

    def visit(p: Predicate, path: str, skipped: Column) -> None:
        nodes.append(F.struct(F.lit(path).alias("path"), F.lit(p.spec["tag"]).alias("kind"), F.when(~skipped, p.column).alias("ok"), skipped.alias("skipped")))
        for k, part in enumerate(p.parts):
            decided = F.lit(False)
            if k and p.spec["tag"] in ("And", "Or"):
                decided = ~p.parts[0].column if p.spec["tag"] == "And" else p.parts[0].column
            visit(part, f"{path}.{k}", skipped | decided)

    visit(predicate, "0", F.lit(False))
    return posts.select(key, F.explode(F.array(*nodes)).alias("n")).select(key, "n.*")


def match_rate(posts: DataFrame, predicate: Predicate, newest: int = 1000) -> DataFrame:
    """How many of the newest posts match: ``processed``, ``matched``, ``percent``."""
    some = posts.orderBy(F.desc("created_at"), F.desc("uri")).limit(_least(newest, "newest"))
    hits = F.coalesce(F.sum(predicate.column.cast("bigint")), F.lit(0))
    return some.agg(F.count("*").alias("processed"), hits.alias("matched")).withColumn("percent", F.round(100.0 * F.col("matched") / F.greatest("processed", F.lit(1)), 6))
