"""URL filtering: rules, and a blocked Bloom filter in front of an exact join with a list.

A listed URL is blocked.  URLs are compared in canonical form: scheme, user, port, fragment,
a leading ``www.`` or ``m.``, tracking parameters and a trailing slash are dropped, the host
is lower-cased and the other parameters are sorted.  Each key sets a few bits in one 512-bit
block of the filter, so a test touches one block.  The filter has a fixed largest size; a
longer list only makes more possible hits, and the exact join drops every false one.

Defined results: a null URL, or one without ``://``, has empty host and path, fits no rule
and is never listed, so it is allowed.  Repeated rows are judged each; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: (host, path, verdict)
Rule = tuple[str, str, str]
_SEED = 991
_PROBES = 8
_WORDS = 8  # 64-bit words a block
MAX_BITS = 1 << 26
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The form in which URLs are compared, or null if there is no host."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host_of(url), r"^.*@", ""), r":\d*$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?i:{TRACKING})(=|$)")))
    rest = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, path, rest))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule[0]) | host.endswith(f".{rule[0]}")) & path.startswith(rule[1])


def ruled(rules: list[Rule], host: Column, path: Column) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null; equal lengths go to the first in order."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):  # a later layer stands before an earlier one
        out = F.when(fits(rule, host, path), F.struct(F.lit(rule[0] + rule[1]).alias("rule"), F.lit(rule[2]).alias("verdict"))).otherwise(out)
    return out


class BlockedBloom:
    """A filter over the 64-bit hashes of a key column.

    It is built by a grouped OR of 64-bit masks; at most ``max_bits`` reach the driver and
    are broadcast (8 MB by default), however long the list is.  A list too long for 16 bits a
    key sets fewer bits a key, which keeps the share of false hits as low as the size allows.
    """

    def __init__(self, blocks: int, words: np.ndarray, probes: int = _PROBES):
        self.blocks, self.words, self.probes = blocks, words, probes

    @staticmethod
    def key(column: Column) -> Column:
        return F.xxhash64(column, F.lit(_SEED))

    @classmethod
    def build(cls, keys: DataFrame, column: str, bits_per_key: int = 16, max_bits: int = MAX_BITS) -> BlockedBloom:
        """From the non-null values of ``column``."""
        some = keys.select(F.col(column).alias("k")).where("k is not null")
        count = some.count()
        blocks = 1
        while blocks * 64 * _WORDS < min(count * bits_per_key, max_bits):
            blocks *= 2
        number = max(1, min(_PROBES, round(0.69 * blocks * 64 * _WORDS / max(count, 1))))
        h = some.select(cls.key(F.col("k")).alias("h"))
        # the block from the low bits, each probe from 9 others of a second hash
        block = F.pmod("h", F.lit(blocks)).alias("block")
        second = F.xxhash64("h")
        probes = F.array(*[F.shiftrightunsigned(second, 7 * k).bitwiseAND(F.lit(511)) for k in range(number)])
        bits = h.select(block, F.explode(probes).alias("bit"))
        words = bits.groupBy("block", F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
        out = np.zeros(blocks * _WORDS, np.int64)
        got = words.toPandas()
        out[got["block"].to_numpy(np.int64) * _WORDS + got["word"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64)
        return cls(blocks, out, number)

    @classmethod
    def asked(cls, column: Column) -> tuple[Column, Column]:
        """The two hashes by which ``hits`` tests a column's values, null for null."""
        h = cls.key(column)
        return F.when(column.isNotNull(), h), F.when(column.isNotNull(), F.xxhash64(h))

    def hits(self, h: np.ndarray, second: np.ndarray) -> np.ndarray:
        """False only for hashes that are not in the filter."""
        base = (h % self.blocks) * _WORDS
        other = second.view(np.uint64)
        hit = np.ones(len(base), bool)
        for k in range(self.probes):
            bit = ((other >> np.uint64(7 * k)) & np.uint64(511)).astype(np.int64)
            hit &= (self.words[base + (bit >> 6)] >> (bit & 63)) & 1 == 1
        return hit

    def maybe(self, spark, column: Column) -> Column:
        """False only for values that are not in the filter; null is in none."""
        small_batches()
        shared = spark.sparkContext.broadcast(self)

        @F.pandas_udf("boolean")
        def test(h: pd.Series, second: pd.Series) -> pd.Series:
            return pd.Series(shared.value.hits(h.to_numpy(np.int64), second.to_numpy(np.int64)))

        h = self.key(column)
        return column.isNotNull() & test(h, F.xxhash64(h))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule]) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``listed`` of every row of ``pages(page_id, url)``.

    ``listed(url)`` is the list, of any length and with repeats.  A rule's verdict stands
    before the list's.
    """
    spark = pages.sparkSession
    keys = listed.select(canonical(F.col("url")).alias("key")).where("key is not null").distinct()
    bloom = BlockedBloom.build(keys, "key")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("key"))
    rows = rows.withColumn("r", ruled(rules, F.col("host"), F.col("path"))).withColumn("possible", bloom.maybe(spark, F.col("key")))
    # only possible hits carry a key into the join; the others stay where they are
    out = ["page_id", "host", "path", "r"]
    hits = rows.where("possible").join(keys.withColumn("listed", F.lit(True)), "key", "left").select(*out, F.coalesce("listed", F.lit(False)).alias("listed"))
    rest = rows.where("not possible").select(*out, F.lit(False).alias("listed"))
    both = hits.unionByName(rest)
    verdict = F.coalesce("r.verdict", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return both.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "listed")
