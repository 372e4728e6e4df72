"""Mixing sources to target weights by drawing fixed-length blocks.

The words of each source, document after document, are one sequence cut into blocks.  Each
output shard has a fixed number of slots, whose counts a source are one multinomial draw; a
source's slots, numbered across shards, go through a pseudorandom permutation of its block
indexes, a new one for each pass over the source, and blocks are joined by index.  Slots
drawn beyond a source's total are handed to sources drawn below theirs, so the totals are
exact to a block and no block is taken more often than the cap allows.

Sources in order of code point, null last, weigh ``weights`` in turn.  Targets are weighted
shares of all words; a target stops at ``most`` times its source's size and the excess is
shared by weight among the others until none is above.

Only one row a source (name, size, documents) reaches the driver.  Running word offsets are
taken within hashed buckets and then over bucket sums, so a hot source is in many tasks.

Defined results: a null or blank text has size 0 and is never taken; a source of such
documents only has target 0; null is a source of its own.  Rows with the same id are
documents of their own.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import free_name, map_arrow, settle, small_batches

WEIGHTS, MOST, BLOCK, SLOTS, SEED = (5.0, 2.0, 1.0), 3, 64, 65_536, 17
_CHUNK = 200_000
#: Sources whose table (about 100 bytes a row) is broadcast.
SMALL = 10_000
#: Tasks at most that turn shards into slots; each goes through its shards one after another.
EXPANDING = 20_000


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    small_batches()

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), np.int64)
        for first, data, at in words.segments(pa.array(texts, pa.string())):
            begin = words.spans(data, at)[2]
            out[first : first + len(at) - 1] += np.diff(begin)
        return pd.Series(out)

    return count(text)


def mark_of(docs: DataFrame) -> Column:
    """16 bytes that tell rows apart by id, source and text."""
    text = F.coalesce(F.md5("text"), F.lit("-"))
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), text, F.coalesce(F.concat(F.lit(" "), F.col("source").cast("string")), F.lit("")))))


def share_out(sizes: list[int], weights: list[float], most: float, share: float = 1.0) -> list[float]:
    """Targets by weight of ``share`` of all words, none above ``most`` times its size."""
    targets, total = [0.0] * len(sizes), share * sum(sizes)
    free = [k for k, n in enumerate(sizes) if n]
    left = total
    while free:
        whole = sum(weights[k] for k in free)
        above = [k for k in free if left * weights[k] / whole > most * sizes[k]]
        if not above:
            for k in free:
                targets[k] = left * weights[k] / whole
            break
        for k in above:
            targets[k] = float(most * sizes[k])
            left -= targets[k]
        free = [k for k in free if k not in set(above)]
    return targets


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where each index below ``n`` goes in a keyed permutation: a Feistel network, walked until below ``n``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 2**63, 4, dtype=np.uint64) | np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            mixed = (right ^ (k >> np.uint64(40))) * k
            left, right = right, left ^ ((mixed >> np.uint64(33)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


class Draw:
    """The plan of all shards: totals a source and what each shard drew."""

    def __init__(self, sources: list[str | None], sizes: list[int], targets: list[float], block: int, slots: int, most: int, seed: int):
        self.seed, self.slots = seed, slots
        self.blocks = np.array([-(-n // block) for n in sizes], dtype=np.int64)
        want = [round(t * b / n) if n else 0 for t, b, n in zip(targets, self.blocks.tolist(), sizes)]
        self.want = np.minimum(np.array(want, dtype=np.int64), most * self.blocks)
        self.total = int(self.want.sum())
        self.shards = -(-self.total // slots)
        self.keys = [zlib.crc32(b"\0" if s is None else s.encode()) for s in sources]

    def counts(self, shard: int) -> np.ndarray:
        here = min(self.slots, self.total - shard * self.slots)
        return np.random.default_rng([self.seed, shard]).multinomial(here, self.want / self.total)

    def settle_surplus(self, drawn: np.ndarray) -> None:
        """From the drawn totals, who gives slots away and who gets them."""
        self.drawn = drawn
        over, under = np.maximum(drawn - self.want, 0), np.maximum(self.want - drawn, 0)
        self.gives, self.gets = np.cumsum(over) - over, np.cumsum(under) - under
        self.under = np.flatnonzero(under)

    def slots_of(self, source: int, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Source and block of the slots number ``first`` and on of a source."""
        j = np.arange(first, first + count, dtype=np.int64)
        own = np.full(count, source, dtype=np.int64)
        far = np.flatnonzero(j >= self.want[source])
        if len(far):
            place = self.gives[source] + j[far] - self.want[source]
            to = self.under[np.searchsorted(self.gets[self.under], place, side="right") - 1]
            own[far], j[far] = to, self.drawn[to] + place - self.gets[to]
        block = np.empty(count, dtype=np.int64)
        for s in np.unique(own):
            n = int(self.blocks[s])
            mine = np.flatnonzero(own == s)
            epoch = j[mine] // n
            for e in np.unique(epoch):
                at = mine[epoch == e]
                block[at] = permuted(j[at] - e * n, n, (self.keys[s] << 20) + (int(e) << 10) + self.seed)
        return own, block


def placed(docs: DataFrame, known: DataFrame, buckets: int) -> DataFrame:
    """Documents with their source's number and where their words start in its sequence."""
    docs = docs.join(known, docs["source"].eqNullSafe(known["name"])).drop("name", "source")
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("mark"), F.lit(buckets)))
    sums = docs.groupBy("ord", "bucket").agg(F.sum("size").alias("whole"))
    before = Window.partitionBy("ord").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("ord", "bucket", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("ord", "bucket").orderBy("doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    running = docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return running.join(offsets.hint("merge"), ["ord", "bucket"]).withColumn("start", F.col("offset") + F.col("inside")).drop("bucket", "offset", "inside")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """What the mix takes of ``docs(doc_id, text, source)``.

    The first table has one row a document: ``doc_id``, ``mark``, ``source``, ``size``,
    ``source_size``, ``target``, ``taken`` and ``draws``, the words [from, to) of each of its
    drawn blocks with how many times they are taken.  The second has one row a slot:
    ``shard``, ``ord``, ``source`` and ``block``.
    """
    spark = docs.sparkSession
    sized = settle(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), mark_of(docs).alias("mark"), n_words(F.col("text")).alias("size")))
    stats = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()
    stats.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    names, sizes = [r["source"] for r in stats], [int(r["n"]) for r in stats]
    targets = share_out(sizes, [weights[k % len(weights)] for k in range(len(sizes))], most)
    known = spark.createDataFrame([(n, k, s, t) for k, (n, s, t) in enumerate(zip(names, sizes, targets))], "name string, ord int, source_size bigint, target double")
    if len(names) <= SMALL:  # else a shuffle join, which adaptive execution splits at a hot source
        known = F.broadcast(known)
    draw = Draw(names, sizes, targets, block, slots, most, seed)

    def shards(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts = draw.counts(shard)
                ords = np.flatnonzero(counts)
                yield {"shard": np.full(len(ords), shard, np.int64), "ord": ords.astype(np.int32), "n": counts[ords].astype(np.int64)}

    drawn = settle(map_arrow(spark.range(draw.shards).repartition(max(1, draw.shards // 64)), shards, "shard bigint, ord int, n bigint"))
    totals = np.zeros(len(names), np.int64)
    for row in drawn.groupBy("ord").agg(F.sum("n").alias("n")).collect():
        totals[row["ord"]] = row["n"]
    draw.settle_surplus(totals)

    def expand(batches):
        for batch in batches:
            for shard, source, first, n in zip(*[c.to_pylist() for c in batch.columns]):
                for at in range(0, n, _CHUNK):
                    own, blocks = draw.slots_of(source, first + at, min(_CHUNK, n - at))
                    yield {"shard": np.full(len(own), shard, np.int64), "ord": own.astype(np.int32), "block": blocks}

    earlier = Window.partitionBy("ord").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = drawn.select("shard", "ord", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"), "n")
    # few and short rows that become long ones: adaptive execution must not put them together
    dealt = map_arrow(numbered.repartition(max(1, min(draw.shards, EXPANDING)), "shard", "ord"), expand, "shard bigint, ord int, block bigint")
    times = dealt.groupBy("ord", "block").agg(F.count("*").alias("times"))

    # as many buckets as rows in each, so neither level of the running sums outgrows the other
    rows = settle(placed(sized, known, max(1, math.isqrt(sum(int(r["docs"]) for r in stats)))))
    end = F.col("start") + F.col("size")
    parts = rows.where("size > 0").select("ord", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block"))
    parts = parts.join(times.hint("merge"), ["ord", "block"])  # both sides grow; small when compressed only
    lo = F.greatest(F.col("block") * block, F.col("start")) - F.col("start")
    hi = F.least((F.col("block") + 1) * block, end) - F.col("start")
    draws = parts.groupBy("ord", "start").agg(F.sum((hi - lo) * F.col("times")).alias("taken"), F.array_sort(F.collect_list(F.struct(lo.alias("from"), hi.alias("to"), F.col("times")))).alias("draws"))
    # of the rows that start at one place, one alone has words
    out = rows.withColumn("real", F.col("size") > 0).join(draws.withColumn("real", F.lit(True)).hint("merge"), ["ord", "start", "real"], "left")
    source = known.select("ord", F.col("name").alias("source"))
    if len(names) <= SMALL:
        source = F.broadcast(source)
    out = out.join(source, "ord").select("doc_id", "mark", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "draws")
    return out, dealt.join(source, "ord")


def mixed_documents(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """``docs`` as the mix takes them: one row for each time a document is taken.

    The k-th copy of a document holds the words that are taken k times or more: its whole
    text if they are all, else one row for each run of blocks.  Rows equal in id, text and
    source are merged into one before.  ``n_chars``, if there, follows.
    """
    plan, _ = mix(docs, seed=seed, **options)
    # equal rows add up range by range first, so a list is never longer than its text
    plan = plan.select("mark", "size", F.explode("draws").alias("d")).groupBy("mark", "d.from", "d.to").agg(F.first("size").alias("size"), F.sum("d.times").alias("times"))
    plan = plan.groupBy("mark").agg(F.first("size").alias("size"), F.collect_list(F.struct("from", "to", "times")).alias("draws"))
    mark, draws, size, made = (free_name(docs, f"mix_{n}") for n in ("mark", "draws", "size", "made"))
    plan = plan.select(F.col("mark").alias(mark), F.col("draws").alias(draws), F.col("size").alias(size))
    # texts are shuffled once: the join deals them by mark, and equal rows are then in one task
    joined = docs.withColumn(mark, mark_of(docs)).join(plan.hint("merge"), mark).dropDuplicates([mark])
    parts = F.pandas_udf(cut, "array<struct<text:string,n:bigint>>")(F.col("text"), F.col(f"{draws}.from"), F.col(f"{draws}.to"), F.col(f"{draws}.times"), F.col(size))
    out = joined.withColumn(made, F.explode(parts))
    out = out.withColumn(size, F.explode(F.sequence(F.lit(1), F.col(f"{made}.n"))))
    text = F.col(f"{made}.text")
    columns = [text.alias(c) if c == "text" else F.length(text).cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*columns)


def cut(texts: pd.Series, froms: pd.Series, tos: pd.Series, times: pd.Series, sizes: pd.Series) -> pd.Series:
    """The texts that a document's draws leave, and how many times each is wanted."""
    out = []
    for text, lo, hi, n, size in zip(texts, froms, tos, times, sizes):
        depth = np.zeros(size + 1, np.int64)
        np.add.at(depth, np.asarray(lo, np.int64), np.asarray(n, np.int64))
        np.add.at(depth, np.asarray(hi, np.int64), -np.asarray(n, np.int64))
        depth = np.cumsum(depth[:-1])
        levels = np.unique(depth)
        levels = levels[levels > 0]
        raw, spans, made = text.encode(), None, []
        for level, below in zip(levels.tolist(), [0, *levels.tolist()]):
            use = depth >= level
            if use.all():
                made.append({"text": text, "n": level - below})
                continue
            if spans is None:
                data = np.frombuffer(raw, np.uint8)
                spans = words.spans(data, np.array([0, len(data)]))
            edges = np.flatnonzero(np.diff(np.concatenate([[False], use, [False]])))
            made += [{"text": raw[spans[0][a] : spans[1][b - 1]].decode(), "n": level - below} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
        out.append(made)
    return pd.Series(out)
