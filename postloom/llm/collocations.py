"""Collocations: frequent phrases of two and three words, by dynamic itemset counting.

Documents are dealt into ``SHARDS`` shards that are scanned in a cycle.  All words are
counted from the first scan on.  A longer phrase becomes active with the first scan before
which both its parts (without its last, and without its first word) have reached the
threshold, is counted in every shard from there and complete after one full cycle, so one
scan counts words, pairs and triples side by side.  A phrase that reaches the threshold has
parts that reach it, so every such phrase is activated and its count is exact.  The scans end
when all cycles do: after three times ``SHARDS`` scans at most.

A scan asks two tables of ``SLOTS`` bit masks for the scans at which words and pairs reached
the threshold, by hash.  What they let through is added up in the task, shuffled by phrase and
joined with the exact tables, which removes false hits; full tables only mean that more rows
are joined.  These masks are sent to all tasks, and the exact tables
while they have ``SMALL`` rows at most.

Words are runs of code points other than space, tab and ``[.,;:!?\\x0A-\\x0D]``; the latter also
part pieces, which no phrase crosses.  A-Z are lower-cased.  Words are compared by a 64-bit
hash that holds their language; two words with one hash that tasks report end in an error.

Defined results: a null text is empty, a null language is ``und``; languages without a
frequent phrase have no rows.  Repeated rows count each, extra columns are ignored, an empty
table gives an empty one.  Words of a language in ``n`` are all, frequent or not.
"""

from __future__ import annotations

import gc
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, release, settle, shared_dir
from .words import hashes, lowered, numbered, segments, texts_at

#: Occurrences of a phrase, shards of a cycle, rows a language, slots of a mask table, percent of a phrase within a longer one.
LEAST, SHARDS, TOP, SLOTS, INSIDE = 10, 2, 2000, 1 << 22, 50
#: Frequent words, or pairs, that are sent to all tasks; with more, counts are joined by shuffle.
SMALL = 500_000
_BLOCK = 1 << 16
_FLUSH = 1 << 19
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True
_MIX = np.uint64(0x9FB21C651E98DF25)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(35))) * _MIX
    return h ^ (h >> np.uint64(28))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two words' keys in order."""
    return _mixed(_mixed(a.view(np.uint64)) + b.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def slot_of(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint64) >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)


def phrases(texts: pa.Array, langs: list[str]):
    """For each stretch of words: keys, whether each is followed by the next in its piece, how many at the start were given before, and the new words' bytes, starts, ends and texts' numbers."""
    seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)
    none = np.zeros(0, np.uint64), np.zeros(0, bool)
    before, tail, is_open = None, none, False
    for text, data, at in segments(texts):
        data = lowered(data)
        gap, stop = _GAP[data], _BREAK[data]
        edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
        first = ~gap
        first[1:] &= gap[:-1]
        first[edges] = ~gap[edges]
        last = ~gap
        last[:-1] &= gap[1:]
        last[edges - 1] = ~gap[edges - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        if text != before:
            tail, is_open = none, False
        whose = text + np.searchsorted(at, starts, side="right") - 1
        pieces = np.concatenate([[0], np.cumsum(stop)])
        if not len(starts):
            is_open &= not stop.any()
            before = text
            continue
        key = _mixed(hashes(data, starts, ends) + seeds[whose])
        follows = np.zeros(len(key), bool)
        follows[:-1] = (whose[1:] == whose[:-1]) & (pieces[starts[1:]] == pieces[ends[:-1]])
        old = len(tail[0])
        if old:
            tail[1][-1] = is_open and not pieces[starts[0]]
        keys, chain = np.concatenate([tail[0], key]), np.concatenate([tail[1], follows])
        yield keys, chain, old, data, starts, ends, whose
        before, is_open = text, bool(pieces[-1] == pieces[ends[-1]])
        tail = (keys[-2:].copy(), chain[-2:].copy()) if len(at) == 2 else none


class Tally:
    """Phrases of one length added up within a task: columns of keys, counts and, for words, their texts and languages."""

    def __init__(self, size: int):
        self.size, self.held, self.pending = size, [], 0

    def add(self, columns: list[np.ndarray], mark: np.ndarray, extra=None) -> None:
        if len(mark):
            _, codes, seen = numbered(mark)
            told = extra(seen) if extra else None
            self.held.append((mark[seen], [c[seen] for c in columns], np.bincount(codes), told))
            self.pending += len(seen)

    def taken(self, least: int = 1):
        """What is held, as columns, if there are ``least`` rows; then nothing is."""
        if self.pending < least or not self.held:
            return
        mark, columns, counts, told = zip(*self.held)
        mark = np.concatenate(mark)
        _, codes, seen = numbered(mark)
        columns = [np.concatenate(c)[seen].view(np.int64) for c in zip(*columns)]
        counts = np.bincount(codes, np.concatenate(counts)).astype(np.int64)
        n, none = len(seen), pa.nulls(len(seen), pa.int64())
        take = pa.array(seen)
        word, lang = (pa.concat_arrays([t[k] for t in told]).take(take) for k in (0, 1)) if self.size == 1 else (pa.nulls(n, pa.string()),) * 2
        self.held, self.pending = [], 0
        yield {"size": np.full(n, self.size, np.int32), **{f"k{j + 1}": columns[j] if j < self.size else none for j in range(3)}, "n": counts, "lang": lang, "word": word}


def scanned(docs: DataFrame, count_words: bool, words: np.ndarray | None, pairs: np.ndarray | None, recent: int) -> DataFrame:
    """Sums by task of words, and of pairs and triples that may be active, in ``docs(lang, text)``.

    ``words`` and ``pairs`` are mask tables; ``recent`` has the bits of the scans that began the cycles still open.
    """
    shared = docs.sparkSession.sparkContext.broadcast((words, pairs))

    def rows(batches):
        marks, pair_marks = shared.value
        tallies = [Tally(1), Tally(2), Tally(3)]
        for batch in batches:
            langs = batch.column(0).to_pylist()
            told = np.array(langs, object)
            for keys, chain, old, data, starts, ends, whose in phrases(batch.column(1), langs):
                if count_words:
                    tallies[0].add([keys[old:]], keys[old:], lambda seen: (texts_at(data, starts[seen], ends[seen]), pa.array(told[whose[seen]], pa.string())))
                if marks is not None and len(keys) > 1:
                    own = marks[slot_of(keys)]
                    at = np.flatnonzero(chain[:-1] & (own[:-1] > 0) & (own[1:] > 0) & (((own[:-1] | own[1:]) & recent) > 0))
                    at = at[at + 1 >= old]
                    tallies[1].add([keys[at], keys[at + 1]], pair_key(keys[at], keys[at + 1]))
                if pair_marks is not None and len(keys) > 2:
                    at = np.flatnonzero(chain[:-2] & chain[1:-1])
                    at = at[at + 2 >= old]
                    left, right = (pair_key(keys[at + k], keys[at + k + 1]) for k in (0, 1))
                    a, b = pair_marks[slot_of(left)], pair_marks[slot_of(right)]
                    use = (a > 0) & (b > 0) & (((a | b) & recent) > 0)
                    at = at[use]
                    tallies[2].add([keys[at + k] for k in range(3)], pair_key(left[use], keys[at + 2]))
                for t in tallies:
                    yield from t.taken(_FLUSH)
        for t in tallies:
            yield from t.taken()

    return map_arrow(docs.select("lang", "text"), rows, "size int, k1 bigint, k2 bigint, k3 bigint, n bigint, lang string, word string")


class Reached:
    """What has reached the threshold so far: mask tables for scans, and how many phrases there are."""

    def __init__(self):
        self.masks, self.count, self.last = np.zeros(SLOTS, np.uint16), 0, None

    def add(self, phrases: DataFrame, keys: list[str], reach: int) -> None:
        """Note the phrases whose ``reach`` is this scan; slots are made in blocks, each by a task."""

        def slots(batches):
            for batch in batches:
                code = [batch.column(k).to_numpy() for k in range(len(keys))]
                at = slot_of(code[0] if len(keys) == 1 else pair_key(*code))
                yield {"block": at // _BLOCK, "at": at % _BLOCK}

        def pack(batches):
            whole: dict[int, list] = {}
            for batch in batches:
                block, at = (c.to_numpy() for c in batch.columns)
                for b in np.unique(block).tolist():
                    own = whole.setdefault(b, [0, np.zeros(_BLOCK, bool)])
                    own[0] += int((block == b).sum())
                    own[1][at[block == b]] = True
            if whole:
                yield {"block": list(whole), "n": [n for n, _ in whole.values()], "bits": [np.packbits(m).tobytes() for _, m in whole.values()]}

        at = map_arrow(phrases.where(F.col("reach") == reach).select(*keys), slots, "block bigint, at bigint").repartition("block")
        for row in map_arrow(at, pack, "block bigint, n bigint, bits binary").collect():  # SLOTS / _BLOCK rows at most
            bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
            self.masks[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK][bits] |= np.uint16(1 << reach)
            self.count, self.last = self.count + row["n"], reach

    def open_at(self, step: int, shards: int) -> bool:
        """Whether a cycle that began with one of them is still open."""
        return self.last is not None and step < self.last + shards

    def joined(self, rows: DataFrame, phrases: DataFrame, size: int, names: dict[str, str], step: int, reach: str) -> DataFrame:
        """``rows`` with ``reach``: when the part of a phrase of ``size`` words that the columns ``names`` hold reached the threshold, if before scan ``step``."""
        known = phrases.where(F.col("reach") <= step).select(*[F.col(old).alias(f"_{new}") for new, old in names.items()], F.col("reach").alias(reach))
        match = F.col("size") == size
        for new in names:
            match &= F.col(new) == F.col(f"_{new}")
        return rows.join(F.broadcast(known) if self.count <= SMALL else known, match, "left").drop(*[f"_{new}" for new in names])


_KEYS = ["size", "k1", "k2", "k3", "lang", "word"]


def _settled(counts: DataFrame) -> DataFrame:
    """Counts in folders by length."""
    spark = counts.sparkSession
    path = f"{shared_dir(spark)}/counts-{uuid.uuid4().hex}"
    counts.write.partitionBy("size").parquet(path)
    out = spark.read.schema("k1 bigint, k2 bigint, k3 bigint, lang string, word string, n bigint, reach int, begun int, size int").parquet(path)
    out.settled_at = path
    return out


def drop_shuffles(spark) -> None:
    """Let Spark delete the shuffle files of plans that nothing holds any more; it does so when their objects are collected, which can be long after."""
    gc.collect()
    spark._jvm.System.gc()


def counted(docs: DataFrame, least: int = LEAST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (``k1``, ``lang``, ``word``, ``n``), pairs and triples (``k1``, ``k2``, ``k3``, ``n``) of ``docs(text, lang)``; counts of ``least`` or more are exact.

    A scan's sums go through one shuffle, together with the counts so far.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    own.withColumn("shard", F.pmod(F.xxhash64("text", "lang"), F.lit(shards)).cast("int")).write.partitionBy("shard").parquet(path)
    dealt = spark.read.schema("lang string, text string, shard int").parquet(path)
    of_words, of_pairs = Reached(), Reached()
    words = held = None
    step = 0
    while step < shards or of_words.open_at(step, shards) or of_pairs.open_at(step, shards):
        recent = sum(1 << r for r in range(max(0, step - shards + 1), step + 1))  # the scans whose cycles are open
        use_words, use_pairs = of_words.open_at(step, shards), of_pairs.open_at(step, shards)
        rows = scanned(dealt.where(F.col("shard") == step % shards), step < shards, of_words.masks if use_words else None, of_pairs.masks if use_pairs else None, recent)
        begun = F.lit(None).cast("int")
        if use_words:
            known = held if words is None else words
            rows = of_words.joined(of_words.joined(rows, known.where("size = 1"), 2, {"k1": "k1"}, step, "a1"), known.where("size = 1"), 2, {"k2": "k1"}, step, "a2")
            begun = F.coalesce(begun, F.when(F.col("a2").isNotNull(), F.col("a1") + F.greatest(F.col("a2") - F.col("a1"), F.lit(0))))
        if use_pairs:
            pairs = held.where("size = 2")
            rows = of_pairs.joined(of_pairs.joined(rows, pairs, 3, {"k1": "k1", "k2": "k2"}, step, "b1"), pairs, 3, {"k2": "k1", "k3": "k2"}, step, "b2")
            begun = F.coalesce(begun, F.when(F.col("b2").isNotNull(), F.col("b1") + F.greatest(F.col("b2") - F.col("b1"), F.lit(0))))
        rows = rows.select(*_KEYS, "n", F.lit(None).cast("int").alias("reach"), begun.alias("begun")).where((F.col("size") == 1) | (F.col("begun") > step - shards))
        if held is not None:
            rows = rows.unionByName(held if words is None else held.where("size > 1"))
        sums = rows.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.min("reach").alias("reach"), F.min("begun").alias("begun"))
        # a phrase whose cycle ends with this scan and that is still rare will not be frequent
        live = sums.where((F.col("size") == 1) | (F.col("n") >= least) | (F.col("begun") > step - shards + 1))
        now = _settled(live.withColumn("reach", F.coalesce("reach", F.when(F.col("n") >= least, F.lit(step + 1)))))
        if step < shards:
            of_words.add(now.where("size = 1"), ["k1"], step + 1)
        if use_words:
            of_pairs.add(now.where("size = 2"), ["k1", "k2"], step + 1)
        if held is not None and held is not words:
            release(held)
        if step == shards - 1:
            words = now  # complete; later tables hold longer phrases only
        held, step = now, step + 1
        del rows, sums, live
        drop_shuffles(spark)
    dealt.settled_at = path
    release(dealt)
    words = words.where("size = 1").select("k1", "lang", "word", "n")
    if not words.groupBy("k1").count().where("count > 1").isEmpty():
        raise ValueError("two words with one hash")
    return words, held.where("size = 2").select("k1", "k2", "n"), held.where("size = 3").select("k1", "k2", "k3", "n")


def share(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact: 38 digits hold counts up to 10 ** 15."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * wide(a) * wide(a), wide(left) * wide(right))


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE, shards: int = SHARDS) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of each language's first ``top`` phrases."""
    words, pairs, triples = counted(docs, least, shards)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    word = lambda k: words.where(F.col("n") >= least).select(F.col("k1").alias(f"k{k}"), F.col("n").alias(f"f{k}"), F.struct("lang", "word").alias(f"w{k}"))
    two, three = (x.where(F.col("n") >= least) for x in (pairs, triples))
    longer = three.select("k1", "k2", "n").unionByName(three.select(F.col("k2").alias("k1"), F.col("k3").alias("k2"), "n")).groupBy("k1", "k2").agg(F.max("n").alias("most"))
    kept = two.join(longer, ["k1", "k2"], "left").where(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("n")))
    a = F.col("a")
    of_two = kept.withColumnRenamed("n", "a").join(word(1), "k1").join(word(2), "k2")
    of_two = of_two.select(F.col("w1.lang").alias("lang"), F.concat_ws(" ", "w1.word", "w2.word").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), share(a, F.col("f1"), F.col("f2")).alias("score"))
    front = two.select("k1", "k2", F.col("n").alias("f12"))
    back = two.select(F.col("k1").alias("k2"), F.col("k2").alias("k3"), F.col("n").alias("f23"))
    of_three = three.withColumnRenamed("n", "a").join(front, ["k1", "k2"]).join(back, ["k2", "k3"]).join(word(1), "k1").join(word(2), "k2").join(word(3), "k3")
    of_three = of_three.withColumns({"s1": share(a, F.col("f1"), F.col("f23")), "s2": share(a, F.col("f12"), F.col("f3"))})
    early = F.col("s1") <= F.col("s2")
    cut = lambda x, y: F.when(early, F.col(x)).otherwise(F.col(y))
    of_three = of_three.select(F.col("w1.lang").alias("lang"), F.concat_ws(" ", "w1.word", "w2.word", "w3.word").alias("phrase"), "a", cut("f1", "f12").alias("l"), cut("f23", "f3").alias("r"), cut("s1", "s2").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = of_two.unionByName(of_three).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
