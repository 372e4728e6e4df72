"""Near-duplicate join of documents by n-gram Jaccard similarity, found by MinHash banding.

A document's n-grams are the five-word runs of its lower-cased (A-Z) words, which are runs
without space, tab, newline, vertical tab, form feed or carriage return; a text of one to
four words has all its words as one n-gram.  Two documents link if the Jaccard similarity of
their whole n-gram sets is at least 0.8.

Documents with equal sets are one node with a number of copies.  Band and row counts follow
from the target recall at the threshold.  Nodes are shuffled on band hashes; nodes of a band
bucket meet in the group of the bucket's smallest node, where all pairs are verified on the
full sets, block by block.  A pair that meets in several groups is counted in the first.

Defined results: null and empty texts have no n-grams and link with nothing.  Rows with the
same id are documents of their own (ids then no longer tell them apart, links and classes
still hold).  A null id takes part; a class of null ids only has the null class id.  Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import free_name, map_arrow, settle
from .linking import compare_groups, components
from .url_filter import BlockedBloom

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def banding(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = 160) -> tuple[int, int]:
    """Bands and rows: the most rows for which ``hashes`` values still reach ``recall``."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        need = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if need * rows <= hashes:
            best = (need, rows)
    return best


def gram_sets_of(column: pa.Array, size: int = WORDS) -> list[np.ndarray]:
    """For each text its whole set of n-gram hashes, ascending."""
    parts: list[list[np.ndarray]] = [[] for _ in range(len(column))]
    for first, data, at in words.segments(column):
        low = words.lowered(data)
        starts, ends, begin = words.spans(low, at)
        h = words.hashes(low, starts, ends)
        for k in range(len(at) - 1):
            parts[first + k].append(h[begin[k] : begin[k + 1]])
    lengths = np.array([sum(map(len, p)) for p in parts], np.int64)
    h = np.concatenate([x for p in parts for x in p]) if parts else np.zeros(0, np.uint64)
    mixed = mixed_runs(h, size)
    out = []
    for a, n in zip((np.cumsum(lengths) - lengths).tolist(), lengths.tolist()):
        own = mixed[a : a + n - size + 1] if n >= size else mixed_runs(h[a : a + n], n)
        out.append(np.unique(own))
    return out


def mixed_runs(h: np.ndarray, size: int) -> np.ndarray:
    """One hash for every run of ``size`` values."""
    count = max(len(h) - size + 1, 0) if size else 0
    mixed = np.full(count, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ h[k : count + k]) * _PRIME
        mixed ^= mixed >> np.uint64(29)
    return mixed


def multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_011)
    return rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def band_hashes(grams: np.ndarray, bands: int, rows: int, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """One 64-bit hash a band, of the minima of ``rows`` hash functions."""
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        part = grams[at : at + 2048]
        hashed = part[None, :] * mult[:, None]
        hashed += add[:, None]
        np.minimum(low, hashed.min(axis=1), out=low)
    low = (low >> np.uint64(17)).reshape(bands, rows)
    mixed = np.arange(1, bands + 1, dtype=np.uint64) * _PRIME
    for k in range(rows):
        mixed = (mixed ^ low[:, k]) * _PRIME
        mixed ^= mixed >> np.uint64(31)
    return mixed.view(np.int64)


def node_of(grams: np.ndarray) -> int | None:
    """One 64-bit id a set; none for the empty set."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True) if len(grams) else None


def sketches(docs: DataFrame, bands: int, rows: int, size: int = WORDS) -> DataFrame:
    """``doc_id``, ``text_hash``, ``node`` and ``bands`` of every row of ``docs(doc_id, text)``."""
    mult, add = multipliers(bands * rows)

    def sketch(batches):
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            sets = gram_sets_of(batch.column(1), size)
            yield {
                "doc_id": batch.column(0),
                "text_hash": batch.column(2),
                "node": [node_of(s) for s in sets],
                "bands": [band_hashes(s, bands, rows, mult, add) if len(s) else None for s in sets],
            }

    rows_in = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("text_hash"))
    return map_arrow(rows_in, sketch, "doc_id bigint, text_hash bigint, node bigint, bands array<bigint>")


def gram_sets(docs: DataFrame, size: int, wanted: BlockedBloom) -> DataFrame:
    """``node`` and ``grams`` (sorted 64-bit hashes as bytes) of the rows with n-grams whose id is null or may be wanted."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def sets(batches):
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            h, second = (c.fill_null(0).to_numpy() for c in batch.columns[1:])
            hit = shared.value.hits(h, second) | batch.column(1).is_null().to_numpy(zero_copy_only=False)
            found = [s for s in gram_sets_of(batch.column(0).filter(pa.array(hit)), size) if len(s)]
            yield {"node": [node_of(s) for s in found], "grams": [s.tobytes() for s in found]}

    h, second = BlockedBloom.asked(F.col("doc_id"))
    return map_arrow(docs.select("text", h.alias("h"), second.alias("second")), sets, "node bigint, grams binary")


def overlaps(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """The number of common n-grams of all pairs, by products over blocks of n-grams."""
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    grams, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = seen > 1
    number = np.cumsum(common) - 1
    use = common[column]
    row, column = row[use], number[column[use]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(common.sum()), chunk):
        lo, hi = np.searchsorted(column, [at, at + chunk])
        part = np.zeros((len(sets), min(chunk, int(common.sum()) - at)), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        out += part @ part.T
    return out


def alike(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    both = overlaps(sets).astype(np.float64)
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    return both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9


def shared_before(group: int, leaders: list[list[int]]) -> np.ndarray:
    """Whether two nodes also meet in the group of a smaller leader."""
    row = np.repeat(np.arange(len(leaders)), [len(x) for x in leaders])
    column = np.concatenate([np.array(x, dtype=np.int64) for x in leaders])
    early = column < group
    row, column = row[early], column[early]
    out = np.zeros((len(leaders), len(leaders)), bool)
    if len(column):
        names, column, seen = np.unique(column, return_inverse=True, return_counts=True)
        for at in range(0, len(names), 4096):
            use = (column >= at) & (column < at + 4096) & (seen[column] > 1)
            part = np.zeros((len(leaders), min(4096, len(names) - at)), np.float32)
            part[row[use], column[use] - at] = 1
            out |= part @ part.T > 0
    return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = 160, size: int = WORDS) -> DataFrame:
    """One row a document: ``doc_id``, ``text_hash``, ``component``, ``set_id``, ``class_id``, ``n_links``.

    ``set_id`` is the smallest id with the same n-gram set, ``class_id`` the smallest id
    reachable by links (a document without links is its own class), ``n_links`` the number
    of other documents that it links with directly, copies included.  ``component`` is null
    for documents without n-grams.
    """
    bands, rows = banding(similarity, recall, hashes)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketch = settle(sketches(docs, bands, rows, size))
    nodes = settle(sketch.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.first("bands").alias("bands")))
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    leaders = placed.groupBy("bucket").agg(F.min("node").alias("group"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = settle(placed.join(leaders, "bucket").select("group", "node").distinct())
    lists = members.groupBy("node").agg(F.collect_list("group").alias("leaders"))  # one a band at most
    wanted = settle(nodes.join(lists, "node").select("node", "copies", "first_id", "leaders"))
    # the sets of nodes that have a candidate, each from one of its rows; the join drops what the filter lets through beside
    sets = gram_sets(docs, size, BlockedBloom.build(wanted.select("first_id").distinct(), "first_id")).groupBy("node").agg(F.first("grams").alias("grams"))
    loaded = settle(wanted.select("node", "copies", "leaders").join(sets, "node"))

    def linked(group, members):
        matrix = alike([np.frombuffer(r[2], np.uint64) for r in members], similarity)
        return matrix & ~shared_before(group, [r[3] for r in members])

    found = settle(compare_groups(members, loaded, ["grams", "leaders"], linked))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.select("node", "copies", "first_id").join(counts, "node", "left").join(joined, "node", "left")
    named = settle(named.select("node", "first_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")))
    classes = named.groupBy("component").agg(F.min("first_id").alias("class_id"))
    named = named.join(classes, "component").select("node", "component", F.col("first_id").alias("set_id"), "class_id", "n_links")
    out = sketch.select("doc_id", "text_hash", "node").join(named, "node", "left")
    own = F.col("node").isNull()
    return out.select("doc_id", "text_hash", "component", F.when(own, F.col("doc_id")).otherwise(F.col("set_id")).alias("set_id"), F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class, that with the smallest id; those without n-grams all stay.

    Of a class's rows with equal ids the one with the smallest text hash stays, of equal rows
    one.  Rows that no class touches stay where they are; only the others, which a Bloom
    filter finds, are joined.
    """
    found = settle(near_duplicates(docs, **options).where("component is not null").select("doc_id", "text_hash", "component"))
    rows = found.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    judged = rows.join(first, "component").withColumn("stays", F.struct("doc_id", "text_hash").eqNullSafe(F.col("first")))
    touched = settle(judged.where("not stays or n > 1").select(F.xxhash64("doc_id", "text_hash").alias("mark"), "stays").groupBy("mark").agg(F.max("stays").alias("stays")))
    mark, stays = free_name(docs, "near_mark"), free_name(docs, "near_stays")
    marked = docs.withColumn(mark, F.xxhash64(F.col("doc_id").cast("bigint"), F.xxhash64("text")))
    possible = BlockedBloom.build(touched, "mark").maybe(docs.sparkSession, F.col(mark))
    known = touched.select(F.col("mark").alias(mark), F.col("stays").alias(stays))
    joined = settle(marked.where(possible).join(known, mark, "left"))
    apart = marked.where(~possible).select(*docs.columns)
    clean = joined.where(F.col(stays).isNull()).select(*docs.columns)
    single = joined.where(F.col(stays)).dropDuplicates([mark]).select(*docs.columns)
    return apart.unionByName(clean).unionByName(single)
