"""Packing documents into token sequences: first-fit decreasing in randomised groups.

Documents are dealt at random into groups of a bounded number of bytes, and each group is
packed by one task on its own.  A document's whole multiples of the sequence length are
sequences of their own; the rests, longest first, go to the first sequence with room, found
in a tournament tree of what room each has.  Then the emptiest sequences are cut up to fill
the gaps of the others, and what remains of the last is cut at powers of two, which need no
padding.

Defined results: a null or empty text is one piece with the end token alone.  Rows with the
same id are documents of their own.  An empty table gives no pieces.  Extra columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .tokenizing import word_cache

LENGTH, END, GROUP_BYTES = 4096, 2, 24 << 20
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: (document, start, length)
Piece = tuple[int, int, int]


class Room:
    """A tournament tree: each node holds the most room of the sequences below it."""

    def __init__(self, count: int, capacity: int):
        self.leaves = 1
        while self.leaves < count:
            self.leaves *= 2
        self.most = [capacity] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """Put ``size`` into the first sequence that has room for it."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < size:
                at += 1
        most[at] -= size
        bin_ = at - self.leaves
        while at > 1:
            at //= 2
            best = max(most[2 * at], most[2 * at + 1])
            if most[at] == best:
                break
            most[at] = best
        return bin_


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items a bin; every size is from 1 to ``capacity``."""
    room, bins = Room(max(1, len(sizes)), capacity), []
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = room.take(sizes[item])
        while len(bins) <= at:
            bins.append([])
        bins[at].append(item)
    return bins


def pack(sizes: list[int], capacity: int = LENGTH) -> list[list[Piece]]:
    """Sequences of pieces that cover all documents of the given sizes (1 or more each)."""
    done: list[list[Piece]] = []
    rests: list[Piece] = []
    for doc, size in enumerate(sizes):
        whole = size - size % capacity
        done += [[(doc, at, capacity)] for at in range(0, whole, capacity)]
        if size > whole:
            rests.append((doc, whole, size - whole))
    bins = [[rests[k] for k in b] for b in first_fit_decreasing([r[2] for r in rests], capacity)]
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: (-used[k], k))
    open_ = [k for k in order if used[k] < capacity]
    done += [bins[k] for k in order if used[k] == capacity]
    low, high = len(open_) - 1, 0
    while high < low:
        at, source = open_[high], open_[low]
        room = capacity - used[at]
        while room and bins[source]:
            doc, start, size = bins[source].pop()
            part = min(size, room)
            bins[at].append((doc, start, part))
            if part < size:
                bins[source].append((doc, start + part, size - part))
            room -= part
            used[source] -= part
        used[at] = capacity - room
        if not bins[source]:
            low -= 1
        if not room:
            done.append(bins[at])
            high += 1
    if high == low and bins[open_[high]]:
        done += cut_at_powers(bins[open_[high]])
    return done


def cut_at_powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Pieces in order, cut into sequences whose lengths are powers of two, longest first."""
    left = sum(p[2] for p in pieces)
    queue, out = list(reversed(pieces)), []
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            doc, start, size = queue.pop()
            part = min(size, room)
            out[-1].append((doc, start, part))
            if part < size:
                queue.append((doc, start + part, size - part))
            room -= part
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = LENGTH, end: int = END, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The pieces of all rows of ``docs(doc_id, text)``, see ``SCHEMA``.

    ``tokenizer`` is the path of a tokenizer file on every executor.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    groups = max(1, -(-size // group_bytes))

    def rows(batches):
        ids, held = [], []
        cache = word_cache(tokenizer)
        for batch in batches:
            ids.append(batch.column(0))
            held += [x.astype("<u4", copy=False) for x in cache.encode(batch.column(1), end)]
        first = TaskContext.get().partitionId() << 32
        sequences = pack([len(x) for x in held], capacity)
        doc, start, length = (np.array([p[k] for s in sequences for p in s], np.int64) for k in range(3))
        number = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
        behind = np.cumsum(length)
        began = np.concatenate([[0], behind[np.flatnonzero(np.diff(number))]]) if len(doc) else behind
        marks = [zlib.crc32(held[d][a : a + n].data) for d, a, n in zip(doc.tolist(), start.tolist(), length.tolist())]
        tokens = np.array([len(x) for x in held], np.int64)
        if len(doc):
            yield {"doc_id": pa.concat_arrays(ids).take(pa.array(doc)), "start": start, "length": length, "ids_crc32": marks, "doc_tokens": tokens[doc], "sequence_id": first + number, "offset": behind - length - began[number]}

    # a random key deals any hot id, source or group of copies over all groups
    dealt = docs.withColumn("deal", F.xxhash64("doc_id", F.monotonically_increasing_id())).repartition(groups, "deal").drop("deal")
    return map_arrow(dealt, rows, SCHEMA)
