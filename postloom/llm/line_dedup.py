"""Lines that several documents hold, dropped from all of them but the first.

Every line's key is hashed to 128 bits.  Hashes are range-partitioned and sorted by hash,
document and position, so that a stream over a partition sees a key's first document first
and marks the lines of all others.  A range may begin inside a hash that many documents
hold; whether it does follows from the ends of the ranges, a row a range.  What comes back
is a compressed bitmap of kept lines for each document that loses some, never text.

A key is a line without the white space ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased.
Keys of at least ``LEAST`` code points that two documents hold or more lose all their lines
except in the document with the smallest id; repeats within that document stay.

Defined results: a null or empty text is one empty line.  Rows with one id are one document
whose lines are judged each in its own text.  Null ids are one document that comes after all
others.  Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, settle

#: Code points of a key that is looked at.
LEAST = 10
_ROWS = 50_000
_DROP, _OPEN, _EDGE = 0, 1, 2


def keys_of(text: bytes, least: int = LEAST):
    """Position and key of every line that is long enough."""
    for at, line in enumerate(text.split(b"\n")):
        key = line.strip().lower()  # of bytes: ASCII white space, and A-Z alone
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least):
            yield at, key


def named(docs: DataFrame) -> DataFrame:
    """``doc``, ``mark`` and ``text``: rows with one id and different texts have different marks."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))


def hashed(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``high``, ``low``, ``doc``, ``mark`` and ``at`` of every line of ``docs(doc, mark, text)`` that is long enough."""

    def rows(batches):
        places: list[tuple] = []
        digests: list[bytes] = []

        def out():
            code = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            doc, mark, at = zip(*places)
            made = {"high": code[:, 0], "low": code[:, 1], "doc": list(doc), "mark": list(mark), "at": list(at)}
            places.clear()
            digests.clear()
            return made

        for batch in batches:
            for doc, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                for at, key in keys_of(text.as_py(), least):
                    places.append((doc, mark, at))
                    digests.append(hashlib.blake2b(key, digest_size=16).digest())
                    if len(places) >= _ROWS:
                        yield out()
        if places:
            yield out()

    return map_arrow(docs, rows, "high bigint, low bigint, doc bigint, mark bigint, at bigint")


def streamed(lines: DataFrame) -> DataFrame:
    """What a stream over each range finds: lines to drop, lines to drop if an earlier range ends with the range's first hash, and each range's ends."""
    order = ["high", "low", F.asc_nulls_last("doc")]
    dealt = lines.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order, "mark", "at")

    def rows(batches):
        opening, first, last, part = None, None, None, None  # hash at the range's start; (hash, document) that leads the run
        for batch in batches:
            if not batch.num_rows:
                continue
            high, low = (batch.column(k).to_numpy() for k in (0, 1))
            none = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            doc = batch.column(2).fill_null(0).to_numpy()
            starts = np.ones(len(high), bool)
            starts[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            if opening is None:
                opening, part = (high[0], low[0]), batch.column(5)[0].as_py()
            carried = last is not None and (high[0], low[0]) == last
            lead = np.maximum.accumulate(np.where(starts, np.arange(len(high)), 0))
            same = (doc == doc[lead]) & (none == none[lead])
            if carried:  # the run goes on from the batch before
                run = lead == 0
                same[run] = (doc[run] == first[0]) & (none[run] == first[1])
            tail = lead[-1]
            if not (carried and tail == 0):
                first = (doc[tail], none[tail])
            last = (high[-1], low[-1])
            begins = (high == opening[0]) & (low == opening[1])
            kind = np.where(~same, _DROP, np.where(begins, _OPEN, -1))
            for at in range(0, len(kind), _ROWS):
                use = np.flatnonzero(kind[at : at + _ROWS] >= 0) + at
                if len(use):
                    yield {"kind": kind[use], "part": np.full(len(use), part), "doc": batch.column(2).take(pa.array(use)), "mark": batch.column(3).take(pa.array(use)), "at": batch.column(4).take(pa.array(use)), "ends": [None] * len(use)}
        if opening is not None:
            yield {"kind": [_EDGE], "part": [part], "doc": [None], "mark": [None], "at": [None], "ends": [[int(x) for x in (*opening, *last)]]}

    return map_arrow(dealt.select("high", "low", "doc", "mark", "at", "part"), rows, "kind int, part int, doc bigint, mark bigint, at bigint, ends array<bigint>")


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc``, ``mark`` and ``bitmap`` of the documents in ``docs(doc, mark, text)`` that lose lines.

    A bitmap is a deflated string of bits, 1 where a line stays; lines beyond its end stay.
    """
    found = settle(streamed(hashed(docs, least)))
    ends = found.where(F.col("kind") == _EDGE)
    before = F.lag("ends").over(Window.orderBy("part"))  # a row a range
    continued = ends.select("part", (F.slice("ends", 1, 2) == F.slice(before, 3, 2)).alias("goes_on")).where("goes_on").select("part")
    drops = found.where(F.col("kind") == _DROP).select("doc", "mark", "at")
    drops = drops.unionByName(found.where(F.col("kind") == _OPEN).join(F.broadcast(continued), "part").select("doc", "mark", "at"))

    def rows(batches):
        whose, held = None, []
        for batch in batches:
            doc, mark, at = (batch.column(k).to_pylist() for k in range(3))
            edge = [k for k in range(len(doc)) if k == 0 or (doc[k], mark[k]) != (doc[k - 1], mark[k - 1])] + [len(doc)]
            for low, high in zip(edge, edge[1:]):
                if (doc[low], mark[low]) != whose:
                    if held:
                        yield packed(whose, held)
                    whose, held = (doc[low], mark[low]), []
                held += at[low:high]
        if held:
            yield packed(whose, held)

    def packed(whose, held):
        keep = np.ones(max(held) // 8 * 8 + 8, bool)  # whole bytes
        keep[held] = False
        return {"doc": [whose[0]], "mark": [whose[1]], "bitmap": [zlib.compress(np.packbits(keep).tobytes(), 1)]}

    dealt = drops.repartition("doc", "mark").sortWithinPartitions("doc", "mark", "at")
    return map_arrow(dealt, rows, "doc bigint, mark bigint, bitmap binary")


def kept_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and ``kept_text`` (the lines that stay, joined) of ``docs(doc, mark, text)``."""
    named_maps = bitmaps.select(F.col("doc").alias("d"), F.col("mark").alias("m"), "bitmap")
    joined = docs.join(named_maps, docs["doc"].eqNullSafe(named_maps["d"]) & (docs["mark"] == named_maps["m"]), "left")

    def rows(batches):
        for batch in batches:
            lines, dropped, kept = [], [], []
            for text, bitmap in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                parts = text.as_py().split(b"\n")
                lines.append(len(parts))
                if bitmap.is_valid:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap.as_py()), np.uint8))
                    gone = set(np.flatnonzero(bits == 0).tolist())
                    parts = [p for k, p in enumerate(parts) if k not in gone]
                dropped.append(lines[-1] - len(parts))
                kept.append(b"\n".join(parts))
            yield {"doc_id": batch.column(0), "n_lines": lines, "n_dropped": dropped, "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}

    return map_arrow(joined.select("doc", "text", "bitmap"), rows, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_text string")


def deduplicate_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped`` and ``kept_text`` of every row of ``docs(doc_id, text)``."""
    own = named(docs)
    return kept_lines(own, keep_bitmaps(own, least))
