"""Document boundaries in flat token files that have no index.

A flat token file is little-endian unsigned 16-bit or 32-bit ids, document after document,
each closed by an end id.  Files are read as blocks (``file``, ``block``, ``ids``) of any
lengths.  A task searches a whole block for end ids at once; what a block holds after its
last end is carried to the next blocks by a prefix scan over block summaries, first within
chunks of blocks and then over chunks, so that one large file is many tasks.

Defined results: ids after a file's last end are a document without end (``ended`` false).
An empty block, or a null one, holds nothing; an empty file has no documents.  Blocks with
equal numbers in one file are not allowed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, settle

_CHUNK = 4096


def _opened(uri: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def read_blocks(spark: SparkSession, path: str, block_bytes: int = 1 << 22, only: DataFrame | None = None) -> DataFrame:
    """Flat files of any size under a path as (``file``, ``block``, ``ids``), of those alone that ``only(file)`` names.

    Only names and lengths are listed; a row of the listing is a range of one file, dealt over
    all tasks, which read their ranges from the file system that all executors see.  ``file``
    is the path, or the name within it if ``only`` is given.
    """

    def rows(batches):
        for batch in batches:
            for path, name, length, block in zip(*(c.to_pylist() for c in batch.columns)):
                system, where = _opened(path)
                with system.open_input_file(where) as file:
                    yield {"file": [name], "block": [block], "ids": [file.read_at(min(block_bytes, length - block * block_bytes), block * block_bytes)]}

    files = spark.read.format("binaryFile").load(path).select("path", F.col("path").alias("name"), "length").where("length > 0")
    if only is not None:
        files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(only.select(F.col("file").alias("name")).distinct(), "name", "left_semi")
    last = F.floor((F.col("length") - 1) / block_bytes)
    ranges = files.select("path", "name", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(ranges.repartition(parts, "path", "block"), rows, "file string, block bigint, ids binary")


def ends_in(blocks: DataFrame, end: int, width: int) -> DataFrame:
    """One row a block: its number of ids, and where after its start its end ids are."""
    kind = np.dtype("<u2" if width == 2 else "<u4")

    def rows(batches):
        for batch in batches:
            found = [np.frombuffer(x or b"", kind) for x in batch.column(2).to_pylist()]
            yield {"file": batch.column(0), "block": batch.column(1), "n": [len(x) for x in found], "ends": [np.flatnonzero(x == end).astype(np.int64) for x in found]}

    return map_arrow(blocks.select("file", "block", "ids"), rows, "file string, block bigint, n bigint, ends array<bigint>")


def documents_in(blocks: DataFrame, end: int, width: int = 2) -> DataFrame:
    """One row a document: ``file``, ``number`` (in the file, from 0), ``start``, ``n_tokens`` (its end id included), ``ended``."""
    found = settle(ends_in(blocks, end, width).withColumn("chunk", F.floor(F.col("block") / _CHUNK)))
    summary = found.select("file", "chunk", "block", "n", F.size("ends").cast("bigint").alias("docs"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    inside = Window.partitionBy("file", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    near = summary.select("*", F.coalesce(F.sum("n").over(inside), zero).alias("at"), F.coalesce(F.sum("docs").over(inside), zero).alias("before"))
    near = near.withColumn("open", F.max(F.when(F.col("docs") > 0, F.col("at") + F.col("last") + 1)).over(inside))
    chunks = near.groupBy("file", "chunk").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.max(F.when(F.col("docs") > 0, F.col("at") + F.col("last") + 1)).alias("open"))
    chunks = chunks.select("*", F.coalesce(F.sum("n").over(whole), zero).alias("chunk_at"), F.coalesce(F.sum("docs").over(whole), zero).alias("chunk_before"))
    carry = chunks.select("file", "chunk", "chunk_at", "chunk_before", F.max(F.col("chunk_at") + F.col("open")).over(whole).alias("chunk_open"))
    near = near.join(carry, ["file", "chunk"])
    # where the document that is open at the block's start began
    near = near.select("file", "block", (F.col("chunk_at") + F.col("at")).alias("offset"), (F.col("chunk_before") + F.col("before")).alias("first"), F.coalesce(F.col("chunk_at") + F.col("open"), "chunk_open", zero).alias("began"))
    placed = found.select("file", "block", "ends").join(near, ["file", "block"]).where(F.size("ends") > 0)
    each = placed.select("file", "offset", "first", "began", "ends", F.posexplode("ends").alias("k", "at"))
    start = F.when(F.col("k") == 0, F.col("began")).otherwise(F.col("offset") + F.expr("try_element_at(ends, k)") + 1)
    closed = each.select("file", (F.col("first") + F.col("k")).alias("number"), start.alias("start"), (F.col("offset") + F.col("at") + 1 - start).alias("n_tokens"), F.lit(True).alias("ended"))
    totals = chunks.groupBy("file").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.max(F.col("chunk_at") + F.col("open")).alias("open"))
    left = totals.select("file", F.col("docs").alias("number"), F.coalesce("open", zero).alias("start"), (F.col("n") - F.coalesce("open", zero)).alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return closed.unionByName(left)


def write_files(docs: DataFrame, encoder, end: int, path: str) -> DataFrame:
    """All texts of ``docs(doc_id, text)`` as flat 16-bit token files without index under ``path``, and what document each number of a file is.

    Every task writes a file of its own, in a folder that all executors share; a task that is
    tried again writes another one, and only files of tasks that ended well are named in the
    table that comes back: ``file``, ``number`` and ``doc_id``.
    """

    def rows(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name, encode, mark, number = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.bin", encoder(), int(end).to_bytes(2, "little"), 0
        system, where = _opened(path)
        system.create_dir(where, recursive=True)
        with system.open_output_stream(f"{where}/{name}") as file:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for at in range(0, len(texts), 500):
                    part = ids[at : at + 500]
                    for one in encode(texts[at : at + 500]):
                        file.write(one)
                        file.write(mark)
                    yield {"file": [name], "number": [number], "doc_ids": [part]}
                    number += len(part)

    folder = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(path)  # there even if no task writes a file
    folder.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).mkdirs(folder)
    made = settle(map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), rows, "file string, number bigint, doc_ids array<bigint>"))
    return made.select("file", F.col("number").alias("from"), F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("from") + F.col("k")).alias("number"), "doc_id")


def write_stream(docs: DataFrame, encoder, end: int, block_ids: int, files: int) -> tuple[DataFrame, DataFrame]:
    """All texts of ``docs(doc_id, text)`` as flat 16-bit token files, and what document each number of a file is.

    ``encoder`` is a function that returns a function from a list of texts to their ids as
    bytes.  Blocks cut the stream without regard to documents.  The second table holds
    ``file``, ``number`` and ``doc_id``; it is not used to find boundaries.
    """

    def rows(batches):
        from pyspark import TaskContext

        name, encode = f"part-{TaskContext.get().partitionId():06d}", encoder()
        size, block, number, rest = 2 * block_ids, 0, 0, b""
        mark = int(end).to_bytes(2, "little")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                part = ids[at : at + 500]
                rest += b"".join(x + mark for x in encode(texts[at : at + 500]))
                cut = len(rest) - len(rest) % size
                blocks = [rest[k : k + size] for k in range(0, cut, size)]
                rest = rest[cut:]
                yield {"file": [name], "block": [block], "number": [number], "doc_ids": [part], "ids": [blocks]}
                block, number = block + len(blocks), number + len(part)
        if rest:
            yield {"file": [name], "block": [block], "number": [number], "doc_ids": [[]], "ids": [[rest]]}

    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if files:
        dealt = dealt.repartition(files, F.xxhash64("doc_id", "text"))
    made = settle(map_arrow(dealt, rows, "file string, block bigint, number bigint, doc_ids array<bigint>, ids array<binary>"))
    blocks = made.select("file", F.col("block").alias("from"), F.posexplode("ids").alias("k", "ids")).select("file", (F.col("from") + F.col("k")).alias("block"), "ids")
    names = made.select("file", F.col("number").alias("from"), F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("from") + F.col("k")).alias("number"), "doc_id")
    return blocks, names
