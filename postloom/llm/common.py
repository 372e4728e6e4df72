"""What several operators of this subpackage need: tables, settled results, hashing, offsets."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set if all tasks run in this process;
    on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete settled tables that no plan reads any more."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


#: Rows and bytes in an Arrow batch; batches hold whole texts, sets or vectors, and one very long row may exceed the bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession | None = None) -> None:
    """Keep the session's Arrow batches at ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` or fewer, so that buffers stay small on both sides."""
    spark = spark or SparkSession.getActiveSession()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark and not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    if spark:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, rows, schema: str) -> DataFrame:
    """``mapInArrow`` where ``rows(batches)`` yields dicts of columns (lists or arrays)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    small_batches(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        try:
            for columns in rows(batches):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return memory that a finished task has freed to the system: its worker process lives on, idle or for other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have, case-insensitively."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = f"_{wanted}"
    return wanted
