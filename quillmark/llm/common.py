"""What the operators share: the shared folder, stage tables and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where the session names none, a local session gets a temporary folder of its own; on a
    cluster that is an error, as executors could not read each other's files there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    named = "file://" + tempfile.mkdtemp(prefix="quillmark-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def stage_folder(spark: SparkSession) -> str:
    """The folder of this application's stage tables."""
    return f"{shared_dir(spark)}/stage/{spark.sparkContext.applicationId}"


def drop_stage_tables(spark: SparkSession) -> bool:
    """Delete this application's stage tables, once no result that reads them is needed any more."""
    return delete(spark, stage_folder(spark))


def delete(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs its running tasks only, and a frame that is
    read more than once is computed once. The write commits by task, so a retried task leaves
    one copy of its rows.
    """
    return written(df, name)[0]


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A `stage_table` and its folder, for those that `delete` it when nothing reads it any more."""
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def quoted(name: str) -> str:
    """A column's name as an expression reads it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of rows that a Python worker gets at once.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession | None = None) -> None:
    """Bound the batches that the session's Python workers get to `BATCH_BYTES`, whatever the length
    of the texts; a lower bound that is set already stays."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None:
        held = str(spark.conf.get(_BATCH_SETTING, "64m")).lower().rstrip("b")
        size = int(held.rstrip("kmg")) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(held[-1:], 1)
        if size > BATCH_BYTES:
            spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def utf8_rows(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The column's strings as UTF-8 bytes, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def list_rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as views of its flat values; no Python object per value."""
    rows: list[np.ndarray] = []
    for chunk in column.chunks:
        offsets = chunk.offsets.to_numpy(zero_copy_only=False)
        flat = chunk.values.to_numpy(zero_copy_only=False)
        rows += [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return rows


def release_memory() -> None:
    """Give back what this process no longer uses, as far as the C library can, so that a fit's peak
    does not add to what the driver holds later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_CACHE: dict[Hashable, object] = {}


def worker_cache(key: Hashable, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept in this Python worker from task to task.

    One thing is kept at a time: a worker that goes on to another operator frees what it had, so
    the tables of a pipeline's stages do not add up.
    """
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = make()
    return _CACHE[key]
