"""Shared scratch tables, file access from tasks, and row keys.

Everything that outlives one stage goes below ``spark.checkpoint.dir``, the
folder that the cluster names as shared by driver and executors.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words are runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder; below the warehouse folder where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str) -> DataFrame:
    """Evaluate once into a shared folder and continue from the files."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remove(spark: SparkSession, *folders: str) -> None:
    for folder in folders:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """Queries inside remove their shuffle files as they end, instead of when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: What a worker keeps from task to task, for one operator at a time.
_KEPT: dict[object, object] = {}


def kept_by_worker(key: object, make: Callable[[], object]) -> object:
    """The worker's object for ``key``; another operator's is dropped, so that caches do not add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def drop_kept() -> None:
    """Free what another operator left in this worker."""
    _KEPT.clear()


def file_system(folder: str):
    """Arrow's file system and path for a shared folder, for use inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def row_key(*columns: str | Column) -> Column:
    """Tells rows apart by content; equal rows share a key. A null is told from any value."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.xxhash64(*[x for p in parts for x in (p, p.isNull())])


def lower_words(text: str) -> list[bytes]:
    """UTF-8 words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def each_text(batch: pa.RecordBatch, name: str, at_once: int = 256) -> Iterator[str]:
    """The texts of :func:`texts_of`, a few of them in memory at a time."""
    for at in range(0, batch.num_rows, at_once):
        yield from texts_of(batch.slice(at, at_once), name)


def pack(values: np.ndarray) -> bytes:
    """Bytes of an integer array, grouped by significance and compressed."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, count: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = pa.decompress(blob, decompressed_size=count * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, count).T).view(dtype).ravel()


def crc(values: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(values, dtype="<u4").tobytes())


SPLIT_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
SPACES_MEET = re.compile(r" \s|\s ")
