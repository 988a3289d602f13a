"""Shared helpers: batches of bounded size, text as bytes, and stored intermediate tables."""

from __future__ import annotations

import atexit
import io
import os
import threading
import zipfile
from collections.abc import Callable, Collection, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from airrline.plans.materialize import ensure_checkpoint_dir
from airrline.sources.files import write_bytes

_PACKAGE = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()
MAX_BATCH_BYTES = 8 << 20  # of text worked on at once; a longer single text is still taken whole
FILTER_BITS = 25  # a set of bits has 2 ** 25 at most, 4 MB


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a context, unless they are sure to find it themselves."""
    home = _PACKAGE.parent
    found = [Path(p).resolve() for p in [".", *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    sc = spark.sparkContext
    if home in found or home.name == "site-packages" or sc.applicationId in _SHIPPED:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(_PACKAGE.rglob("*.py")):
            z.write(file, file.relative_to(home))
    path = f"{ensure_checkpoint_dir(spark)}/airrline-{uuid4().hex}.zip"
    write_bytes(spark, path, packed.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` of a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def bit_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """A set of bits for 64-bit hashes, 2 ** FILTER_BITS at most, as 64-bit words; made in tasks, and small enough to broadcast.

    With more hashes than it has room for, it lets more through, in the end everything.
    """
    bits = min(FILTER_BITS, max(12, (32 * hashes.count()).bit_length()))
    set_bits = hashes.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias("bit"))
    set_bits = set_bits.selectExpr("shiftright(bit, 6) AS word", "shiftleft(1L, cast(bit & 63 AS int)) AS mask")
    words = set_bits.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return out


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (int64) may be in a set of bits; False is sure."""
    bit = hashes.view(np.uint64) & np.uint64(64 * len(words) - 1)
    return (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def sliced(batches: Iterator[pa.RecordBatch], column: int, most: int = MAX_BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches where a text column would pass ``most`` bytes. Yields nothing for empty ones."""
    for batch in batches:
        sizes = np.cumsum([0 if x is None else x for x in _lengths(batch.column(column))], dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def _lengths(array: pa.Array) -> list:
    import pyarrow.compute as pc

    return pc.binary_length(array).to_pylist()


def as_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and where each begins (with the end as last); NULL is empty."""
    import pyarrow.compute as pc

    big = pc.fill_null(array, "" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"").cast(pa.large_binary())
    _, offsets, data = big.buffers()
    at = np.frombuffer(offsets, np.int64)[big.offset : big.offset + len(big) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(big) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


# Within a stored step, shuffle files go as soon as it ends, and Python gets texts a few MB at a time.
_STEP = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


@contextmanager
def _as_step(spark):
    before = {name: spark.conf.get(name, None) for name in _STEP}
    for name, value in _STEP.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


_SCRATCH: dict[str, object] = {}
_ONE_STEP = threading.RLock()  # settings of a step are the session's, so steps of several threads take turns


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table in the shared checkpoint folder and read it back.

    Like a checkpoint, it survives lost executors; it takes less space, and the
    shuffle files that made it go at once. Tables are deleted at the end of the
    ``scratch()`` they were made in, else when the driver's Python exits.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/airrline-{uuid4().hex}"
    with _ONE_STEP, _as_step(spark):
        df.write.option("compression", "zstd").parquet(path)
    if not _SCRATCH:
        atexit.register(_forget)
    _SCRATCH[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def _forget(but: Collection[str] = ()) -> None:
    for path in [p for p in _SCRATCH if p not in but]:
        spark = _SCRATCH.pop(path)
        with suppress(Exception):  # the session may be gone; its folder is then the cluster's to clean
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Within it, operators' stored tables live; at its end they are deleted, so write or collect results inside.

    For long sessions; one thread at a time should use it.
    """
    before = set(_SCRATCH)
    try:
        yield
    finally:
        _forget(before)
