"""The sample sheet: a row for each input file."""

from __future__ import annotations

import posixpath
import warnings
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession, functions as F

from airrline.names import FILENAME, c
from airrline.sources.files import exists, expand, plain


def _is_absolute(path: str) -> bool:
    return path.startswith("/") or "://" in path or path.startswith("file:/")


def read_metadata(spark: SparkSession, metadata, filename_col: str = "File", delim: str = "\t", **options) -> DataFrame:
    """Read a sheet (a path, or a Spark or pandas frame) and add ``filename``, the absolute path of each file.

    Paths in a sheet may be relative to it; those in a frame must be absolute.
    None found is an error; a few found give a warning. The sheet has a row a
    file, so its paths fit the driver.
    """
    base = None
    if isinstance(metadata, str):
        found = expand(spark, metadata)
        if not found:
            raise FileNotFoundError(metadata)
        base = posixpath.dirname(found[0])
        metadata = spark.read.csv(found[0], header=True, inferSchema=True, sep=delim, **options)
    elif not isinstance(metadata, DataFrame):
        metadata = spark.createDataFrame(metadata)
    if filename_col not in metadata.columns:
        raise ValueError(f"no column {filename_col!r} in the metadata")
    listed = [r[0] for r in metadata.select(c(filename_col)).distinct().collect() if r[0] is not None]
    if base is None and not all(map(_is_absolute, listed)):
        raise ValueError("paths in a metadata frame must be absolute")
    full = {p: plain(p if _is_absolute(p) else posixpath.normpath(posixpath.join(base, p))) for p in listed}
    with ThreadPool(16) as pool:  # each is a call to the store
        n = sum(pool.map(lambda p: exists(spark, p), full.values()))
    if not n:
        raise FileNotFoundError("none of the files in the metadata exists")
    if n < len(full) and n <= round(0.1 * len(full)) + 1:
        warnings.warn(f"only {n} of {len(full)} files in the metadata exist", stacklevel=2)
    names = spark.createDataFrame(list(full.items()), f"`{filename_col}` string, `{FILENAME}` string")
    return metadata.drop(FILENAME).join(F.broadcast(names), filename_col, "left") if filename_col != FILENAME else metadata.withColumn(FILENAME, F.regexp_replace(c(FILENAME), "^file:/+", "/"))
