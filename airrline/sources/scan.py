"""Scans of many chain tables as one relation."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession

from airrline.names import FILENAME
from airrline.sources.files import expand, first_line, source_file

_KIND = re.compile(r"\.(parquet|csv|tsv)(?:\.(?:gz|gzip))?$")


def resolve_paths(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    patterns = [path] if isinstance(path, str) else list(path)
    with ThreadPool(16) as pool:
        found = list(dict.fromkeys(f for files in pool.map(lambda p: expand(spark, p), patterns) for f in files))
    if not found:
        raise FileNotFoundError(f"No file provided, or none exists: {patterns}")
    return found


def file_kind(paths: Sequence[str]) -> str:
    """``parquet``, ``csv`` or ``tsv``; all files must be of one kind."""
    kinds = set()
    for p in paths:
        m = _KIND.search(p)
        if not m or (m[1] == "parquet" and not p.endswith(".parquet")):
            raise ValueError(f"unknown file type: {p}")
        kinds.add(m[1])
    if len(kinds) > 1:
        raise ValueError(f"files of several types: {sorted(kinds)}")
    return kinds.pop()


def scan_tables(spark: SparkSession, paths: Sequence[str], enforce_schema: bool = True, text_types: str | None = None) -> DataFrame:
    """All files as one frame with a ``filename`` column.

    ``enforce_schema``: all files have the first one's columns in its order, and
    a text file whose header differs is an error when read. Otherwise columns
    are matched by name and absent ones are NULL. ``text_types``: names and types
    of all columns of text files, such as ``"cdr3 string, umi double"``; without
    it, types are inferred, which reads text files twice.
    """
    kind = file_kind(paths)
    reader = spark.read
    if kind != "parquet":
        reader = reader.schema(text_types) if text_types else reader.option("inferSchema", True)
        reader = reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("enforceSchema", False)
    load = reader.csv if kind != "parquet" else reader.parquet

    def tagged(df: DataFrame) -> DataFrame:
        return df.drop(FILENAME).withColumn(FILENAME, source_file())

    if enforce_schema or (text_types and kind != "parquet"):
        return tagged(load(*paths) if kind == "parquet" else load(list(paths)))
    if kind == "parquet":
        return tagged(reader.option("mergeSchema", True).parquet(*paths))
    with ThreadPool(16) as pool:
        headers = pool.map(lambda p: first_line(spark, p), paths)
    by_header: dict[str, list[str]] = {}
    for p, header in zip(paths, headers, strict=True):  # files with one header are one scan, so the plan grows with the layouts, not the files
        by_header.setdefault(header, []).append(p)
    parts = [tagged(load(group)) for group in by_header.values()]
    kinds: dict[str, set[str]] = {}
    for part in parts:
        for name, t in part.dtypes:
            kinds.setdefault(name, set()).add(t)
    mixed = [n for n, t in kinds.items() if len(t) > 1]
    parts = [p.withColumns({n: p[n].cast("string") for n in mixed if n in p.columns}) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

