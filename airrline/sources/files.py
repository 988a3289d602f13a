"""Files of any store that Spark can reach, through its own file system layer."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def plain(path: str) -> str:
    """``file:/a``, ``file:///a`` and ``/a`` as ``/a``; other stores keep their scheme."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:/") else path


def expand(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a path or glob names, sorted; none if there are none."""
    fs, p = _fs(spark, pattern)
    return sorted(plain(s.getPath().toString()) for s in fs.globStatus(p) or [])


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a text file, gzipped or not; empty for an empty file."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        inner = spark._jvm.java.util.zip.GZIPInputStream(stream) if path.endswith((".gz", ".gzip")) else stream
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(inner, "UTF-8"))
        return reader.readLine() or ""
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def source_file() -> Column:
    """The file a row was read from, as ``plain`` gives it."""
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    return F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
