"""Streaming ingest: the row-wise part of ingestion over arriving files.

Renaming, dropping, productive and sequence filters look at one row, so they
run on a stream unchanged. Ids and proportions need all rows; they are made
when the landed table is opened in batch.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from airrline.names import c, imd_rename_cols
from airrline.sources.ingest import rename_present
from airrline.sources.scan import file_kind
from airrline.sources.steps import Step, make_default_preprocessing


def stream_annotations(
    spark: SparkSession,
    folder: str,
    schema: str,
    output: str,
    checkpoint: str,
    pattern: str = "*.tsv",
    preprocess: Mapping[str, Step] | None = None,
    rename_columns: Mapping[str, str] | None = None,
    condition: Column | None = None,
    trigger: Mapping | None = None,
) -> StreamingQuery:
    """Append cleaned rows of files that arrive in ``folder`` to a Parquet table, each file once."""
    kind = file_kind([pattern])
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if kind != "parquet":
        reader = reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",")
    rows = rename_present(reader.format("parquet" if kind == "parquet" else "csv").load(folder), imd_rename_cols("10x") if rename_columns is None else rename_columns)
    for step in (make_default_preprocessing() if preprocess is None else preprocess).values():
        rows = step(rows, metadata=None)
    if condition is not None:
        rows = rows.filter(condition)
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(output)


def stream_counts(rows: DataFrame, keys: list[str], time_col: str, window: str, lateness: str) -> DataFrame:
    """Chains by time window and keys over a stream; rows later than ``lateness`` are left out, as watermarks do."""
    late = rows.withWatermark(time_col, lateness)
    return late.groupBy(F.window(c(time_col), window), *[c(k) for k in keys]).agg(F.count("*").alias("n"))
