"""Import of a list of frames with a sample table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from airrline.dataset import AirrData
from airrline.names import FILENAME
from airrline.sources.ingest import ingest


def from_frames(spark: SparkSession, imm: Mapping, output_folder: str, schema: Sequence[str] = ("CDR3.aa", "V.name"), **options) -> AirrData:
    """``imm["data"]``: frames (Spark or pandas) by name, or a list; ``imm["meta"]``: a frame with ``Sample``.

    Each frame gets its name as ``repertoire_id`` unless it has that column.
    Columns are matched by name. What follows is what files go through: renames,
    steps before and after (the default ones unless ``options`` for ``ingest``
    name others), saving, reopening, and counting by repertoire.
    """
    data, meta = imm["data"], imm.get("meta")
    if meta is None or "Sample" not in meta.columns:
        raise ValueError("the input needs `meta` with a `Sample` column")
    if not isinstance(data, Mapping):
        data = {f"repertoire_{i}": x for i, x in enumerate(data, 1)}

    def frame(x) -> DataFrame:
        return x if isinstance(x, DataFrame) else spark.createDataFrame(x)

    parts = []
    for name, x in data.items():
        df = frame(x).drop(FILENAME)
        df = df if "repertoire_id" in df.columns else df.withColumn("repertoire_id", F.lit(name))
        parts.append(df.withColumn(FILENAME, F.lit(f"{name}.tsv")))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    sheet = frame(meta).drop(FILENAME).withColumn(FILENAME, F.concat(F.col("Sample"), F.lit(".tsv")))
    return ingest(rows, list(schema), sheet, output_folder, repertoire_schema="repertoire_id", n_files=len(parts), **options)
