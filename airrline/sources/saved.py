"""Saved datasets: a Parquet folder and a JSON file beside it."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from airrline.dataset import AirrData
from airrline.names import FILES, META_SCHEMA
from airrline.operators.repertoires import agg_repertoires
from airrline.schema import make_receptor_schema
from airrline.sources.files import exists, read_text, write_text

VERSION = "0.0.3"  # of the layout


def save_dataset(idata: AirrData, output_folder: str, partition_by: tuple[str, ...] = ()) -> AirrData:
    """Save as zstd Parquet and JSON, replacing what is there; returns the dataset."""
    spark = idata.annotations.sparkSession
    writer = idata.annotations.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", 9)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{output_folder}/{FILES['annotations']}")
    meta = {
        META_SCHEMA["version"]: [VERSION],
        META_SCHEMA["receptor_schema"]: {"features": list(idata.schema_receptor.features), "chains": list(idata.schema_receptor.chains) or {}},
        META_SCHEMA["repertoire_schema"]: list(idata.schema_repertoire) or {},
    }
    write_text(spark, f"{output_folder}/{FILES['metadata']}", json.dumps(meta))
    return idata


def _listed(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value or [])


def open_dataset(spark: SparkSession, path: str) -> AirrData:
    """Open a saved dataset; repertoires are counted again if it has them."""
    parquet, meta_path = f"{path}/{FILES['annotations']}", f"{path}/{FILES['metadata']}"
    for p in (path, parquet, meta_path):
        if not exists(spark, p):
            raise FileNotFoundError(p)
    meta = json.loads(read_text(spark, meta_path))
    receptor = meta[META_SCHEMA["receptor_schema"]]
    schema = make_receptor_schema(_listed(receptor["features"]), _listed(receptor.get("chains")))
    idata = AirrData(schema, spark.read.parquet(parquet))
    keys = _listed(meta.get(META_SCHEMA["repertoire_schema"]))
    return agg_repertoires(idata, keys) if keys else idata
