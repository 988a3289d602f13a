"""Ingestion: files to a saved dataset."""

from __future__ import annotations

import posixpath
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from airrline.dataset import AirrData
from airrline.names import FILENAME, c, imd_rename_cols
from airrline.operators.receptors import agg_receptors
from airrline.plans.joins import null_safe_join
from airrline.schema import ReceptorSchema, as_receptor_schema
from airrline.sources.metadata import read_metadata
from airrline.sources.saved import open_dataset, save_dataset
from airrline.sources.scan import resolve_paths, scan_tables
from airrline.sources.steps import Step, make_default_postprocessing, make_default_preprocessing

FROM_METADATA = "<metadata>"
MAX_METADATA_BROADCAST = 100_000  # files; a larger sheet is joined by shuffle


def rename_present(dataset: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    """Rename old to new where the old column exists; an existing new one gives way."""
    for new, old in renames.items():
        if old in dataset.columns and old != new:
            dataset = dataset.drop(new).withColumnRenamed(old, new)
    return dataset


def default_folder(first: str) -> str:
    stem = posixpath.splitext(posixpath.basename(first))[0]
    return posixpath.join(posixpath.dirname(first), f"airrline-{stem}")


def read_repertoires(
    spark: SparkSession,
    path: str | Sequence[str],
    schema,
    metadata=None,
    barcode_col: str | None = None,
    count_col: str | None = None,
    locus_col: str | None = None,
    umi_col: str | None = None,
    preprocess: Mapping[str, Step] | None = None,
    postprocess: Mapping[str, Step] | None = None,
    rename_columns: Mapping[str, str] | None = None,
    enforce_schema: bool = True,
    metadata_file_col: str = "File",
    output_folder: str | None = None,
    repertoire_schema: str | Sequence[str] | None = None,
    partition_by: tuple[str, ...] = (),
    text_types: str | None = None,
) -> AirrData:
    """Scan, rename, preprocess, assign receptors, join metadata, postprocess, save, reopen, and count repertoires.

    ``path``: files or globs, or ``"<metadata>"`` for the files the metadata
    lists. ``preprocess`` and ``postprocess``: steps by name; None for the
    default ones, ``{}`` for none. ``text_types``: see ``scan_tables``. Saving fixes the ids, and keeps the repertoire
    schema, so the dataset opens with its repertoires.
    """
    sheet = None
    if metadata is not None:
        sheet = metadata if isinstance(metadata, DataFrame) and FILENAME in metadata.columns else read_metadata(spark, metadata, metadata_file_col)
    if path == FROM_METADATA:
        if sheet is None:
            raise ValueError(f"path {FROM_METADATA!r} needs metadata")
        path = [r[0] for r in sheet.select(c(FILENAME)).collect() if r[0] is not None]
    paths = resolve_paths(spark, path)
    dataset = scan_tables(spark, paths, enforce_schema, text_types)
    return ingest(
        dataset, schema, sheet, output_folder or default_folder(paths[0]), barcode_col, count_col, locus_col, umi_col, preprocess, postprocess, rename_columns,
        repertoire_schema, partition_by, n_files=len(paths),
    )


def ingest(
    dataset: DataFrame, schema, sheet: DataFrame | None, folder: str, barcode_col: str | None = None, count_col: str | None = None, locus_col: str | None = None,
    umi_col: str | None = None, preprocess: Mapping[str, Step] | None = None, postprocess: Mapping[str, Step] | None = None, rename_columns: Mapping[str, str] | None = None,
    repertoire_schema: str | Sequence[str] | None = None, partition_by: tuple[str, ...] = (), n_files: int = 0,
) -> AirrData:
    """The part of ``read_repertoires`` after the scan; ``dataset`` has a ``filename`` column, and so has ``sheet``."""
    spark = dataset.sparkSession
    pre = make_default_preprocessing() if preprocess is None else preprocess
    post = make_default_postprocessing() if postprocess is None else postprocess
    for name, step in [*pre.items(), *post.items()]:
        if not callable(step):
            raise TypeError(f"step {name!r} is not a function")

    renames = imd_rename_cols("10x") if rename_columns is None else dict(rename_columns)
    dataset = rename_present(dataset, renames)
    new = {old: n for n, old in renames.items()}
    schema = as_receptor_schema(schema)
    schema = ReceptorSchema(tuple(new.get(f, f) if f not in dataset.columns else f for f in schema.features), schema.chains)

    def named(col: str | None) -> str | None:
        return new.get(col, col) if col and col not in dataset.columns else col

    for step in pre.values():
        dataset = step(dataset, metadata=sheet)
    idata = agg_receptors(dataset, schema, named(barcode_col), named(count_col), named(locus_col), named(umi_col))
    rows = idata.annotations
    if sheet is not None:
        sheet = sheet.select(*[c(x) for x in sheet.columns if x == FILENAME or x not in rows.columns])
        rows = null_safe_join(rows, F.broadcast(sheet) if n_files <= MAX_METADATA_BROADCAST else sheet, [FILENAME])
    for step in post.values():
        rows = step(rows)

    keys = [repertoire_schema] if isinstance(repertoire_schema, str) else list(repertoire_schema or ())
    keys = [k if k in rows.columns else new.get(k, k) for k in keys]
    if missing := [k for k in keys if k not in rows.columns]:
        raise ValueError(f"Missing columns in `annotations`: {', '.join(missing)}")
    save_dataset(AirrData(idata.schema_receptor, rows, schema_repertoire=keys), folder, partition_by)
    return open_dataset(spark, folder)
