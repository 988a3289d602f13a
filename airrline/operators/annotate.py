"""Joining outside annotations to chains, cells or receptors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from airrline.dataset import AirrData
from airrline.names import BARCODE, CHAIN, RECEPTOR, c
from airrline.operators.repertoires import rebuild
from airrline.plans.joins import null_safe_join

MAX_COLUMNS = 100
ROW_NAMES = "<rownames>"


def annotate_data(idata: AirrData, annotations, by: Mapping[str, str], keep_repertoires: bool = True, remove_limit: bool = False) -> AirrData:
    """Left-join ``annotations`` (a Spark or pandas frame); ``by`` maps the dataset's column to theirs.

    NULL keys match NULL. A key that occurs more than once there repeats the
    dataset's rows. Other columns present on both sides get ``.x`` and ``.y``.
    A hundred columns or more are refused unless ``remove_limit``.
    """
    if not isinstance(by, Mapping) or not by:
        raise ValueError("`by` must map dataset columns to annotation columns")
    if len(annotations.columns) >= MAX_COLUMNS and not remove_limit:
        raise ValueError(f"{len(annotations.columns)} annotation columns; pass remove_limit=True if that is intended")
    rows = idata.annotations
    if missing := [x for x in by.values() if x not in annotations.columns]:
        raise ValueError(f"not in the annotations: {missing}")
    renamed = {mine: theirs for mine, theirs in by.items() if mine != theirs}
    if clash := [mine for mine in renamed if mine in annotations.columns]:
        raise ValueError(f"already in the annotations: {clash}")
    if missing := [x for x in by if x not in rows.columns]:
        raise ValueError(f"not in the dataset: {missing}")
    right = annotations if isinstance(annotations, DataFrame) else rows.sparkSession.createDataFrame(annotations)
    right = right.withColumnsRenamed({theirs: mine for mine, theirs in renamed.items()})
    both = (set(rows.columns) & set(right.columns)) - set(by)
    rows = rows.select(*[c(x).alias(x + ".x") if x in both else c(x) for x in rows.columns])
    right = right.select(*[c(x).alias(x + ".y") if x in both else c(x) for x in right.columns])
    return rebuild(idata, null_safe_join(rows, right, list(by)), keep_repertoires)


annotate = annotate_data


def annotate_receptors(idata: AirrData, annotations, annot_col: str = RECEPTOR, keep_repertoires: bool = True, remove_limit: bool = False) -> AirrData:
    return annotate_data(idata, annotations, {RECEPTOR: annot_col}, keep_repertoires, remove_limit)


def annotate_barcodes(idata: AirrData, annotations, annot_col: str = ROW_NAMES, keep_repertoires: bool = True, remove_limit: bool = False) -> AirrData:
    """By cell. ``<rownames>`` takes the index of a pandas frame; a Spark frame has none and needs a column."""
    if annot_col == ROW_NAMES:
        if isinstance(annotations, DataFrame):
            raise ValueError("a Spark frame has no row names; name the barcode column")
        annot_col = "imd_row_names"
        annotations = annotations.rename_axis(None).reset_index(names=annot_col)
    return annotate_data(idata, annotations, {BARCODE: annot_col}, keep_repertoires, remove_limit)


def annotate_chains(idata: AirrData, annotations, annot_col: str = CHAIN, keep_repertoires: bool = True, remove_limit: bool = False) -> AirrData:
    return annotate_data(idata, annotations, {CHAIN: annot_col}, keep_repertoires, remove_limit)
