"""Steps run on a table before and after receptors are assigned; each maps a frame to a frame."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from airrline.names import BARCODE, c, imd_drop_cols

Step = Callable[..., DataFrame]
# What counts as true in text columns.
TRUTHY_TEXT = ("true", "TRUE", "True", "t", "T", "1")


def make_exclude_columns(cols: Sequence[str] | None = None) -> Step:
    """Drop the listed columns that exist."""
    names = imd_drop_cols("airr") if cols is None else tuple(cols)

    def step(dataset: DataFrame, **_) -> DataFrame:
        return dataset.drop(*names)

    return step


def make_productive_filter(col_name: str | Sequence[str] = "productive", truthy=True) -> Step:
    """Keep rows flagged productive; NULL and junk are dropped.

    ``col_name``: the first of these that exists; none gives a warning and all
    rows. ``truthy``: True or False for a flag of that value (text such as T or 1
    is a true one, F or 0 a false one), or a list of values that count as true.
    """
    names = (col_name,) if isinstance(col_name, str) else tuple(col_name)

    def step(dataset: DataFrame, **_) -> DataFrame:
        name = next((n for n in names if n in dataset.columns), None)
        if name is None:
            warnings.warn(f"no column {names} to filter productive chains by", stacklevel=2)
            return dataset
        if isinstance(truthy, bool):
            return dataset.filter(c(name).try_cast("boolean") == truthy)
        return dataset.filter(c(name).cast("string").isin(*map(str, truthy)))

    return step


def make_barcode_prefix(prefix_col: str | Sequence[str] = "Prefix") -> Step:
    """Put a sample's prefix, from the first of these columns that exists, before its barcodes; NULL on either side counts as empty."""
    names = (prefix_col,) if isinstance(prefix_col, str) else tuple(prefix_col)

    def step(dataset: DataFrame, **_) -> DataFrame:
        name = next((n for n in names if n in dataset.columns), None)
        if name is None:
            warnings.warn(f"no column {names} to prefix barcodes with", stacklevel=2)
            return dataset
        return dataset.withColumn(BARCODE, F.concat_ws("", c(name), c(BARCODE)))

    return step


def make_default_preprocessing(format: str = "airr") -> dict[str, Step]:
    if format not in ("airr", "10x"):
        raise ValueError("format must be 'airr' or '10x'")
    truthy = True if format == "airr" else TRUTHY_TEXT
    return {"exclude_columns": make_exclude_columns(imd_drop_cols(format)), "filter_nonproductive": make_productive_filter("productive", truthy)}


def make_default_postprocessing() -> dict[str, Step]:
    return {"prefix_barcodes": make_barcode_prefix()}
