"""Equi-joins in which NULL matches NULL, with clear rules for names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from airrline.names import c

BROADCAST_ROWS = 100_000  # driver-side lists longer than this are joined by shuffle


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", suffix: str = "") -> DataFrame:
    """Join on ``on``, NULL matching NULL; the result keeps the left keys.

    Columns of ``right`` whose name exists in ``left`` get ``suffix``; without
    one, a clash is an error.
    """
    taken = set(left.columns)
    keys = {k: f"__right_{i}" for i, k in enumerate(on)}
    renamed = right.select(*[c(x).alias(keys.get(x, x + suffix if x in taken else x)) for x in right.columns])
    cond = F.lit(True)
    for k, r in keys.items():
        cond = cond & c(k).eqNullSafe(c(r))
    clash = taken & {x for x in renamed.columns if x not in keys.values()}
    if clash and how not in ("left_semi", "left_anti"):
        raise ValueError(f"columns on both sides of a join: {sorted(clash)}")
    joined = left.join(renamed, cond, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*keys.values())


def semi_join_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose ``column`` is in a driver-side list; the list is broadcast only while small."""
    distinct = list(dict.fromkeys(values))
    if not distinct:
        raise ValueError("at least one id is needed")
    kind = df.schema[column].dataType
    ids = df.sparkSession.createDataFrame([(kind.fromInternal(v) if v is None else _as(kind, v),) for v in distinct], f"`{column}` {kind.simpleString()}")
    if len(distinct) <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return df.join(ids, column, "left_semi")


def _as(kind, value):
    return str(value) if kind.typeName() == "string" else int(value) if kind.typeName() in ("long", "integer") else value
