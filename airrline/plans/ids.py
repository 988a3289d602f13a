"""Dense ids 1..N without a single-partition window.

Rows are range-partitioned and sorted by the key, so a row's rank is the number
of rows in earlier partitions plus its place in its own. Only one count for each
partition reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from airrline.names import c
from airrline.plans.materialize import materialize

_PLACE, _PART = "__place", 33  # monotonically_increasing_id(): partition in the upper bits


def dense_ids(df: DataFrame, id_col: str, order_by: Sequence[str] = ()) -> DataFrame:
    """Add ``id_col``: 1..N in the order of ``order_by`` (nulls first), or in the order read.

    Ties get ids in arbitrary but fixed order.
    """
    if order_by:
        keys = [c(x).asc_nulls_first() for x in order_by]
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(df.withColumn(_PLACE, F.monotonically_increasing_id()))  # file splits can differ from job to job, so places are written
    part = F.shiftright(F.col(_PLACE), _PART).cast("int")
    counts = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).count().collect()}  # one row a partition
    before, at = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(at)
        at += counts.get(p, 0)
    offset = F.get(F.lit(before or [0]), part).cast("long")
    rank = F.col(_PLACE).bitwiseAND(F.lit((1 << _PART) - 1)) + offset + 1
    return placed.withColumn(id_col, rank.cast("long")).drop(_PLACE)


def hash_ids(df: DataFrame, id_col: str, keys: Sequence[str]) -> DataFrame:
    """Add ``id_col`` as a 64-bit hash of the keys: no sort, not dense, and two keys may collide."""
    return df.withColumn(id_col, F.xxhash64(*[c(x) for x in keys]))
