"""Balanced contiguous shards from global prefix sums of sizes; DataFrame functions only.

Rows (id, size, checksum: no texts) are range-partitioned by id. One total for
each partition goes to the driver, whose running sums turn each partition's own
prefix sums into global ones; shards are cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from airrline.plans.materialize import materialize

_PART = 33  # monotonically_increasing_id(): partition in the upper bits


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard: ``id_col, size, text_crc32, shard, slot``.

    Size is the text's UTF-8 bytes (NULL: none) plus 1. Rows stand in the order
    of their ids (NULL first, ties by size, checksum and place of reading); a
    row belongs to the shard that holds its middle byte, so shard sizes differ
    from the target by less than one row. Slots count from 0 in each shard
    without gaps. Equal texts stay together only where their ids do. Repeated
    rows and ids count each; an empty table gives an empty result; a shard can
    be empty when one row is larger than the target.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.monotonically_increasing_id().alias("read"),
    )
    keys = [F.col("id").asc_nulls_first(), F.col("size"), F.col("crc"), F.col("read")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("read").withColumn("place", F.monotonically_increasing_id())
    rows = materialize(rows).withColumn("part", F.shiftright("place", _PART).cast("int"))
    totals = {r[0]: (r[1], r[2]) for r in rows.groupBy("part").agg(F.sum("size"), F.count("*")).collect()}  # one row a partition
    bytes_before, rows_before = [0], [0]
    for p in range(max(totals, default=-1) + 1):
        size, n = totals.get(p, (0, 0))
        bytes_before.append(bytes_before[-1] + size)
        rows_before.append(rows_before[-1] + n)
    total = max(1, bytes_before[-1])

    here = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("size").over(here) + F.get(F.lit(bytes_before), F.col("part"))
    row = F.get(F.lit(rows_before), F.col("part")) + F.col("place").bitwiseAND(F.lit((1 << _PART) - 1))
    placed = rows.withColumn("end", end).withColumn("row", row.cast("long"))
    wide = "decimal(38,0)" if total * 2 * n_shards >= 1 << 62 else "long"
    middle = f"CAST((2 * end - size) AS {wide}) * {n_shards} div CAST({2 * total} AS {wide})"
    placed = placed.withColumn("shard", F.least(F.expr(middle), F.lit(n_shards - 1)).cast("int"))
    firsts = dict(placed.groupBy("shard").agg(F.min("row")).collect())  # one row a shard
    first = F.get(F.lit([firsts.get(s, 0) for s in range(n_shards)]), F.col("shard"))
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - first).cast("long").alias("slot"))
