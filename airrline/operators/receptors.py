"""Receptor assignment: a receptor id for every chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from airrline.dataset import AirrData
from airrline.names import BARCODE, CHAIN, COUNT, LOCUS, N_CHAINS, RECEPTOR, c
from airrline.plans.ids import dense_ids, hash_ids
from airrline.plans.joins import null_safe_join
from airrline.schema import as_receptor_schema


def agg_receptors(
    dataset: DataFrame,
    schema,
    barcode_col: str | None = None,
    count_col: str | None = None,
    locus_col: str | None = None,
    umi_col: str | None = None,
    order_by: Sequence[str] = (),
    id_strategy: str = "dense",
) -> AirrData:
    """Give every chain a chain id, a barcode and a receptor id.

    A receptor is a distinct tuple of the schema's features (NULL equals NULL).
    With two loci in the schema it is a pair of chains in one cell: one id for
    each top chain of the first locus (by ``umi_col``, ties kept, NULL never on
    top) in a cell that has a top chain of the second; all chains of both loci
    in such a cell carry it, so a tie repeats the cell's rows for each id. A NULL
    barcode names no cell, so its chains are in no pair.

    Cases: neither barcode nor count (every row is a cell), count only (bulk),
    barcode only (single-cell). Both together are refused. ``order_by`` fixes
    the order of chain ids; without it they follow the order read.
    ``id_strategy="hash"`` trades dense receptor ids for a plan without a sort.
    An empty table gives an empty dataset. Ids are made when the annotations are
    first asked for.
    """
    schema = as_receptor_schema(schema)
    features, chains = schema.features, schema.chains
    if locus_col and locus_col != LOCUS and locus_col in dataset.columns:
        dataset = dataset.drop(LOCUS).withColumnRenamed(locus_col, LOCUS)
        features = tuple(LOCUS if f == locus_col else f for f in features)
        schema = as_receptor_schema({"features": features, "chains": chains})
        locus_col = LOCUS
    needed = {*features, *filter(None, (barcode_col, count_col, locus_col, umi_col))}
    if missing := sorted(needed - set(dataset.columns)):
        raise ValueError(f"Not all columns in the receptor schema present in the data: {missing}")
    if barcode_col and count_col:
        raise ValueError("Undefined case: both barcodes and counts are given")
    if len(chains) > 2:
        raise ValueError("Unsupported case: more than two chains")
    if chains and not locus_col:
        raise ValueError("a schema with chains needs `locus_col`")
    if len(chains) == 2 and not (barcode_col and umi_col):
        raise ValueError("pairing needs `barcode_col` and `umi_col`")
    if id_strategy not in ("dense", "hash"):
        raise ValueError("id_strategy must be 'dense' or 'hash'")
    if chains:
        dataset = dataset.filter(c(LOCUS).isin(*chains))

    n_chains = c(count_col).cast("double") if count_col else F.lit(1.0)

    def annotations() -> DataFrame:
        rows = dense_ids(dataset, CHAIN, order_by)
        rows = rows.withColumn(BARCODE, c(barcode_col) if barcode_col else c(CHAIN)).withColumn(N_CHAINS, n_chains).withColumn(COUNT, F.lit(0.0))
        if len(chains) == 2:
            return _pair(rows, chains, umi_col)
        ids = rows.select(*[c(f) for f in features]).distinct()
        ids = dense_ids(ids, RECEPTOR, features) if id_strategy == "dense" else hash_ids(ids, RECEPTOR, features)
        return null_safe_join(rows, ids, features)

    return AirrData(schema, annotations, facts=dataset.withColumn(N_CHAINS, n_chains) if len(chains) < 2 else None)


def _pair(rows: DataFrame, chains: Sequence[str], umi_col: str) -> DataFrame:
    """Top UMIs of both loci come from one aggregation, summed up in map tasks; a chain is on top where its UMI is its cell's.

    Joins can split a cell with many chains, which a window could not.
    """
    rows = rows.filter(c(BARCODE).isNotNull())
    tops = [F.max(F.when(c(LOCUS) == x, c(umi_col))).alias(f"__top{i}") for i, x in enumerate(chains)]
    cells = rows.groupBy(c(BARCODE)).agg(*tops).filter("__top1 IS NOT NULL").select(c(BARCODE).alias("__cell"), "__top0")
    first = rows.filter(c(LOCUS) == chains[0]).select(c(BARCODE), c(umi_col).alias("__umi"), c(CHAIN).alias("__first"))
    firsts = first.join(cells, (c(BARCODE) == F.col("__cell")) & (F.col("__umi") == F.col("__top0"))).select(c(BARCODE), "__first")
    ids = dense_ids(firsts, RECEPTOR, (BARCODE, "__first")).drop("__first")
    return null_safe_join(ids, rows, [BARCODE]).select(*[c(x) for x in rows.columns], c(RECEPTOR))
