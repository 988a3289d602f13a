"""Repertoire statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from airrline.dataset import AirrData
from airrline.names import COUNT, N_BARCODES, N_CHAINS, N_RECEPTORS, N_REPERTOIRES, PROPORTION, RECEPTOR, REPERTOIRE, c
from airrline.plans.ids import dense_ids
from airrline.plans.joins import BROADCAST_ROWS, null_safe_join

_SUMMARY = (REPERTOIRE, COUNT, PROPORTION, N_REPERTOIRES, N_BARCODES, N_RECEPTORS)


def agg_repertoires(idata: AirrData, schema: str | Sequence[str] = "repertoire_id") -> AirrData:
    """Group receptors into repertoires by ``schema`` and count them.

    The counts of (repertoire, receptor) are made first; sizes, proportions and
    publicity all come from that smaller table, which the chains meet in one
    join. While the chains have no ids yet, features stand for the receptor, so
    the table of repertoires needs no ids. NULL group values form a group. NULL
    chain counts are skipped by sums; a repertoire of total 0 has a NULL
    proportion. Ids follow the order of the schema columns, NULL first.
    """
    keys = (schema,) if isinstance(schema, str) else tuple(schema)
    if not keys:
        raise ValueError("at least one repertoire column is needed")
    facts = idata.facts if idata.facts is not None and set(keys) <= set(idata.facts.columns) else None
    rows = facts if facts is not None else idata.annotations.drop(*_SUMMARY)
    if missing := [k for k in keys if k not in rows.columns]:
        raise ValueError(f"Missing columns in `annotations`: {', '.join(missing)}")

    k = [c(x) for x in keys]
    receptor = [f for f in idata.schema_receptor.features if f not in keys] if facts is not None else [RECEPTOR]
    counts = rows.groupBy(*k, *[c(x) for x in receptor]).agg(F.sum(c(N_CHAINS)).alias(COUNT))

    def table() -> DataFrame:
        sizes = counts.groupBy(*k).agg(F.sum(COUNT).alias(N_BARCODES), F.count("*").alias(N_RECEPTORS))
        return dense_ids(sizes, REPERTOIRE, keys).select(c(REPERTOIRE), *k, N_BARCODES, N_RECEPTORS)

    def annotations() -> DataFrame:
        sizes = out.repertoire_table.drop(N_RECEPTORS)
        few = sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        named = [f for f in idata.schema_receptor.features] if facts is not None else [RECEPTOR]
        public = counts.groupBy(*[c(x) for x in named]).agg(F.count("*").alias(N_REPERTOIRES))
        stats = null_safe_join(counts, F.broadcast(sizes) if few else sizes, keys)
        stats = null_safe_join(stats.withColumn(PROPORTION, F.try_divide(COUNT, N_BARCODES)).drop(N_BARCODES), public, named)
        return null_safe_join(idata.annotations.drop(*_SUMMARY), stats, [*keys, *receptor]).select(*_order())

    def _order() -> list:
        return [c(x) for x in [*idata.annotations.drop(*_SUMMARY).columns, COUNT, REPERTOIRE, PROPORTION, N_REPERTOIRES]]

    out = AirrData(idata.schema_receptor, annotations, table, keys, facts=facts)
    return out


def rebuild(idata: AirrData, annotations, keep_repertoires: bool) -> AirrData:
    """The same dataset over other rows; repertoires are counted again, or dropped (their columns stay as they were)."""
    bare = idata.over(annotations)
    return agg_repertoires(bare, idata.schema_repertoire) if keep_repertoires and idata.schema_repertoire else bare
