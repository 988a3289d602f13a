"""Filters by predicate, sequence, cell and receptor."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

from airrline.dataset import AirrData
from airrline.functions.sequences import match_predicate
from airrline.names import BARCODE, RECEPTOR, c
from airrline.operators.repertoires import rebuild
from airrline.plans.joins import semi_join_values
from airrline.schema import SeqOptions, check_seq_options


def filter_data(idata: AirrData, *conditions: Column | str, seq_options: SeqOptions | None = None, keep_repertoires: bool = True) -> AirrData:
    """Keep chains for which all conditions hold (NULL counts as no) and the sequence matches.

    Exact matching works on receptors: all chains of a receptor that has one
    matching chain stay, whether or not they meet the conditions themselves.
    The other methods work on chains.
    """
    if not conditions and seq_options is None:
        raise ValueError("a condition or sequence options are needed")
    rows = idata.annotations
    if conditions:
        rows = rows.filter(reduce(and_, [F.expr(x) if isinstance(x, str) else x for x in conditions]))
    if seq_options is not None:
        options = check_seq_options(seq_options, "filter", idata.annotations.columns)
        rows = rows.filter(match_predicate(options))
        if options.method == "exact":
            hits = rows.select(c(RECEPTOR)).distinct()
            rows = idata.annotations.join(hits, RECEPTOR, "left_semi")
    return rebuild(idata, rows, keep_repertoires)


def filter_barcodes(idata: AirrData, barcodes: Sequence, keep_repertoires: bool = True) -> AirrData:
    """Keep the chains of the listed cells."""
    return rebuild(idata, semi_join_values(idata.annotations, BARCODE, barcodes), keep_repertoires)


def filter_receptors(idata: AirrData, receptors: Sequence[int], keep_repertoires: bool = True) -> AirrData:
    """Keep the chains of the listed receptors."""
    return rebuild(idata, semi_join_values(idata.annotations, RECEPTOR, receptors), keep_repertoires)
