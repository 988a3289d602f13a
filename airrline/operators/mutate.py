"""New columns, by expression or by sequence matching."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from airrline.dataset import AirrData
from airrline.functions.sequences import match_columns
from airrline.names import SCHEMA
from airrline.schema import SeqOptions, check_seq_options, pattern_columns


def mutate_data(idata: AirrData, seq_options: SeqOptions | None = None, **columns: Column | str) -> AirrData:
    """Add or change columns in the order given; later ones may use earlier ones.

    Reserved names are refused. Sequence options add a column for each pattern;
    ``max_dist`` plays no part here. Repertoires are carried over as they are.
    """
    if clash := sorted(set(columns) & set(SCHEMA.values())):
        raise ValueError(f"reserved column names: {', '.join(clash)}")
    rows = idata.annotations
    for name, expr in columns.items():
        rows = rows.withColumn(name, F.expr(expr) if isinstance(expr, str) else expr)
    if seq_options is not None:
        options = check_seq_options(seq_options, "mutate", rows.columns)
        names = pattern_columns(options, SCHEMA[f"sim_{options.method}"])
        rows = rows.withColumns(dict(zip(names, match_columns(options), strict=True)))
    return idata.over(rows, keep_repertoires=True)
