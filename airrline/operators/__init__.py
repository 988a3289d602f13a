from airrline.operators.annotate import annotate, annotate_barcodes, annotate_chains, annotate_data, annotate_receptors
from airrline.operators.filters import filter_barcodes, filter_data, filter_receptors
from airrline.operators.mutate import mutate_data
from airrline.operators.receptors import agg_receptors
from airrline.operators.repertoires import agg_repertoires

__all__ = [
    "agg_receptors", "agg_repertoires", "annotate", "annotate_barcodes", "annotate_chains", "annotate_data",
    "annotate_receptors", "filter_barcodes", "filter_data", "filter_receptors", "mutate_data",
]
