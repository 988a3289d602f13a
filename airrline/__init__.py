"""A Spark-native data layer for immune-receptor repertoires."""

from airrline.dataset import AirrData
from airrline.names import imd_drop_cols, imd_files, imd_meta_schema, imd_rename_cols, imd_repertoire_schema, imd_schema, imd_schema_sym
from airrline.operators import (
    agg_receptors, agg_repertoires, annotate, annotate_barcodes, annotate_chains, annotate_data, annotate_receptors,
    filter_barcodes, filter_data, filter_receptors, mutate_data,
)
from airrline.samples import get_test_idata, get_test_data
from airrline.schema import (
    ReceptorSchema, SeqOptions, assert_receptor_schema, imd_receptor_chains, imd_receptor_features,
    make_receptor_schema, make_seq_options, test_receptor_schema,
)
from airrline.sources import (
    from_frames, make_barcode_prefix, make_default_postprocessing, make_default_preprocessing, make_exclude_columns,
    make_productive_filter, open_dataset, read_metadata, read_repertoires, save_dataset,
)

__all__ = [name for name in dir() if not name.startswith("_")]
