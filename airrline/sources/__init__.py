from airrline.sources.frames import from_frames
from airrline.sources.ingest import read_repertoires
from airrline.sources.metadata import read_metadata
from airrline.sources.saved import open_dataset, save_dataset
from airrline.sources.scan import scan_tables
from airrline.sources.steps import make_barcode_prefix, make_default_postprocessing, make_default_preprocessing, make_exclude_columns, make_productive_filter

__all__ = [
    "from_frames", "make_barcode_prefix", "make_default_postprocessing", "make_default_preprocessing", "make_exclude_columns",
    "make_productive_filter", "open_dataset", "read_metadata", "read_repertoires", "scan_tables", "save_dataset",
]
