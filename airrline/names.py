"""System column names, file names and column presets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Column names, file names and presets that existing datasets rely on.
SCHEMA = {
    "receptor": "imd_receptor_id",
    "cell": "imd_barcode",
    "barcode": "imd_barcode",
    "chain": "imd_chain_id",
    "group": "imd_group_id",
    "repertoire": "imd_repertoire_id",
    "metadata_filename": "imd_filename",
    "count": "imd_count",
    "receptor_count": "imd_count",
    "chain_count": "imd_n_chains",
    "proportion": "imd_proportion",
    "n_receptors": "n_receptors",
    "n_barcodes": "n_barcodes",
    "n_cells": "n_cells",
    "n_repertoires": "n_repertoires",
    "filename": "filename",
    "locus": "locus",
    "sim_exact": "imd_sim_exact_",
    "sim_regex": "imd_sim_regex_",
    "sim_hamm": "imd_sim_hamm_",
    "sim_lev": "imd_sim_lev_",
}
META_SCHEMA = {"version": "version", "receptor_schema": "receptor_schema", "repertoire_schema": "repertoire_schema"}
FILES = {"metadata": "metadata.json", "receptors": "receptors.parquet", "annotations": "annotations.parquet"}
_GENES = {"v_call": "v_gene", "d_call": "d_gene", "j_call": "j_gene", "locus": "chain"}
RENAME = {"default": _GENES, "10x": _GENES}
_AIRR_DROP = (
    "v_score", "d_score", "j_score", "stop_codon", "vj_in_frame",
    "v_sequence_alignment", "d_sequence_alignment", "j_sequence_alignment",
    "rev_comp", "sequence_alignment", "germline_alignment", "v_cigar", "d_cigar", "j_cigar",
)
_10X_DROP = ("full_length", "is_cell", "contig_id", "raw_clonotype_id", "raw_consensus_id", "high_confidence", "length")
DROP = {"universal": _AIRR_DROP + _10X_DROP, "airr": _AIRR_DROP, "10x": _10X_DROP}

RECEPTOR, BARCODE, CHAIN = SCHEMA["receptor"], SCHEMA["barcode"], SCHEMA["chain"]
REPERTOIRE, COUNT, N_CHAINS, PROPORTION = SCHEMA["repertoire"], SCHEMA["count"], SCHEMA["chain_count"], SCHEMA["proportion"]
N_RECEPTORS, N_BARCODES, N_REPERTOIRES = SCHEMA["n_receptors"], SCHEMA["n_barcodes"], SCHEMA["n_repertoires"]
FILENAME, LOCUS = SCHEMA["filename"], SCHEMA["locus"]


def _pick(table: dict, key: str, what: str):
    if key not in table:
        raise KeyError(f"unknown {what} {key!r}; known: {', '.join(table)}")
    return table[key]


def imd_schema(key: str | None = None):
    """The whole name map, or one system column name."""
    return dict(SCHEMA) if key is None else _pick(SCHEMA, key, "schema key")


def imd_schema_sym(key: str | None = None) -> Column | dict[str, Column]:
    """The same as ``imd_schema``, as columns."""
    return {k: F.col(v) for k, v in SCHEMA.items()} if key is None else F.col(imd_schema(key))


def imd_meta_schema() -> dict[str, str]:
    return dict(META_SCHEMA)


def imd_files() -> dict[str, str]:
    return dict(FILES)


def imd_rename_cols(format: str = "default") -> dict[str, str]:
    """New name -> old name."""
    return dict(_pick(RENAME, format, "rename preset"))


def imd_drop_cols(format: str = "airr") -> tuple[str, ...]:
    return _pick(DROP, format, "drop preset")


def imd_repertoire_schema(format: str = "airr") -> None:
    """No preset exists; always None."""
    return None


def q(name: str) -> str:
    """Quote a column name, so that dots in it are not read as struct access."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(q(name))
