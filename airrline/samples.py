"""A small made-up dataset, for tests and first steps."""

from __future__ import annotations

import os
import random
import tempfile

from pyspark.sql import SparkSession

from airrline.dataset import AirrData
from airrline.sources.ingest import read_repertoires

_AMINO = "ACDEFGHIKLMNPQRSTVWY"


def write_sample_files(folder: str, rows: int = 1000, seed: int = 7) -> str:
    """Two chain tables and their sample sheet; returns the sheet's path."""
    r = random.Random(seed)
    pool = [("CASS" + "".join(r.choices(_AMINO, k=r.randint(4, 9))) + "F", f"TRBV{r.randint(1, 30)}*01", f"TRBJ{r.randint(1, 2)}-{r.randint(1, 7)}*01") for _ in range(rows)]
    for name in ("sample_0_1k", "sample_1k_2k"):
        with open(os.path.join(folder, f"{name}.tsv"), "w") as out:
            out.write("sequence\tcdr3_aa\tv_call\tj_call\tlocus\tproductive\tv_score\tfwr1\tcdr1\tcdr2\tfwr2\n")
            for _ in range(rows):
                cdr3, v, j = r.choice(pool)
                seq = "".join(r.choices("ACGT", k=30))
                out.write("\t".join([seq, cdr3, v, j, "TCRB", r.choice("TTTF"), "1.5", seq[:6], seq[6:12], seq[12:18], seq[18:24]]) + "\n")
    sheet = os.path.join(folder, "metadata.tsv")
    with open(sheet, "w") as out:
        out.write("File\tTherapy\tResponse\tPrefix\nsample_0_1k.tsv\tICI\tFR\tS1_\nsample_1k_2k.tsv\tCAR-T\tPR\tS2_\n")
    return sheet


def get_test_idata(spark: SparkSession, folder: str | None = None) -> AirrData:
    """The sample, read with its metadata into ``folder`` (by default a new one, for local sessions)."""
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share")
    folder = folder or tempfile.mkdtemp(prefix="airrline-sample-")
    sheet = write_sample_files(folder)
    return read_repertoires(spark, "<metadata>", ["cdr3_aa", "v_call"], metadata=sheet, output_folder=os.path.join(folder, "saved"))


get_test_data = get_test_idata
