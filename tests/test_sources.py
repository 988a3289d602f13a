import gzip
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from airrline import (
    agg_receptors, from_frames, get_test_idata, imd_drop_cols, imd_files, imd_meta_schema, imd_rename_cols, imd_repertoire_schema, imd_schema,
    imd_schema_sym, make_barcode_prefix, make_default_postprocessing, make_default_preprocessing, make_exclude_columns, make_productive_filter,
    open_dataset, read_metadata, read_repertoires, save_dataset,
)
from airrline.samples import write_sample_files
from airrline.sources.scan import file_kind, scan_tables
from airrline.streaming import stream_annotations, stream_counts


def test_names(spark):
    assert imd_schema("receptor") == "imd_receptor_id" and len(imd_schema()) == 21 and imd_repertoire_schema() is None
    assert imd_rename_cols("10x")["locus"] == "chain" and len(imd_drop_cols("universal")) == 21 and len(imd_drop_cols()) == 14
    assert imd_files()["annotations"] == "annotations.parquet" and imd_meta_schema()["version"] == "version" and set(imd_schema_sym()) == set(imd_schema())
    for f in (imd_schema, imd_rename_cols, imd_drop_cols):
        with pytest.raises(KeyError):
            f("nope")


def test_sample_round_trip(spark, tmp_path):
    idata = get_test_idata(spark, str(tmp_path))
    rows = idata.annotations
    assert {"Therapy", "filename", "imd_chain_id"} <= set(rows.columns) and "v_score" not in rows.columns
    assert rows.filter("NOT productive = true AND productive <> 'T'").count() == 0
    assert {r[0] for r in rows.select("Response").distinct().collect()} == {"FR", "PR"}
    assert {r[0] for r in rows.select(F.substring("imd_barcode", 1, 3)).distinct().collect()} == {"S1_", "S2_"}
    meta = json.loads((tmp_path / "saved" / "metadata.json").read_text())
    assert meta["receptor_schema"] == {"features": ["cdr3_aa", "v_call"], "chains": {}} and meta["repertoire_schema"] == {}
    again = open_dataset(spark, str(tmp_path / "saved"))
    assert again.annotations.exceptAll(rows).isEmpty() and again.annotations.count() == rows.count()
    by_sheet = read_repertoires(spark, str(tmp_path / "*1k*.tsv"), ["cdr3_aa"], metadata=str(tmp_path / "metadata.tsv"), output_folder=str(tmp_path / "b"), repertoire_schema="Therapy")
    assert by_sheet.repertoires.count() == 2
    reopened = open_dataset(spark, str(tmp_path / "b"))
    assert reopened.schema_repertoire == ("Therapy",) and reopened.repertoires.collect() == by_sheet.repertoires.collect()
    with pytest.raises(ValueError, match="Missing columns"):
        read_repertoires(spark, str(tmp_path / "*1k*.tsv"), ["cdr3_aa"], output_folder=str(tmp_path / "n"), repertoire_schema="nope")
    save_dataset(by_sheet, str(tmp_path / "c"))
    assert open_dataset(spark, str(tmp_path / "c")).schema_repertoire == ("Therapy",)
    with pytest.raises(FileNotFoundError):
        open_dataset(spark, str(tmp_path / "nowhere"))


def test_ingest_options_and_errors(spark, tmp_path):
    write_sample_files(str(tmp_path), 50)
    one = str(tmp_path / "sample_0_1k.tsv")
    plain = read_repertoires(spark, one, ["cdr3_aa"], preprocess={}, postprocess={})
    assert plain.annotations.count() == 50 and os.path.exists(tmp_path / "airrline-sample_0_1k" / "metadata.json")
    steps = {"drop": make_exclude_columns(["sequence", "fwr1", "absent"])}
    named = read_repertoires(spark, one, ["cdr3", "v_call"], preprocess=steps, postprocess={}, rename_columns={"cdr3": "cdr3_aa"}, output_folder=str(tmp_path / "o"))
    assert not {"sequence", "fwr1", "cdr3_aa"} & set(named.annotations.columns) and named.schema_receptor.features == ("cdr3", "v_call")
    old = read_repertoires(spark, one, ["cdr3_aa", "v_call"], preprocess={}, postprocess={}, rename_columns={"cdr3": "cdr3_aa", "v": "v_call"}, output_folder=str(tmp_path / "p"))
    assert old.schema_receptor.features == ("cdr3", "v")
    with pytest.raises(FileNotFoundError, match="No file provided"):
        read_repertoires(spark, str(tmp_path / "none*.tsv"), ["cdr3_aa"])
    with pytest.raises(ValueError, match="Undefined case"):
        read_repertoires(spark, one, ["cdr3_aa"], barcode_col="sequence", count_col="v_score", preprocess={})
    with pytest.raises(ValueError, match="Not all columns"):
        read_repertoires(spark, one, ["missing"])
    with pytest.raises(TypeError):
        read_repertoires(spark, one, ["cdr3_aa"], preprocess={"x": 1})


def test_scans(spark, tmp_path):
    folder = tmp_path / "with space"
    folder.mkdir()
    (folder / "a.csv").write_text("x,y\n1,p\n2,q\n")
    (folder / "b.csv").write_text("y,x,z\nr,3,9\n")
    paths = [str(folder / "a.csv"), str(folder / "b.csv")]
    rows = {(r.x, r.y, r.z, os.path.basename(r.filename)) for r in scan_tables(spark, paths, enforce_schema=False).collect()}
    assert rows == {(1, "p", None, "a.csv"), (2, "q", None, "a.csv"), (3, "r", 9, "b.csv")}
    assert {r.filename for r in scan_tables(spark, paths[:1]).collect()} == {paths[0]}
    with gzip.open(folder / "c.tsv.gz", "wt") as f:
        f.write("x\ty\n1\tp\n")
    assert scan_tables(spark, [str(folder / "c.tsv.gz")]).first().y == "p"
    typed = scan_tables(spark, [str(folder / "a.csv")], text_types="x double, y string")
    assert dict(typed.dtypes)["x"] == "double" and {r.x for r in typed.collect()} == {1.0, 2.0}
    spark.range(3).write.parquet(str(folder / "d.parquet"))
    spark.range(2).withColumn("w", F.lit(1)).write.parquet(str(folder / "e.parquet"))
    assert scan_tables(spark, [str(folder / "d.parquet"), str(folder / "e.parquet")], enforce_schema=False).filter("w IS NULL").count() == 3
    for bad in (["a.csv", "b.tsv"], ["a.xyz"], ["a.parquet.gz"]):
        with pytest.raises(ValueError):
            file_kind(bad)


def test_metadata(spark, tmp_path):
    write_sample_files(str(tmp_path), 5)
    sheet = tmp_path / "m.tsv"
    sheet.write_text("File\tA\nsample_0_1k.tsv\t1\n" + "".join(f"gone{i}.tsv\t2\n" for i in range(9)))
    with pytest.warns(UserWarning, match="only 1 of 10"):
        assert read_metadata(spark, str(sheet)).filter(F.col("filename") == str(tmp_path / "sample_0_1k.tsv")).count() == 1
    with pytest.raises(ValueError):
        read_metadata(spark, pd.DataFrame({"File": ["sample_0_1k.tsv"]}))
    with pytest.raises(ValueError):
        read_metadata(spark, str(sheet), filename_col="nope")
    with pytest.raises(FileNotFoundError):
        read_metadata(spark, pd.DataFrame({"File": ["/nowhere/x.tsv"]}))


def test_steps(spark):
    df = spark.createDataFrame([("T", "P_", "b"), ("True", None, "c"), ("1", "Q_", None), ("F", "", ""), (None, "", ""), ("junk", "", "")], "productive string, Prefix string, imd_barcode string")
    assert make_default_preprocessing()["filter_nonproductive"](df).count() == 3
    assert make_default_preprocessing("10x")["filter_nonproductive"](df).count() == 3
    assert make_productive_filter(["absent", "productive"], ("junk",))(df).count() == 1
    with pytest.warns(UserWarning):
        assert make_productive_filter("absent")(df).count() == 6
    assert sorted(r.imd_barcode for r in make_default_postprocessing()["prefix_barcodes"](df).collect())[3:] == ["P_b", "Q_", "c"]
    with pytest.warns(UserWarning):
        assert make_barcode_prefix("absent")(df).count() == 6
    assert make_productive_filter("productive", False)(df).count() == 1
    assert sorted(r.imd_barcode for r in make_barcode_prefix(["absent", "Prefix", "productive"])(df).collect())[3:] == ["P_b", "Q_", "c"]
    with pytest.raises(ValueError):
        make_default_preprocessing("other")


def test_list_of_frames(spark, tmp_path):
    data = {"one": pd.DataFrame({"CDR3.aa": ["A", "B"], "V.name": ["v", "v"]}), "two": spark.createDataFrame([("A", "v", 5)], "`CDR3.aa` string, `V.name` string, Clones int")}
    meta = pd.DataFrame({"Sample": ["one", "two"], "Status": ["x", "y"]})
    idata = from_frames(spark, {"data": data, "meta": meta}, str(tmp_path / "o"))
    assert {(r.repertoire_id, r.n_receptors) for r in idata.repertoires.collect()} == {("one", 2), ("two", 1)}
    assert idata.annotations.filter("Status = 'y'").first().n_repertoires == 2
    flagged = {"one": pd.DataFrame({"CDR3.aa": ["A", "B"], "V.name": ["v", "v"], "productive": ["T", "F"], "v_score": [1.0, 2.0]})}
    own = from_frames(spark, {"data": flagged, "meta": meta[:1]}, str(tmp_path / "f"))
    assert [r["CDR3.aa"] for r in own.annotations.collect()] == ["A"] and "v_score" not in own.annotations.columns
    assert from_frames(spark, {"data": flagged, "meta": meta[:1]}, str(tmp_path / "g"), preprocess={}).annotations.count() == 2
    with pytest.raises(ValueError):
        from_frames(spark, {"data": data}, str(tmp_path / "q"))


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_sample_files(str(tmp_path / "in"), 30)
    schema = "sequence string, cdr3_aa string, v_call string, j_call string, locus string, productive string, v_score double, fwr1 string, cdr1 string, cdr2 string, fwr2 string"
    args = (spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state"))
    stream_annotations(*args, pattern="sample*.tsv").awaitTermination()
    landed = spark.read.parquet(str(tmp_path / "out"))
    batch = scan_tables(spark, [str(tmp_path / "in" / f"sample_{x}.tsv") for x in ("0_1k", "1k_2k")])
    assert landed.count() == make_default_preprocessing()["filter_nonproductive"](batch).count() and "v_score" not in landed.columns
    stream_annotations(*args, pattern="sample*.tsv").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == landed.count()
    assert agg_receptors(landed, "cdr3_aa").annotations.count() == landed.count()
    rate = spark.readStream.format("rate").load()
    assert stream_counts(rate, ["value"], "timestamp", "1 minute", "1 minute").isStreaming
