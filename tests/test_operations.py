from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from airrline import (
    agg_receptors, agg_repertoires, annotate, annotate_barcodes, annotate_chains, annotate_receptors, filter_barcodes, filter_data,
    filter_receptors, make_receptor_schema, make_seq_options, mutate_data,
)

SEQ = ["CASSA", "CASSB", "CASS", "CASSA", None, "", "é'x", "CxSSA", "CASSAB", "CASSA"]


@pytest.fixture
def idata(spark):
    rows = [(i, s, f"V{i % 3}", "TRA" if i % 2 else "TRB", f"c{i % 4}", i % 2) for i, s in enumerate(SEQ)]
    df = spark.createDataFrame(rows, "pos int, seq string, v string, locus string, cell string, sample int")
    return agg_repertoires(agg_receptors(df, ["seq", "v"], barcode_col="cell", order_by=["pos"]), "sample")


def kept(x):
    return sorted(r.pos for r in x.annotations.collect())


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_predicates_count_again(idata):
    out = filter_data(idata, F.col("v") == "V1", "pos < 8")
    assert kept(out) == [1, 4, 7] and out.schema_repertoire == ("sample",)
    assert sum(r.n_barcodes for r in out.repertoires.collect()) == 3
    bare = filter_data(idata, "pos < 3", keep_repertoires=False)
    assert bare.repertoires is None and "imd_count" in bare.annotations.columns
    with pytest.raises(ValueError):
        filter_data(idata)


def test_exact_works_on_receptors(idata):
    exact = make_seq_options("seq", "CASSA")
    assert kept(filter_data(idata, seq_options=exact)) == [0, 3, 9]
    # rows 0, 3, 9 are one receptor; the predicate finds it by row 0 and is not asked again
    assert kept(filter_data(idata, "pos = 0", seq_options=exact)) == [0, 3, 9]
    assert kept(idata.filter(seq_options=make_seq_options("seq", ["é'x", ""]))) == [5, 6]


def test_regex_lev_hamm(idata):
    assert kept(filter_data(idata, seq_options=make_seq_options("seq", ["^CA", "x$"], "regex"))) == [0, 1, 2, 3, 6, 8, 9]
    for d in (0, 1, 2):
        near = [i for i, s in enumerate(SEQ) if s is not None and any(edit(s, p) <= d for p in ("CASSA", "é'"))]
        assert kept(filter_data(idata, seq_options=make_seq_options("seq", ["CASSA", "é'"], "lev", d))) == near
        same = [i for i, s in enumerate(SEQ) if s is not None and len(s) == 5 and sum(a != b for a, b in zip(s, "CASSA", strict=True)) <= d]
        assert kept(filter_data(idata, seq_options=make_seq_options("seq", "CASSA", "hamm", d))) == same
    with pytest.raises(ValueError, match="max_dist"):
        filter_data(idata, seq_options=make_seq_options("seq", "A", "lev"))
    with pytest.raises(ValueError):
        make_seq_options("seq", "A", "lev", 1.5)
    with pytest.raises(ValueError):
        filter_data(idata, seq_options=make_seq_options("other", "A"))


def test_ids(idata):
    assert kept(filter_barcodes(idata, ["c1", "c1", "zz"])) == [1, 5, 9]
    ids = {r.pos: r.imd_receptor_id for r in idata.annotations.collect()}
    assert kept(filter_receptors(idata, [ids[0], ids[6]])) == [0, 3, 6, 9]
    with pytest.raises(ValueError):
        filter_barcodes(idata, [])


def test_mutate(idata):
    out = mutate_data(idata, twice=F.col("pos") * 2, more="twice + 1")
    assert {(r.twice, r.more) for r in out.annotations.collect()} == {(2 * i, 2 * i + 1) for i in range(len(SEQ))}
    assert out.repertoires.count() == idata.repertoires.count()
    for name in ("imd_count", "locus", "filename"):
        with pytest.raises(ValueError, match="reserved"):
            mutate_data(idata, **{name: F.lit(1)})
    rows = {r.pos: r for r in mutate_data(idata, seq_options=make_seq_options("seq", ["CASSA", "CASS"], "lev", name_type="pattern")).annotations.collect()}
    assert all(rows[i]["imd_sim_lev_CASSA"] == (None if s is None else edit(s, "CASSA")) for i, s in enumerate(SEQ))
    rows = {r.pos: r for r in idata.mutate(seq_options=make_seq_options("seq", ["CASSB"], "hamm")).annotations.collect()}
    assert len(rows) == len(SEQ) and rows[0]["imd_sim_hamm_1"] == 1 and rows[2]["imd_sim_hamm_1"] is None and rows[4]["imd_sim_hamm_1"] is None
    rows = {r.pos: r for r in idata.mutate(seq_options=make_seq_options("seq", ["^CA"], "regex")).annotations.collect()}
    assert len(rows) == len(SEQ) and rows[0]["imd_sim_regex_1"] and not rows[5]["imd_sim_regex_1"] and rows[4]["imd_sim_regex_1"] is None
    rows = {r.pos: r for r in idata.mutate(seq_options=make_seq_options("seq", ["CASSA"])).annotations.collect()}
    assert rows[0]["imd_sim_exact_1"] and rows[4]["imd_sim_exact_1"] is None
    with pytest.raises(ValueError, match="one column name"):
        idata.mutate(seq_options=make_seq_options("seq", ["A-", "A+"], name_type="pattern"))


def test_annotate(spark, idata):
    cells = spark.createDataFrame([("c1", "x", "note"), ("c1", "y", "note"), ("c2", "z", "note"), (None, "w", "note")], "cell_id string, label string, v string")
    out = annotate_barcodes(idata, cells, "cell_id").annotations.collect()
    assert Counter(r.label for r in out) == Counter({"x": 3, "y": 3, "z": 2, None: 5})
    assert "v.x" in out[0].asDict() and "v.y" in out[0].asDict()
    frame = pd.DataFrame({"label": ["p", "q"]}, index=["c0", "c3"])
    assert Counter(r.label for r in annotate_barcodes(idata, frame).annotations.collect()) == Counter({"p": 3, "q": 2, None: 5})
    assert annotate_receptors(idata, spark.createDataFrame([(1, "a")], "imd_receptor_id long, tag string")).annotations.filter("tag = 'a'").count() >= 1
    assert annotate_chains(idata, spark.createDataFrame([(1, "a")], "imd_chain_id long, tag string")).annotations.filter("tag = 'a'").count() == 1
    null_key = spark.createDataFrame([(None, "none")], "s string, tag string")
    assert annotate(idata, null_key, {"seq": "s"}).annotations.filter("tag = 'none'").count() == 1


def test_annotate_guards(spark, idata):
    wide = spark.range(1).select(F.lit("c1").alias("k"), *[F.lit(i).alias(f"x{i}") for i in range(100)])
    with pytest.raises(ValueError, match="remove_limit"):
        annotate(idata, wide, {"cell": "k"})
    assert annotate(idata, wide, {"cell": "k"}, remove_limit=True).annotations.count() == len(SEQ)
    small = wide.select("k", "x1", F.lit("c").alias("cell"))
    for by in ({}, {"cell": "nope"}, {"nope": "k"}, {"cell": "k"}):
        with pytest.raises(ValueError):
            annotate(idata, small, by)
    with pytest.raises(ValueError):
        annotate_barcodes(idata, small)


def test_print(idata, capsys):
    assert idata.print(2) is idata and "imd_receptor_id" in capsys.readouterr().out


def test_schema_checks():
    from airrline import assert_receptor_schema, imd_receptor_chains, imd_receptor_features, test_receptor_schema

    schema = make_receptor_schema(["a", "b"], "TRB")
    assert imd_receptor_features(schema) == ("a", "b") and imd_receptor_chains(schema) == ("TRB",)
    assert test_receptor_schema({"features": ["a"], "chains": None}) and not test_receptor_schema({"features": ["a"]}) and not test_receptor_schema([]) and not test_receptor_schema(3)
    assert assert_receptor_schema("a").features == ("a",)
    with pytest.raises(ValueError):
        assert_receptor_schema({"x": 1})
