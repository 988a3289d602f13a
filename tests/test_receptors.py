from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from airrline import agg_receptors, agg_repertoires, make_receptor_schema

ROWS = [
    # cdr3, v, cell, locus, umi, sample, count
    ("AAA", "V1", "c1", "TRA", 5.0, "s1", 3), ("AAA", "V1", "c1", "TRB", 9.0, "s1", 1), ("BBB", None, "c2", "TRA", 2.0, "s1", 2),
    ("AAA", "V1", "c3", "TRA", 7.0, "s2", 4), (None, "V2", "c3", "TRA", 7.0, "s2", 1), ("CCC", "V2", "c3", "TRB", 1.0, "s2", 1),
    ("CCC", "V2", "c3", "TRB", 4.0, "s2", 1), ("DDD", "V3", "c4", "TRA", None, None, 1), ("DDD", "V3", "c4", "TRB", 2.0, None, 1), (None, "V2", "c5", "TRG", 1.0, None, 0),
]
COLUMNS = "cdr3 string, v string, cell string, locus string, umi double, sample string, n int"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], COLUMNS + ", pos int")


def test_simple(rows):
    out = agg_receptors(rows, ["cdr3", "v"], order_by=["pos"]).annotations.collect()
    assert sorted(r.imd_chain_id for r in out) == list(range(1, len(ROWS) + 1))
    assert all(r.imd_barcode == r.imd_chain_id == r.pos + 1 and r.imd_n_chains == 1.0 and r.imd_count == 0.0 for r in out)
    ids = {(r.cdr3, r.v): r.imd_receptor_id for r in out}
    assert sorted(ids.values()) == list(range(1, len(ids) + 1)) and len(out) == len(ROWS)
    order = sorted(ids, key=lambda k: tuple((x is not None, x or "") for x in k))
    assert [ids[k] for k in order] == list(range(1, len(ids) + 1))


def test_bulk_counts_and_hash_ids(rows):
    out = agg_receptors(rows, "cdr3", count_col="n", id_strategy="hash").annotations.collect()
    assert Counter(r.imd_n_chains for r in out) == Counter(float(r[6]) for r in ROWS)
    assert len({r.imd_receptor_id for r in out}) == len({r[0] for r in ROWS})


def test_single_locus_and_renamed_locus(rows):
    other = rows.withColumnRenamed("locus", "which")
    idata = agg_receptors(other, make_receptor_schema(["cdr3"], ["TRB"]), barcode_col="cell", locus_col="which")
    assert {r.locus for r in idata.annotations.collect()} == {"TRB"}
    assert idata.receptors.count() == 3 and idata.count().first().n == 4


def test_paired_keeps_ties_and_other_chains(rows):
    idata = agg_receptors(rows, make_receptor_schema(["cdr3"], ["TRA", "TRB"]), barcode_col="cell", locus_col="locus", umi_col="umi", order_by=["pos"])
    by = defaultdict(list)
    for r in idata.annotations.collect():
        by[r.imd_barcode, r.imd_receptor_id].append(r.pos)
    # c1 pairs; c3 ties on TRA, so two ids with all four chains each; c2 has one locus; c4's TRA has no UMI
    assert {k: sorted(v) for k, v in by.items()} == {("c1", 1): [0, 1], ("c3", 2): [3, 4, 5, 6], ("c3", 3): [3, 4, 5, 6]}
    view = idata.receptors.collect()
    assert Counter(r.imd_receptor_id for r in view) == {1: 1, 2: 4, 3: 4}
    assert set(idata.receptors.columns) == {"imd_receptor_id", "imd_barcode", "cdr3.x", "locus.x", "cdr3.y", "locus.y"}


def test_null_barcodes_pair_with_nothing(spark):
    rows = spark.createDataFrame([("A", None, "TRA", 1.0), ("B", None, "TRB", 1.0), ("A", "c", "TRA", 1.0), ("B", "c", "TRB", 1.0)], "cdr3 string, cell string, locus string, umi double")
    idata = agg_receptors(rows, make_receptor_schema(["cdr3"], ["TRA", "TRB"]), barcode_col="cell", locus_col="locus", umi_col="umi")
    assert {r.imd_barcode for r in idata.annotations.collect()} == {"c"} and idata.receptors.count() == 1


def test_repertoires_need_no_ids(rows, monkeypatch):
    import airrline.operators.receptors as module

    asked = []
    monkeypatch.setattr(module, "dense_ids", lambda df, name, by=(), own=module.dense_ids: asked.append(name) or own(df, name, by))
    idata = agg_repertoires(agg_receptors(rows, ["cdr3", "v"], count_col="n"), "sample")
    table = sorted(map(tuple, idata.repertoires.collect()))
    assert not asked
    rows_then = idata.annotations
    assert asked and rows_then is idata.annotations
    from_ids = agg_repertoires(idata.over(rows_then), "sample")
    assert sorted(map(tuple, from_ids.repertoires.collect())) == table
    assert Counter(map(str, from_ids.annotations.collect())) == Counter(map(str, rows_then.collect()))


def test_repertoires_by_a_feature(rows):
    idata = agg_repertoires(agg_receptors(rows, ["cdr3", "v"], order_by=["pos"]), ["v", "sample"])
    pairs = {(r[1], r[5]): set() for r in ROWS}
    for r in ROWS:
        pairs[r[1], r[5]].add(r[0])
    assert {(r.v, r.sample): r.n_receptors for r in idata.repertoires.collect()} == {k: len(v) for k, v in pairs.items()}
    assert idata.annotations.count() == len(ROWS)


def test_refusals(rows):
    with pytest.raises(ValueError, match="Undefined case"):
        agg_receptors(rows, "cdr3", barcode_col="cell", count_col="n")
    with pytest.raises(ValueError, match="Unsupported case"):
        agg_receptors(rows, make_receptor_schema(["cdr3"], ["a", "b", "c"]), barcode_col="cell", locus_col="locus")
    with pytest.raises(ValueError, match="Not all columns"):
        agg_receptors(rows, ["cdr3", "missing"])


@pytest.mark.parametrize("keys", [["sample"], ["sample", "v"]])
def test_repertoires_against_plain_counts(rows, keys):
    idata = agg_repertoires(agg_receptors(rows, ["cdr3", "v"], count_col="n", order_by=["pos"]), keys)
    counts, where = Counter(), defaultdict(set)
    got = idata.annotations.collect()
    for r in got:
        g = tuple(r[k] for k in keys)
        counts[g, r.imd_receptor_id] += r.n
        where[r.imd_receptor_id].add(g)
    totals = Counter()
    for (g, _), n in counts.items():
        totals[g] += n
    for r in got:
        g = tuple(r[k] for k in keys)
        assert r.imd_count == counts[g, r.imd_receptor_id] and r.n_repertoires == len(where[r.imd_receptor_id])
        assert r.imd_proportion == (pytest.approx(r.imd_count / totals[g]) if totals[g] else None)
    table = idata.repertoires.collect()
    assert [r.imd_repertoire_id for r in table] == list(range(1, len(totals) + 1))
    for r in table:
        g = tuple(r[k] for k in keys)
        assert r.n_barcodes == totals[g] and r.n_receptors == sum(x == g for x, _ in counts)
    again = agg_repertoires(idata, keys)
    assert Counter(map(tuple, again.repertoires.collect())) == Counter(map(tuple, table)) and again.annotations.columns == idata.annotations.columns


def test_missing_repertoire_columns_and_empty_table(rows):
    idata = agg_receptors(rows, "cdr3")
    with pytest.raises(ValueError, match="Missing columns"):
        agg_repertoires(idata, "nope")
    none = agg_repertoires(agg_receptors(rows.filter(F.lit(False)), "cdr3"), "sample")
    assert none.annotations.count() == none.repertoires.count() == none.receptors.count() == 0
