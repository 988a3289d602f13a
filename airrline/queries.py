"""Headline queries over the driver's tables, each with its DuckDB equivalent.

The tables hold no receptor data, so columns stand in: ``p_name`` for a
sequence, ``p_type`` for a gene, ``events.user_id`` for a cell, ``event_type``
for a locus, ``value`` for UMIs.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from airrline.dataset import AirrData
from airrline.names import (
    COUNT, N_REPERTOIRES, PROPORTION, RECEPTOR, REPERTOIRE, c, imd_files, imd_meta_schema, imd_rename_cols, imd_repertoire_schema, imd_schema,
)
from airrline.operators import (
    agg_receptors, agg_repertoires, annotate, annotate_barcodes, annotate_chains, annotate_data, annotate_receptors,
    filter_barcodes, filter_data, filter_receptors, mutate_data,
)
from airrline.plans.joins import null_safe_join
from airrline.plans.materialize import ensure_checkpoint_dir
from airrline.schema import assert_receptor_schema, imd_receptor_chains, imd_receptor_features, make_receptor_schema, make_seq_options, test_receptor_schema
from airrline.sources import (
    from_frames, make_barcode_prefix, make_default_postprocessing, make_default_preprocessing, make_exclude_columns, make_productive_filter, open_dataset,
    read_metadata, read_repertoires, save_dataset, scan_tables,
)
from airrline.sources.files import expand, write_text
from airrline.sources.scan import file_kind, resolve_paths

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# The stand-in datasets, as SQL: part rows by key with receptor ids by (p_name, p_type).
_SIMPLE = """
simple AS (
  SELECT p.*, row_number() OVER (ORDER BY p_partkey) AS imd_chain_id, row_number() OVER (ORDER BY p_partkey) AS imd_barcode,
         CAST(1 AS DOUBLE) AS imd_n_chains, CAST(0 AS DOUBLE) AS imd_count, r.imd_receptor_id
  FROM part p JOIN (SELECT p_name, p_type, row_number() OVER (ORDER BY p_name, p_type) AS imd_receptor_id
                    FROM (SELECT DISTINCT p_name, p_type FROM part)) r USING (p_name, p_type))"""
_REP = """
counts AS (SELECT p_brand, imd_receptor_id, sum(imd_n_chains) AS imd_count FROM {src} GROUP BY ALL),
sizes AS (SELECT row_number() OVER (ORDER BY p_brand) AS imd_repertoire_id, p_brand, sum(imd_count) AS n_barcodes, count(*) AS n_receptors
          FROM counts GROUP BY p_brand),
public AS (SELECT imd_receptor_id, count(*) AS n_repertoires FROM counts GROUP BY 1)"""
_BULK = """
bulk AS (SELECT p.*, row_number() OVER (ORDER BY p_partkey) AS imd_chain_id, CAST(p_size AS DOUBLE) AS imd_n_chains, r.imd_receptor_id
  FROM part p JOIN (SELECT p_name, p_type, row_number() OVER (ORDER BY p_name, p_type) AS imd_receptor_id
                    FROM (SELECT DISTINCT p_name, p_type FROM part)) r USING (p_name, p_type))"""
_CELLS = """
chains AS (SELECT user_id, event_type, value, event_id, row_number() OVER (ORDER BY event_id) AS imd_chain_id
           FROM events WHERE event_type IN ('click', 'view')),
tops AS (SELECT *, max(CASE WHEN event_type = 'click' THEN value END) OVER w AS t1, max(CASE WHEN event_type = 'view' THEN value END) OVER w AS t2
         FROM chains WINDOW w AS (PARTITION BY user_id)),
ids AS (SELECT user_id, row_number() OVER (ORDER BY user_id, imd_chain_id) AS imd_receptor_id
        FROM tops WHERE event_type = 'click' AND value = t1 AND t2 IS NOT NULL),
paired AS (SELECT imd_receptor_id, user_id AS imd_barcode, imd_chain_id, event_type, value FROM ids JOIN chains USING (user_id))"""


def query(name: str, sql: str):
    def add(f: Query) -> Query:
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def simple(spark: SparkSession, sf_dir: str) -> AirrData:
    return agg_receptors(table(spark, sf_dir, "part"), ["p_name", "p_type"], order_by=["p_partkey"])


def bulk(spark: SparkSession, sf_dir: str) -> AirrData:
    return agg_receptors(table(spark, sf_dir, "part"), ["p_name", "p_type"], count_col="p_size", order_by=["p_partkey"])


def cells(spark: SparkSession, sf_dir: str) -> AirrData:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    schema = make_receptor_schema(["value"], ["click", "view"])
    return agg_receptors(events, schema, barcode_col="user_id", locus_col="event_type", umi_col="value", order_by=["event_id"])


@query("flagship_repertoires", """
WITH counts AS (SELECT l_returnflag, l_linestatus, l_partkey, sum(l_quantity) AS n FROM lineitem GROUP BY ALL)
SELECT row_number() OVER (ORDER BY l_returnflag, l_linestatus) AS imd_repertoire_id, l_returnflag, l_linestatus,
       sum(n) AS n_barcodes, count(*) AS n_receptors FROM counts GROUP BY l_returnflag, l_linestatus""")
def flagship(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    return agg_repertoires(agg_receptors(lines, "l_partkey", count_col="l_quantity"), ["l_returnflag", "l_linestatus"]).repertoires


@query("receptors_simple", f"WITH {_SIMPLE} SELECT imd_chain_id, imd_barcode, imd_receptor_id, imd_n_chains, imd_count, p_name, p_type FROM simple")
def _(spark, sf_dir):
    return simple(spark, sf_dir).annotations.select("imd_chain_id", "imd_barcode", RECEPTOR, "imd_n_chains", COUNT, "p_name", "p_type")


@query("receptors_bulk", f"WITH {_BULK} SELECT imd_chain_id, imd_receptor_id, imd_n_chains, p_name, p_type FROM bulk")
def _(spark, sf_dir):
    return bulk(spark, sf_dir).annotations.select("imd_chain_id", RECEPTOR, "imd_n_chains", "p_name", "p_type")


@query("receptors_single_chain", """
WITH r AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) AS imd_chain_id, dense_rank() OVER (ORDER BY user_id) AS imd_receptor_id
           FROM events WHERE event_type = 'click')
SELECT event_id, user_id AS imd_barcode, imd_chain_id, imd_receptor_id FROM r""")
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    idata = agg_receptors(events, make_receptor_schema(["user_id"], ["click"]), barcode_col="user_id", locus_col="event_type", order_by=["event_id"])
    return idata.annotations.select("event_id", "imd_barcode", "imd_chain_id", RECEPTOR)


@query("receptors_view", f"WITH {_SIMPLE} SELECT DISTINCT imd_receptor_id, p_name, p_type FROM simple")
def _(spark, sf_dir):
    return simple(spark, sf_dir).receptors


@query("receptors_paired", f"WITH {_CELLS} SELECT imd_receptor_id, imd_barcode, imd_chain_id, event_type AS locus, value FROM paired")
def _(spark, sf_dir):
    return cells(spark, sf_dir).annotations.select(RECEPTOR, "imd_barcode", "imd_chain_id", "locus", "value")


@query("receptors_paired_view", f"""WITH {_CELLS}
SELECT coalesce(x.imd_receptor_id, y.imd_receptor_id) AS imd_receptor_id, coalesce(x.imd_barcode, y.imd_barcode) AS imd_barcode,
       x.value AS value_x, y.value AS value_y
FROM (SELECT * FROM paired WHERE event_type = 'click') x FULL JOIN (SELECT * FROM paired WHERE event_type = 'view') y
  ON x.imd_receptor_id = y.imd_receptor_id AND x.imd_barcode = y.imd_barcode""")
def _(spark, sf_dir):
    return cells(spark, sf_dir).receptors.select(RECEPTOR, "imd_barcode", c("value.x").alias("value_x"), c("value.y").alias("value_y"))


@query("repertoire_summary", f"WITH {_SIMPLE}, {_REP.format(src='simple')} SELECT * FROM sizes")
def _(spark, sf_dir):
    return agg_repertoires(simple(spark, sf_dir), "p_brand").repertoires


@query("repertoire_annotations", f"""WITH {_BULK}, {_REP.format(src='bulk')}
SELECT imd_chain_id, imd_repertoire_id, imd_receptor_id, counts.imd_count, round(counts.imd_count / n_barcodes, 9) AS imd_proportion, n_repertoires
FROM bulk JOIN counts USING (p_brand, imd_receptor_id) JOIN sizes USING (p_brand) JOIN public USING (imd_receptor_id)""")
def _(spark, sf_dir):
    rows = agg_repertoires(bulk(spark, sf_dir), "p_brand").annotations
    return rows.select("imd_chain_id", REPERTOIRE, RECEPTOR, COUNT, F.round(PROPORTION, 9).alias(PROPORTION), N_REPERTOIRES)


@query("public_receptors", f"WITH {_SIMPLE}, {_REP.format(src='simple')} SELECT imd_receptor_id, n_repertoires FROM public WHERE n_repertoires >= 5")
def _(spark, sf_dir):
    rows = agg_repertoires(simple(spark, sf_dir), "p_brand").annotations
    return rows.select(RECEPTOR, N_REPERTOIRES).filter(F.col(N_REPERTOIRES) >= 5).distinct()


def _ids(idata: AirrData) -> DataFrame:
    return idata.annotations.select("imd_chain_id", RECEPTOR)


@query("filter_predicate", f"WITH {_SIMPLE} SELECT imd_chain_id, imd_receptor_id FROM simple WHERE p_type = 'PROMO' AND p_size > 10")
def _(spark, sf_dir):
    return _ids(filter_data(simple(spark, sf_dir), F.col("p_type") == "PROMO", "p_size > 10"))


# Patterns are made from the rows at hand: the smallest and largest names of the table.
def _patterns(spark, sf_dir) -> list[str]:
    r = table(spark, sf_dir, "part").agg(F.min("p_name"), F.max("p_name")).first()
    return [r[0], r[1]]


_LO_HI = "pat AS (SELECT min(p_name) AS a, max(p_name) AS b FROM part)"
_LEV = "levenshtein(p_name, {p})"
_HAM = "CASE WHEN length(p_name) = length({p}) THEN hamming(p_name, {p}) END"


@query("filter_exact", f"WITH {_SIMPLE}, {_LO_HI} SELECT imd_chain_id, imd_receptor_id FROM simple, pat WHERE p_name IN (a, b)")
def _(spark, sf_dir):
    return _ids(filter_data(simple(spark, sf_dir), seq_options=make_seq_options("p_name", _patterns(spark, sf_dir))))


@query("filter_exact_with_predicate", f"""WITH {_SIMPLE}, {_LO_HI}
SELECT imd_chain_id, imd_receptor_id FROM simple
WHERE imd_receptor_id IN (SELECT imd_receptor_id FROM simple, pat WHERE p_size > 40 AND p_name IN (a, b))""")
def _(spark, sf_dir):
    return _ids(filter_data(simple(spark, sf_dir), "p_size > 40", seq_options=make_seq_options("p_name", _patterns(spark, sf_dir))))


@query("filter_regex", f"WITH {_SIMPLE} SELECT imd_chain_id, imd_receptor_id FROM simple WHERE regexp_matches(p_name, '^b') OR regexp_matches(p_name, 'e.*r')")
def _(spark, sf_dir):
    return _ids(filter_data(simple(spark, sf_dir), seq_options=make_seq_options("p_name", ["^b", "e.*r"], "regex")))


@query("filter_lev", f"WITH {_SIMPLE}, {_LO_HI} SELECT imd_chain_id, imd_receptor_id FROM simple, pat WHERE least({_LEV.format(p='a')}, {_LEV.format(p='b')}) <= 4")
def _(spark, sf_dir):
    return _ids(filter_data(simple(spark, sf_dir), seq_options=make_seq_options("p_name", _patterns(spark, sf_dir), "lev", 4)))


@query("filter_hamm", f"WITH {_SIMPLE}, {_LO_HI} SELECT imd_chain_id, imd_receptor_id FROM simple, pat WHERE least({_HAM.format(p='a')}, {_HAM.format(p='b')}) <= 5")
def _(spark, sf_dir):
    return _ids(filter_data(simple(spark, sf_dir), seq_options=make_seq_options("p_name", _patterns(spark, sf_dir), "hamm", 5)))


@query("filter_then_reaggregate", f"""WITH {_SIMPLE}, kept AS (SELECT * FROM simple WHERE p_size <= 25), {_REP.format(src='kept')} SELECT * FROM sizes""")
def _(spark, sf_dir):
    return filter_data(agg_repertoires(simple(spark, sf_dir), "p_brand"), "p_size <= 25").repertoires


@query("filter_barcodes", f"WITH {_SIMPLE} SELECT imd_chain_id, imd_receptor_id FROM simple WHERE imd_barcode IN (1, 5, 9, 77)")
def _(spark, sf_dir):
    return _ids(filter_barcodes(simple(spark, sf_dir), [1, 5, 9, 77, 5]))


@query("filter_receptors", f"WITH {_SIMPLE} SELECT imd_chain_id, imd_receptor_id FROM simple WHERE imd_receptor_id IN (2, 3, 50)")
def _(spark, sf_dir):
    return _ids(filter_receptors(simple(spark, sf_dir), [2, 3, 50]))


def _mutated(spark, sf_dir, method, patterns, prefix) -> DataFrame:
    out = mutate_data(simple(spark, sf_dir), seq_options=make_seq_options("p_name", patterns, method))
    return out.annotations.select("imd_chain_id", f"{prefix}1", f"{prefix}2")


@query("mutate_expressions", f"WITH {_SIMPLE} SELECT imd_chain_id, p_size * 2 AS twice, p_size * 2 + 1 AS more FROM simple")
def _(spark, sf_dir):
    return mutate_data(simple(spark, sf_dir), twice="p_size * 2", more=F.col("twice") + 1).annotations.select("imd_chain_id", "twice", "more")


@query("mutate_exact", f"WITH {_SIMPLE}, {_LO_HI} SELECT imd_chain_id, p_name = a AS imd_sim_exact_1, p_name = b AS imd_sim_exact_2 FROM simple, pat")
def _(spark, sf_dir):
    return _mutated(spark, sf_dir, "exact", _patterns(spark, sf_dir), "imd_sim_exact_")


@query("mutate_regex", f"WITH {_SIMPLE} SELECT imd_chain_id, regexp_matches(p_name, '^b') AS imd_sim_regex_1, regexp_matches(p_name, 'e.*r') AS imd_sim_regex_2 FROM simple")
def _(spark, sf_dir):
    return _mutated(spark, sf_dir, "regex", ["^b", "e.*r"], "imd_sim_regex_")


@query("mutate_lev", f"WITH {_SIMPLE}, {_LO_HI} SELECT imd_chain_id, CAST({_LEV.format(p='a')} AS BIGINT) AS imd_sim_lev_1, CAST({_LEV.format(p='b')} AS BIGINT) AS imd_sim_lev_2 FROM simple, pat")
def _(spark, sf_dir):
    return _mutated(spark, sf_dir, "lev", _patterns(spark, sf_dir), "imd_sim_lev_")


@query("mutate_hamm", f"WITH {_SIMPLE}, {_LO_HI} SELECT imd_chain_id, CAST({_HAM.format(p='a')} AS BIGINT) AS imd_sim_hamm_1, CAST({_HAM.format(p='b')} AS BIGINT) AS imd_sim_hamm_2 FROM simple, pat")
def _(spark, sf_dir):
    return _mutated(spark, sf_dir, "hamm", _patterns(spark, sf_dir), "imd_sim_hamm_")


@query("annotate_receptors", f"WITH {_SIMPLE} SELECT imd_chain_id, simple.imd_receptor_id, s_name FROM simple LEFT JOIN supplier ON s_suppkey = simple.imd_receptor_id")
def _(spark, sf_dir):
    notes = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return annotate_receptors(simple(spark, sf_dir), notes, "s_suppkey").annotations.select("imd_chain_id", RECEPTOR, "s_name")


@query("annotate_barcodes", f"WITH {_SIMPLE} SELECT imd_chain_id, c_name FROM simple LEFT JOIN customer ON c_custkey = imd_barcode")
def _(spark, sf_dir):
    notes = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return annotate_barcodes(simple(spark, sf_dir), notes, "c_custkey").annotations.select("imd_chain_id", "c_name")


@query("annotate_chains", f"WITH {_SIMPLE} SELECT imd_chain_id, c_mktsegment FROM simple LEFT JOIN customer ON c_custkey = imd_chain_id")
def _(spark, sf_dir):
    notes = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return annotate_chains(simple(spark, sf_dir), notes, "c_custkey").annotations.select("imd_chain_id", "c_mktsegment")


@query("annotate_multi_match", f"WITH {_SIMPLE} SELECT imd_chain_id, l_orderkey, l_linenumber FROM simple LEFT JOIN lineitem ON l_partkey = p_partkey")
def _(spark, sf_dir):
    notes = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return annotate_data(simple(spark, sf_dir), notes, {"p_partkey": "l_partkey"}).annotations.select("imd_chain_id", "l_orderkey", "l_linenumber")


@query("null_safe_join", "SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return null_safe_join(table(spark, sf_dir, "customer"), nation, ["c_nationkey"]).select("c_custkey", "c_name", "n_name")


@query("count_chains", "SELECT count(*) AS n FROM part")
def _(spark, sf_dir):
    return simple(spark, sf_dir).count()


@query("productive_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O')")
def _(spark, sf_dir):
    return make_productive_filter("o_orderstatus", ("F", "O"))(table(spark, sf_dir, "orders")).select("o_orderkey")


@query("barcode_prefix", "SELECT o_orderkey, concat(o_orderpriority, CAST(o_custkey AS VARCHAR)) AS imd_barcode FROM orders")
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("imd_barcode", F.col("o_custkey"))
    return make_barcode_prefix("o_orderpriority")(orders).select("o_orderkey", "imd_barcode")


def _scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/queries-{uuid4().hex}"


@query("scan_parquet", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, sf_dir):
    return scan_tables(spark, [f"{sf_dir}/orders.parquet"]).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("ingest_repertoires", f"WITH {_SIMPLE}, {_REP.format(src='simple')} SELECT * FROM sizes")
def _(spark, sf_dir):
    idata = read_repertoires(spark, f"{sf_dir}/part.parquet", ["p_name", "p_type"], preprocess={}, postprocess={}, output_folder=_scratch(spark), repertoire_schema="p_brand")
    return idata.repertoires


@query("saved_round_trip", f"WITH {_SIMPLE} SELECT imd_chain_id, imd_receptor_id, p_name, p_type, p_brand FROM simple")
def _(spark, sf_dir):
    folder = _scratch(spark)
    save_dataset(simple(spark, sf_dir), folder)
    return open_dataset(spark, folder).annotations.select("imd_chain_id", RECEPTOR, "p_name", "p_type", "p_brand")


def _written(df: DataFrame, path: str, **options) -> str:
    """``df`` as files of text in the folder ``path``, whose ending tells their kind."""
    sep = "\t" if ".tsv" in path else ","
    df.write.option("header", True).option("sep", sep).options(**options).csv(path)
    return path


@query("scan_csv", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    out = scan_tables(spark, [_written(rows, f"{_scratch(spark)}/customer.csv")])
    return out.select(F.col("c_custkey").cast("long"), "c_name", F.col("c_nationkey").cast(rows.schema["c_nationkey"].dataType), "c_mktsegment")


@query("scan_tsv_gzip", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    out = scan_tables(spark, [_written(rows, f"{_scratch(spark)}/supplier.tsv.gz", compression="gzip")])
    return out.select(F.col("s_suppkey").cast("long"), "s_name", F.col("s_nationkey").cast(rows.schema["s_nationkey"].dataType))


@query("scan_union_by_name", """
SELECT s_nationkey AS nation, s_name AS name, CAST(NULL AS VARCHAR) AS segment FROM supplier
UNION ALL SELECT c_nationkey, c_name, c_mktsegment FROM customer""")
def _(spark, sf_dir):
    folder = _scratch(spark)
    one = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    two = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    _written(one, f"{folder}/suppliers")
    _written(two, f"{folder}/customers")
    paths = resolve_paths(spark, [f"{folder}/suppliers/*.csv", f"{folder}/customers/*.csv"])
    return scan_tables(spark, paths, enforce_schema=False).select(F.col("nation").cast(one.schema["nation"].dataType).alias("nation"), "name", "segment")


@query("scan_filename", "SELECT 'orders.parquet' AS file, count(*) AS n FROM orders UNION ALL SELECT 'part.parquet', count(*) FROM part")
def _(spark, sf_dir):
    scans = [scan_tables(spark, [f"{sf_dir}/{name}.parquet"]).select(F.regexp_extract("filename", "([a-z]+[.]parquet)", 1).alias("file")) for name in ("orders", "part")]
    return scans[0].unionByName(scans[1]).groupBy("file").agg(F.count("*").alias("n"))


def _samples(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Parts as chain tables of two samples with a sheet beside them; the folder and the sheet."""
    folder = _scratch(spark)
    part = table(spark, sf_dir, "part").select(
        F.col("p_name").alias("cdr3"), F.col("p_type").alias("v_call"), F.when(F.col("p_size") % 3 == 0, "F").otherwise("T").alias("productive"),
        F.col("p_partkey").alias("cell"), "p_size", F.lit(1.5).alias("v_score"),
    )
    lines = []
    for name, own in (("large", part.filter("p_size > 25")), ("small", part.filter("p_size <= 25"))):
        _written(own, f"{folder}/{name}")
        lines += [f"{name}/{posixpath.basename(f)}\t{name[0].upper()}\t{name[0].upper()}_\n" for f in expand(spark, f"{folder}/{name}/*.csv")]
    write_text(spark, f"{folder}/sheet.tsv", "File\tSample\tPrefix\n" + "".join(lines))
    return folder, f"{folder}/sheet.tsv"


@query("sample_sheet", "SELECT 'L' AS Sample, 'L_' AS Prefix, 'large' AS folder UNION ALL SELECT 'S', 'S_', 'small'")
def _(spark, sf_dir):
    return read_metadata(spark, _samples(spark, sf_dir)[1]).select("Sample", "Prefix", F.regexp_extract("filename", "([^/]*)/[^/]*$", 1).alias("folder")).distinct()


_SHEETED = """
rows AS (SELECT p_name AS cdr3, p_type AS v_call, p_size, CASE WHEN p_size > 25 THEN 'L' ELSE 'S' END AS Sample,
                CASE WHEN p_size > 25 THEN 'L_' ELSE 'S_' END || CAST(p_partkey AS VARCHAR) AS imd_barcode FROM part WHERE p_size % 3 <> 0)"""


@query("metadata_join", f"WITH {_SHEETED} SELECT cdr3, v_call, p_size, Sample, imd_barcode FROM rows")
def _(spark, sf_dir):
    folder, sheet = _samples(spark, sf_dir)
    idata = read_repertoires(spark, "<metadata>", ["cdr3", "v_call"], metadata=sheet, barcode_col="cell", output_folder=f"{folder}/saved")
    if "v_score" in idata.annotations.columns:
        raise ValueError("a column that default steps drop is still there")
    return idata.annotations.select("cdr3", "v_call", F.col("p_size").cast("long"), "Sample", "imd_barcode")


@query("ingest_saves_repertoires", f"""WITH {_SHEETED}
SELECT row_number() OVER (ORDER BY Sample) AS imd_repertoire_id, Sample, CAST(count(*) AS DOUBLE) AS n_barcodes, count(DISTINCT (cdr3, v_call)) AS n_receptors
FROM rows GROUP BY Sample""")
def _(spark, sf_dir):
    folder, sheet = _samples(spark, sf_dir)
    read_repertoires(spark, f"{folder}/*l*/*.csv", ["cdr3", "v_call"], metadata=sheet, barcode_col="cell", output_folder=f"{folder}/saved", repertoire_schema="Sample")
    return open_dataset(spark, f"{folder}/saved").repertoires


@query("rename_columns", f"WITH {_SHEETED} SELECT cdr3 AS junction, v_call AS gene, count(*) AS n FROM rows GROUP BY ALL")
def _(spark, sf_dir):
    folder, sheet = _samples(spark, sf_dir)
    names = {"junction": "cdr3", "gene": "v_call", "absent": "nowhere"}
    idata = read_repertoires(spark, f"{folder}/*l*/*.csv", ["cdr3", "v_call"], metadata=sheet, rename_columns=names, output_folder=f"{folder}/saved")
    return idata.annotations.groupBy(*idata.schema_receptor.features).agg(F.count("*").alias("n"))


@query("preprocessing_steps", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").alias("productive"), F.lit(1).alias("v_score"))
    for step in make_default_preprocessing().values():
        rows = step(rows, metadata=None)
    return make_exclude_columns(["productive", "absent"])(rows)


@query("not_productive", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("flag", F.when(F.col("o_orderstatus") == "F", "T").otherwise("F"))
    return make_productive_filter(["absent", "flag"], False)(rows).select("o_orderkey")


@query("postprocessing_steps", "SELECT o_orderkey, concat(o_orderstatus, CAST(o_custkey AS VARCHAR)) AS imd_barcode FROM orders")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("imd_barcode", F.col("o_custkey")).withColumn("Prefix", F.col("o_orderstatus"))
    for step in make_default_postprocessing().values():
        rows = step(rows)
    return rows.select("o_orderkey", "imd_barcode")


@query("dataset_methods", f"""WITH {_SIMPLE} SELECT imd_chain_id, p_size + 1 AS more, p_name = (SELECT min(p_name) FROM part) AS imd_sim_exact_1, s_name
FROM simple LEFT JOIN supplier ON s_suppkey = imd_receptor_id WHERE p_size > 10""")
def _(spark, sf_dir):
    least = _patterns(spark, sf_dir)[0]
    notes = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    idata = simple(spark, sf_dir).filter("p_size > 10").mutate(make_seq_options("p_name", [least]), more="p_size + 1")
    return annotate(idata, notes, {RECEPTOR: "s_suppkey"}).annotations.select("imd_chain_id", "more", "imd_sim_exact_1", "s_name")


@query("hash_receptors", "SELECT p_name, p_type, count(*) AS n FROM part GROUP BY ALL")
def _(spark, sf_dir):
    idata = agg_receptors(table(spark, sf_dir, "part"), ["p_name", "p_type"], order_by=["p_partkey"], id_strategy="hash")
    return idata.annotations.groupBy(RECEPTOR).agg(F.min("p_name").alias("p_name"), F.min("p_type").alias("p_type"), F.count("*").alias("n")).drop(RECEPTOR)


@query("list_of_frames", """
WITH rows AS (SELECT CASE WHEN p_size <= 25 THEN 'large' ELSE 'small' END AS repertoire_id, p_name, p_type FROM part WHERE p_size % 3 <> 0)
SELECT row_number() OVER (ORDER BY repertoire_id) AS imd_repertoire_id, repertoire_id, CAST(count(*) AS DOUBLE) AS n_barcodes, count(DISTINCT (p_name, p_type)) AS n_receptors
FROM rows GROUP BY repertoire_id""")
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_name", "p_type", "p_size", F.when(F.col("p_size") % 3 == 0, "F").otherwise("T").alias("productive"))
    data = {"large": part.filter("p_size <= 25"), "small": part.filter("p_size > 25")}
    meta = spark.range(2).select(F.when(F.col("id") == 0, "large").otherwise("small").alias("Sample"))
    return from_frames(spark, {"data": data, "meta": meta}, _scratch(spark), ["p_name", "p_type"]).repertoires


def _refused(f: Callable) -> bool:
    try:
        f()
    except (ValueError, FileNotFoundError, TypeError, KeyError):
        return True
    return False


@query("refusals", """
SELECT unnest(['barcode and count', 'more than two chains', 'missing feature', 'pairing without cells', 'reserved name', 'no such column', 'distance without a limit', 'no patterns',
               'mixed files', 'unknown files', 'no files', 'no metadata', 'bad schema', 'missing repertoire column', 'step that is no function']) AS what, true AS refused""")
def _(spark, sf_dir):
    """What is refused, tried on whole tables."""
    part = table(spark, sf_dir, "part")
    idata = simple(spark, sf_dir)
    three = make_receptor_schema(["p_name"], ["a", "b", "c"])
    files = [f"{sf_dir}/part.parquet", f"{sf_dir}/part.csv"]
    cases = {
        "barcode and count": lambda: agg_receptors(part, "p_name", barcode_col="p_brand", count_col="p_size"),
        "more than two chains": lambda: agg_receptors(part, three, barcode_col="p_brand", locus_col="p_type"),
        "missing feature": lambda: agg_receptors(part, ["p_name", "nowhere"]),
        "pairing without cells": lambda: agg_receptors(part, make_receptor_schema(["p_name"], ["a", "b"]), locus_col="p_type"),
        "reserved name": lambda: mutate_data(idata, imd_receptor_id="p_size"),
        "no such column": lambda: filter_data(idata, seq_options=make_seq_options("nowhere", "x")),
        "distance without a limit": lambda: filter_data(idata, seq_options=make_seq_options("p_name", "x", "lev")),
        "no patterns": lambda: make_seq_options("p_name", []),
        "mixed files": lambda: file_kind(files),
        "unknown files": lambda: file_kind([f"{sf_dir}/part.xml"]),
        "no files": lambda: resolve_paths(spark, f"{sf_dir}/nowhere*.tsv"),
        "no metadata": lambda: read_repertoires(spark, "<metadata>", ["p_name"]),
        "bad schema": lambda: assert_receptor_schema({"nothing": 1}),
        "missing repertoire column": lambda: agg_repertoires(idata, "nowhere"),
        "step that is no function": lambda: read_repertoires(spark, files[0], ["p_name"], preprocess={"x": 1}, output_folder=_scratch(spark)),
    }
    return spark.createDataFrame([(what, _refused(f)) for what, f in cases.items()], "what string, refused boolean")


@query("names", """
SELECT unnest(['receptor', 'barcode', 'chain', 'repertoire', 'chain_count', 'sim_lev', 'annotations', 'metadata', 'version', '10x locus', 'features', 'chains', 'valid', 'invalid', 'preset']) AS what,
       unnest(['imd_receptor_id', 'imd_barcode', 'imd_chain_id', 'imd_repertoire_id', 'imd_n_chains', 'imd_sim_lev_', 'annotations.parquet', 'metadata.json', 'version', 'chain',
               'cdr3,v', 'TRA,TRB', 'true', 'false', 'none']) AS name""")
def _(spark, sf_dir):
    schema = make_receptor_schema(["cdr3", "v"], ["TRA", "TRB"])
    rows = {k: imd_schema(k) for k in ("receptor", "barcode", "chain", "repertoire", "chain_count", "sim_lev")}
    rows |= {k: imd_files()[k] for k in ("annotations", "metadata")} | {"version": imd_meta_schema()["version"], "10x locus": imd_rename_cols("10x")["locus"]}
    rows |= {"features": ",".join(imd_receptor_features(schema)), "chains": ",".join(imd_receptor_chains(schema))}
    rows |= {"valid": str(test_receptor_schema(schema)).lower(), "invalid": str(test_receptor_schema(7)).lower(), "preset": str(imd_repertoire_schema()).lower()}
    return spark.createDataFrame(list(rows.items()), "what string, name string")


@query("described", f"""WITH {_SIMPLE}, {_REP.format(src='simple')}, r AS (SELECT p_brand, CAST(n_barcodes AS DOUBLE) AS b, n_receptors, imd_repertoire_id AS i FROM sizes)
SELECT string_agg(concat_ws(chr(9), i, p_brand, b, n_receptors), chr(10) ORDER BY i) AS text FROM r""")
def _(spark, sf_dir):
    """The table of repertoires as ``describe`` shows it."""
    shown = agg_repertoires(simple(spark, sf_dir), "p_brand").describe(100).split("n_receptors\n")[-1]
    return spark.createDataFrame([(shown,)], "text string")


__all__ = ["ORACLE", "QUERIES"]
