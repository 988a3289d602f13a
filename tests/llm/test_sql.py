"""Queries over a whole small set of tables, held against DuckDB: the registered equivalents, and the base columns of others."""

import os

import duckdb
import pytest

from airrline.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS five FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
told AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM told"""

SCORES = rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i)) AS t),
ids AS (SELECT doc_id, list_transform(regexp_extract_all(hex(CAST(doc_id AS VARCHAR)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
held AS (SELECT doc_id, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295)) % 7 = 2 AS held_out FROM ids, crc),
tokens AS (
  SELECT doc_id, unnest(list_append({WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, '')) AS w FROM documents),
counts AS (SELECT w, count(*) AS c FROM tokens JOIN held USING (doc_id) WHERE NOT held_out GROUP BY w),
total AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM counts)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) AS base_score
FROM tokens JOIN held USING (doc_id) LEFT JOIN counts USING (w), total GROUP BY doc_id"""


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    return con


def _rows(result):
    names = [d[0] for d in result.description]
    return names, result.fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_registered_equivalents(spark, db, name):
    got = queries.QUERIES[name](spark, DATA)
    names, want = _rows(db.execute(queries.ORACLE[name]))
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize(("name", "sql"), [("op4_quality", QUALITY), ("op3_ppm", SCORES)])
def test_base_columns(spark, db, name, sql):
    names, want = _rows(db.execute(sql))
    got = {r.doc_id: tuple(r[n] for n in names) for r in queries.QUERIES[name](spark, DATA).collect()}
    assert len(got) == len(want) > 100
    for row in want:
        assert got[row[names.index("doc_id")]] == pytest.approx(row)
