"""The pipeline against a plain version of each stage, and the registered queries on empty tables."""

import base64
import random
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from airrline.llm import decontaminate, queries, secrets

from . import plain
from .test_operators import RANKS, _statistics, tokenizers, words


def _write(spark, folder):
    r = random.Random(8)
    docs, labels = [], []
    items = [(i, words(30, 900 + i) + ". " + words(8, 950 + i)) for i in range(12)]
    for i in range(160):
        text = words(r.randint(5, 120), i)
        if i % 5 == 0:
            text = " ".join(w + "***" for w in text.split())
        if i % 7 == 1:
            text += ' token = "abcdef0123456789abcdef"'
        if i % 11 == 2:
            text += " " + items[i % 12][1]
        docs.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(i % 5 != 0), 0))
    docs += [(200 + i, docs[i + 6][1], "en", "src0", docs[i + 6][4]) for i in range(10)]
    docs += [(300, None, "en", "src0", None), (301, "", "en", "src0", 0), docs[3], (None, words(80, 5000), "en", "src1", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    docs, items = _write(spark, folder)
    got, table = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, folder).write.parquet(f"{folder}/out/{k}")
        table = spark.read.parquet(f"{folder}/out/{k}")
        got[name] = [tuple(r) for r in table.collect()]
        if k < 4:
            assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    quality, near, clean, safe, tokens = got.values()

    failed = {i for i, t, *_ in docs for s in [_statistics(t)] if s[0] < 10 or 100 * s[4] > 20 * s[0]}
    expected = sorted((d for d in docs if d[0] not in failed and "***" not in (d[1] or "")), key=str)
    assert sorted(quality, key=str) == expected

    shingles = {d[1]: plain.text_shingles(d[1] or "") for d in quality}
    groups = defaultdict(list)
    for d in sorted(set(quality), key=lambda d: (d[0] is None, d[0] or 0)):
        same = next((g for g in groups if plain.alignment(shingles[d[1]], {s: j for j, s in enumerate(shingles[g])}, len(shingles[g])) >= 0.8), d[1])
        groups[same].append(d)
    assert sorted(near, key=str) == sorted((g[0] for g in groups.values()), key=str)

    leaks = [d for d in near if any(decontaminate._found(decontaminate.tokens(t), decontaminate.tokens(d[1])) > 0.9 for _, t in items)]
    assert leaks and sorted(clean, key=str) == sorted((d for d in near if d not in leaks), key=str)

    cut = [(d[0], t := secrets.redact(d[1], secrets.scan(d[1])), *d[2:4], len(t) if secrets.scan(d[1]) else d[4]) for d in clean]
    assert sorted(safe, key=str) == sorted(cut, key=str) and any("[assign]" in d[1] for d in cut)

    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path(RANKS), "rb"))}
    exact = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {(i, bytes(x)) for i, _, x in tokens} == {(d[0], np.array(exact.encode_ordinary(d[1]), "<u4").tobytes()) for d in safe}
    assert sorted(map(str, (tuple(r) for r in corpus_pipeline.run(spark, folder).collect()))) == sorted(map(str, tokens))


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    folder = str(tmp_path)
    _write(spark, folder)
    names = ("n_words", "kept", "leaks", "spans", "redacted", "id", "digest", "node", "class", "row", "key", "ids")
    table = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, folder).write.parquet(f"{folder}/out/{k}")
        table = spark.read.parquet(f"{folder}/out/{k}")
        if k < 4:
            assert table.columns[5:] == list(names)
            assert table.filter(" OR ".join(f"{n} <> concat('{n}', doc_id)" for n in names)).isEmpty()


def test_queries_on_empty_tables(spark, tmp_path):
    kinds = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string",
        "pages": "page_id long, url string, html string", "conversations": "conv_id long, turn long, role string, text string",
    }
    for name, kind in kinds.items():
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (name == "op7_chat"), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
