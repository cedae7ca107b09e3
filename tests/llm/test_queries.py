"""Registered corpus queries on the smallest tables: against their SQL, and the pipeline against brute force."""

import importlib.util
import itertools
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from webgrain.llm import decontamination, language_id, mixing
from webgrain.llm.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
P = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
spec = importlib.util.spec_from_file_location("corpus_pipeline", Path(__file__).parents[2] / "corpus_pipeline.py")
pipeline = importlib.util.module_from_spec(spec)
spec.loader.exec_module(pipeline)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = QUERIES[name](spark, FOLDER)
    order = sorted(frame.columns)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == order
    want = sorted(repr(tuple(r[names.index(c)] for c in order)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r[c] for c in order)) for r in frame.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"pipeline"}))
def test_query_covers_every_document(spark, name):
    rows = QUERIES[name](spark, FOLDER)
    ids = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    found = [r.doc_id for r in rows.select("doc_id").collect()]
    assert set(found) <= ids if name.startswith("op8") else sorted(found) == sorted(ids)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id")
    right, n = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right / n > 0.98


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "mixing", "token files"]
    kept = docs
    seen = []
    for _, stage in pipeline.STAGES:
        kept = stage(spark, kept, FOLDER)
        rows = kept.collect()
        seen.append(rows)
        kept = spark.createDataFrame(rows, kept.schema)
    recognised, distinct, clean, mixed, tokens = seen
    for rows in seen[:4]:
        assert all(r.asDict().keys() == set(docs.columns) and r.text == text[r.doc_id] for r in rows)
    # 1: only what is not in a known language goes.
    assert {r.doc_id for r in recognised} == {i for i, t in text.items() if language_id.prepared(t or "") is not None}
    # 2: one document of each component.
    sets = {}
    for r in recognised:
        w = re.findall("[^\x20\x09-\x0D]+", r.text.lower())
        sets[r.doc_id] = frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            top[b] = a
    assert sorted(r.doc_id for r in distinct) == sorted({find(i) for i in sets})
    # 3: no test item is left, and nothing else is gone.
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    held = [r.doc_id for r in distinct if any(b in r.text for _, b in bench)]
    gone = {r.doc_id for r in distinct} - {r.doc_id for r in clean}
    assert set(held) <= gone
    for i in gone - set(held):
        items = decontamination.Items.of(bench)
        code = decontamination.coded(items.number, text[i])
        assert any(s[1] / max(len(w), s[3] - s[2]) >= 0.8 for w in items.words for s in [decontamination.align(w, code)])
    # 4: rows as often as the mix takes them.
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(spark.createDataFrame(clean, docs.schema)).collect() if r.size}
    count = {}
    for r in mixed:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {i: n for i, n in taken.items() if n}
    # 5: all of them, one after the other.
    tokens = sorted(tokens, key=lambda r: r.start)
    assert [r.doc_id for r in tokens] == sorted(r.doc_id for r in mixed)
    assert [r.start for r in tokens] == [0, *itertools.accumulate(r.n_tokens for r in tokens)][:-1]
