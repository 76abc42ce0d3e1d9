"""The pipeline's stages on the smallest tables, each on what the one before kept."""

from collections import Counter

import pytest

import corpus_pipeline
from tidewatch.llm import packing
from tidewatch.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    """What goes into each stage and what the last gives, by name."""
    now = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": now}
    for name, stage in corpus_pipeline.STAGES:
        now = out[name] = materialize(stage(spark, now, SF), "test")
    return out


def test_stages(spark, staged):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    tables = list(staged.items())
    for (_, before), (name, after) in zip(tables, tables[1:]):
        if name != "packing":
            assert after.columns == staged["documents"].columns
        a, b = {r.doc_id for r in before.collect()}, {r.doc_id for r in after.collect()}
        assert b <= a
        if name == "quality":
            good = {i for i in a if labels.get(i) == 1}
            assert len(good - b) <= 0.02 * len(good) and sum(labels.get(i) == 0 for i in b) <= 2
        if name in ("lines", "packing"):
            assert a == b
        if name == "mixing":
            # each copy is a whole document that came in
            assert {(r.doc_id, r.text) for r in after.collect()} <= {(r.doc_id, r.text) for r in before.collect()}
    sums, ids = Counter(), Counter()
    for p in staged["packing"].collect():
        sums[p.sequence_id] += p.length
        ids[p.doc_id] += p.length
    assert max(sums.values()) <= 2048
    # all tokens of every copy are there, once
    encoder, want = packing.WordEncoder(packing.default_tokenizer()), Counter()
    for r in staged["mixing"].collect():
        want[r.doc_id] += len(encoder.encode([(r.text or "").encode()])[0]) + 1
    assert ids == want


def test_run_equals_the_stages(spark, staged):
    """``run`` gives every token of every copy that the stages give; the cuts are as tasks come."""
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def tokens(rows):
        held = Counter()
        for r in rows.collect():
            held[r.doc_id, r.doc_tokens] += r.length
        return held

    assert tokens(out) == tokens(staged["packing"])


def test_mixing_and_packing_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    odd = spark.createDataFrame([(None, None), (9001, None), (9002, ""), (9003, "again and again"), (9003, "again and again"), (9004, "word " * 300_000)], docs.schema)
    rows = materialize(docs.unionByName(odd).selectExpr("doc_id", "text", "'own' AS mine"), "test")
    mixed = materialize(corpus_pipeline.mixing(spark, rows, SF), "test")
    assert mixed.columns == ["doc_id", "text", "mine"] and mixed.where("mine != 'own'").count() == 0
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in rows.collect()}
    pieces = corpus_pipeline.pack(spark, rows, SF).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in rows.collect()}
    per = Counter()
    for p in pieces:
        per[p.doc_id] += p.length
    assert per[None] == per[9001] == per[9002] == 1 and per[9003] == 2 * next(p.doc_tokens for p in pieces if p.doc_id == 9003) and per[9004] == 300_001


def test_other_columns_empty_and_odd_rows(spark):
    """Stages keep the columns they get; nulls, repeats and empty tables pass."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    odd = spark.createDataFrame([(None, None), (9001, None), (9002, ""), (9003, "again and again"), (9003, "again and again")], docs.schema)
    rows = docs.unionByName(odd).selectExpr("doc_id", "text", "'own' AS mine", "'own' AS x")
    for name, stage in corpus_pipeline.STAGES[:3]:
        rows = materialize(stage(spark, rows, SF), "test")
        assert rows.columns == ["doc_id", "text", "mine", "x"] and rows.where("mine = 'own' and x = 'own'").count() == rows.count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
