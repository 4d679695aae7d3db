"""The corpus pipeline, stage by stage, against brute force."""

import importlib
import sys

import duckdb
import public_tokenizers
import pytest
import tiktoken
from test_joins import near
from test_pii import base_spans
from test_scans import contaminated

import corpus_pipeline
from pagewright.llm import byte_bpe, toxicity

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [("documents", docs.toPandas())]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        rows = docs.toPandas()
        out.append((name, rows))
        docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_schema(stages):
    assert [n for n, _ in stages[1:]] == [n for n, _ in corpus_pipeline.STAGES] and len(stages) == 6
    for _, rows in stages[:-1]:
        assert list(rows.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
        assert (rows.n_chars == rows.text.str.len()).all()


def test_toxicity_stage(spark, stages):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))).toPandas()
    assert set(stages[1][1].doc_id) == set(scored.doc_id[scored.predicted == 0])


def test_near_duplicate_stage(stages):
    before, after = stages[1][1], stages[2][1]
    assert set(after.doc_id) == {c for _, _, c in near(list(zip(before.doc_id, before.text)))}


def test_decontamination_stage(stages):
    items = duckdb.sql(f"SELECT * FROM '{SMALL}/benchmark.parquet'").fetchall()
    before, after = stages[2][1], stages[3][1]
    bad = {r[0] for r in contaminated(list(zip(before.doc_id, before.text)), items) if r[5]}
    new = dict(zip(after.doc_id, after.text))
    assert bad and all(new[d] == t for d, t in zip(before.doc_id, before.text) if d not in bad)
    assert not any(r[5] for r in contaminated(list(new.items()), items))
    assert all(len(new.get(d, "")) < len(t) for d, t in zip(before.doc_id, before.text) if d in bad)


def test_personal_data_stage(stages):
    before, after = stages[3][1], stages[4][1]
    new = dict(zip(after.doc_id, after.text))
    assert set(new) == set(before.doc_id)
    for d, t in zip(before.doc_id, before.text):
        assert not base_spans(new[d]) and (base_spans(t) or new[d] == t or "[" in new[d])


def test_token_stage(stages):
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = dict(zip(stages[4][1].doc_id, stages[4][1].text))
    rows = stages[5][1]
    assert set(rows.doc_id) == set(texts)
    for d, n, ids, text in zip(rows.doc_id, rows.n_tokens, rows.token_ids, rows.text):
        assert text == texts[d] and list(ids) == coder.encode_ordinary(text) and n == len(ids)


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SMALL).count() == len(stages[5][1])


def test_entry_without_these_operators(monkeypatch):
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "pagewright.llm.queries", None)
    monkeypatch.delattr("pagewright.llm.queries", raising=False)
    importlib.reload(__spark_entry__)
    assert not [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
    assert len([n for n in __spark_entry__.queries() if n.startswith("op")]) == 10
