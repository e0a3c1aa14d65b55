"""Tokens are encoded and decoded in one pass of a task's worker, which keeps no chunks behind it."""

import pyarrow as pa

import corpus_pipeline
from tidepanel.llm import bpe
from tidepanel.llm.queries import tokenizer_files

TEXTS = ["one two  three\n", None, "", "日本 é one two", "one two  three\n"]


def test_tokens_hold_one_worker_a_task(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    out = corpus_pipeline.tokens(spark, docs, "")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    path, pattern = tokenizer_files()
    want = {r["doc_id"]: r["ids"] for r in bpe.encode(docs, path, pattern).collect()}
    got = {r["doc_id"]: (r["ids"], r["n_tokens"], r["round_trip"]) for r in out.collect()}
    assert got == {k: (ids, len(ids), True) for k, ids in want.items()}


def test_steps_are_the_operators_in_turn(spark):
    path, pattern = tokenizer_files()
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(TEXTS)], "doc_id long, text string, IDS string")
    apart = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    both = bpe.steps(docs, bpe.encoding(path, pattern), bpe.decoding(path, pattern))
    assert both.schema == apart.schema
    assert sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))


def test_nothing_is_remembered_behind_a_task():
    path, pattern = tokenizer_files()
    step, _ = bpe.encoding(path, pattern)
    batch = pa.RecordBatch.from_pydict({"text": TEXTS})
    (made,) = step(iter([batch]))
    assert made.column("ids").to_pylist()[0] == made.column("ids").to_pylist()[4] != []
    assert not bpe.tokenizer(path, pattern).index
