"""Retrieval returns k chunks for every question; dense top-k equals brute force in any block size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval as rv

CHUNKS = [(1, 0, "alpha beta gamma"), (1, 1, "beta beta delta"), (2, 0, "gamma delta"), (3, 0, ""), (3, 1, None)]


def _ranked(spark, questions, k=3):
    ch = spark.createDataFrame(CHUNKS, "doc_id long, chunk_id int, chunk string")
    q = spark.createDataFrame(questions, "item_id long, text string")
    idf, post = rv.tfidf_fit(ch, ["doc_id", "chunk_id"], "chunk")
    scores = rv.sparse_scores(rv.tfidf_transform(q, idf, ["item_id"]), post, ["item_id"], ["doc_id", "chunk_id"])
    every = rv.with_unmatched(scores, q, ch, ["item_id"], ["doc_id", "chunk_id"], k)
    return rv.top_k(every, ["item_id"], ["doc_id", "chunk_id"], k), ch, q


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_every_question_gets_k_chunks(spark, k):
    top, _, _ = _ranked(spark, [(1, "alpha"), (2, "unseen words"), (3, None), (4, "delta beta"), (5, "")], k)
    got = {}
    for r in top.orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append((r["doc_id"], r["chunk_id"], r["score"]))
    assert {i: len(rows) for i, rows in got.items()} == dict.fromkeys(range(1, 6), k)
    assert got[1][0][:2] == (1, 0) and got[1][0][2] > 0
    assert [x[:2] for x in got[2]] == [c[:2] for c in CHUNKS][:k] and all(x[2] == 0 for x in got[2])
    if k > 1:
        assert [x[2] > 0 for x in got[1]] == [True] + [False] * (k - 1)


def test_answers_and_sources(spark):
    top, ch, q = _ranked(spark, [(1, "alpha"), (2, "unseen")])
    got = {r["item_id"]: r for r in rv.answers(top, ch, q, "item_id", ["doc_id", "chunk_id"]).collect()}
    assert got[2]["answer"] == rv.EXTRACTIVE_PREFIX + "0.000)\nalpha beta gamma" and got[2]["n_sources"] == 3
    texts = rv.sources(top, ch, ["doc_id", "chunk_id"]).where("item_id = 1 AND rank = 1").select("chunk").collect()
    assert [r[0] for r in texts] == ["alpha beta gamma"]


def test_empty_index(spark):
    ch = spark.createDataFrame([], "doc_id long, chunk_id int, chunk string")
    scores = spark.createDataFrame([], "item_id long, doc_id long, chunk_id int, score double")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rv.with_unmatched(scores, q, ch, ["item_id"], ["doc_id", "chunk_id"], 3).count() == 0


@pytest.mark.parametrize("block", [2, 4096])
def test_dense_topk(spark, block):
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (60, 5)).astype(float)
    q = rng.integers(-3, 4, (7, 5)).astype(float)
    x[5] = 0
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vid long, v array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid int, w array<double>")
    got = rv.dense_topk(vectors.repartition(3), queries, "vid", "v", "qid", "w", 4, block)
    score = np.round((q @ x.T) / (np.linalg.norm(q, axis=1) + 1e-10)[:, None] / (np.linalg.norm(x, axis=1) + 1e-10), 9)
    want = {(i, r + 1): int(j) for i in range(7) for r, j in enumerate(np.lexsort((np.arange(60), -score[i]))[:4])}
    assert {(r["qid"], r["rank"]): r["vid"] for r in got.collect()} == want
    assert dict(got.dtypes)["qid"] == "int"
    assert rv.dense_topk(vectors, queries.limit(0), "vid", "v", "qid", "w").count() == 0
    assert rv.dense_topk(vectors.where(F.lit(False)), queries, "vid", "v", "qid", "w").count() == 0


def test_index_of_one_file_is_built_by_many_tasks(spark, tmp_path):
    """All texts in one row group: chunks are still written by several tasks of about the same size."""
    from tessera.plans import textq
    from tessera.sources.tables import Tables

    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(40))) for i in range(400)] + [(None, "one two"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    ch, idf, index = textq._fit(Tables(spark, str(tmp_path)))
    sizes = ch.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert max(sizes) < 200 and sum(sizes) == 402
    index.drop(spark)
