"""The pipeline on a fixture against a plain Python version of its decisions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import langid
from tests.llm.test_decontam import brute as leaked
from tests.llm.test_linededup import brute as line_brute
from tests.llm.test_packing import check, reference_ids
from tests.llm.test_simhash import brute_components, brute_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ITEM = "which of the rivers is the longest one in the whole country we ask. it is the nile river of course"


def corpus(seed=4):
    rng = random.Random(seed)
    words = {"en": "the cat dog house of and there with from that this river".split(),
             "fr": "le chat chien maison de et là avec dans cette rivière une".split()}
    line = "this line is boilerplate that many of the documents share, all alike"
    rows = []
    for d in range(90):
        lang = "en" if d % 3 else "fr"
        w = [rng.choice(words[lang]) + rng.choice(["", "s", "er", "ing", "ed"]) for _ in range(rng.randint(5, 160))]
        text = " ".join(w)
        if d % 4 == 0:
            text += "\n" + line
        if d % 9 == 1:
            text = text + " " + ITEM
        if d % 7 == 2 and rows:
            text = rows[rng.randrange(len(rows))][1]
        if d % 7 == 3 and rows:
            near = (rows[rng.randrange(len(rows))][1] or "").split(" ")
            near[rng.randrange(len(near))] = "changed"
            text = " ".join(near)
        if d % 13 == 5:
            text = [None, "", "12 34 !!", "\n\n", "…"][d // 13 % 5]
        rows.append((d * 2, text, lang if d % 5 else None, f"src{d % 2}", len(text or "")))
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame(corpus(), schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


def brute_stages(rows):
    """Documents after each stage; the language stage by its own rule for what has no letter."""
    import regex

    docs = {r[0]: r for r in rows if regex.search(r"\p{L}", r[1] or "")}
    yield docs
    ids = sorted(docs)
    kept = line_brute([(i, docs[i][1]) for i in ids])
    docs = {i: (i, k if n else docs[i][1], *docs[i][2:4], len(k) if n else docs[i][4]) for i, (k, _, n) in zip(ids, kept)}
    yield docs
    component = brute_components(ids, [brute_fingerprint(docs[i][1], 4) for i in ids], 4)
    docs = {i: r for i, r in docs.items() if component[i] == i}
    yield docs
    yield {i: r for i, r in docs.items() if not leaked(r[1], [(1, ITEM)])}


def test_stages_against_brute_force(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = [docs.count()]
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute_stages(corpus())):
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert docs.columns == COLUMNS, name
        got = {r["doc_id"]: tuple(r) for r in docs.collect()}
        assert got.keys() == want.keys(), name
        for i, r in want.items():
            assert got[i][1] == r[1] and got[i][3:] == r[3:], name
            assert got[i][2] == r[2] if r[2] else got[i][2] in ("en", "fr")
        sizes.append(len(got))
        if name == "line_dedup":
            assert any(want[r[0]][1] != r[1] for r in corpus() if r[0] in want)
    assert sizes[0] > sizes[1] and sizes[1] == sizes[2] > sizes[3] > sizes[4] > 10
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, folder)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert check(pieces.collect(), dict(zip(texts, reference_ids(texts.values()))), 1024) == 0


def test_run_gives_the_last_stage(spark, folder):
    *_, last = brute_stages(corpus())
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == set(last)


def test_null_ids_repeats_and_extra_columns(spark, folder):
    text = "the cat and the dog of the house were there with that river"
    rows = [(None, text, "en", "s", 1, "a"), (3, text, "en", "s", 1, "b"), (3, text, "en", "s", 1, "b"),
            (8, text, None, None, None, "c"), (9, None, "fr", "s", 0, None), (11, "le chat et le chien dans la maison", "fr", "s", 1, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert docs.columns == [*COLUMNS, "kept"]
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["11", "3", "3", "None"]
    assert sorted(r["kept"] for r in docs.collect()) == ["a", "b", "b", "d"]


def test_empty_documents(spark, folder, tmp_path):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert docs.count() == 0
    assert langid.train(empty).languages == ()


def test_clean_documents_stay(spark, folder):
    """Stage by stage, a corpus of documents that differ in every word loses none."""
    rng = np.random.default_rng(1)
    base = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(int(i), " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(40)), "en", "s", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, base.schema).withColumn("text", F.concat("text", F.lit(" the cat and the house")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert docs.count() == 60, name
