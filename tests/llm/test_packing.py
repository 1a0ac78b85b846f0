"""Packing: ids equal those of the tokenizers library, pieces tile documents and sequences."""

import zlib

import numpy as np
import pytest

from tessera.llm import packing

TEXTS = ["", None, "Hello  world\n\n\tfoo", "<|endoftext|> and <|startoftext|>", "naïve café ß Ünïcödé 你好 🙂🙂", "a" * 5000,
         "  x​ y\r\n", " " * 3000, "1234567890 " * 700, "don't we'll I'M\x00\x1f", "x́" * 40]


def reference_ids(texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))  # as it comes: <|endoftext|> in a text is its id
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, wanted, capacity):
    """Every id in exactly one piece with the right checksum; sequences gapless from 0; returns the padding."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    assert docs.keys() == wanted.keys()
    for doc, ids in wanted.items():
        at = 0
        for r in sorted(docs[doc], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(part), len(ids))
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@pytest.mark.parametrize("partitions", [1, 3])
def test_pieces_tile_documents_and_sequences(spark, partitions):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").repartition(partitions)
    got = packing.pack_documents(docs)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    padding = check(got.collect(), dict(enumerate(reference_ids(TEXTS))), 1024)
    assert padding == 0


def test_corpus_sample_has_the_library_s_ids(spark):
    from tests.conftest import SMOKE_DIR

    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    wanted = dict(zip([r["doc_id"] for r in rows], reference_ids([r["text"] for r in rows])))
    assert check(packing.pack_documents(docs).collect(), wanted, 1024) == 0


def test_ids_do_not_change_when_a_task_runs_again(spark):
    from tests.conftest import SMOKE_DIR

    docs = spark.read.parquet(f"{SMOKE_DIR}/documents.parquet")
    once, again = (sorted(packing.pack_documents(docs).collect()) for _ in range(2))
    assert once == again


def test_empty_table_null_ids_and_repeats(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "x"), (3, "x")], "doc_id long, text string")
    got = packing.pack_documents(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got if r["start"] == 0) == [(False, 3), (False, 3), (True, 0)]
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_harmonic_classes_hold_a_fixed_count():
    bins = packing.Harmonic(100)
    lengths = [34, 40, 50, 51, 33, 30, 26, 100, 45, 28, 27, 1, 60]
    placed = [x for i, n in enumerate(lengths) for x in bins.add(n, i)]
    full = {}
    for i, b, _ in placed:
        full.setdefault(b, []).append(i)
    assert all(len({100 // lengths[i] for i in ids}) == 1 and len(ids) == 100 // lengths[ids[0]] for ids in full.values())
    placed += bins.close()
    assert sorted(i for i, _, _ in placed) == list(range(len(lengths)))
    with pytest.raises(ValueError):
        bins.add(0, None)


@pytest.mark.parametrize("n", [1, 5, 1023, 1024, 1025, 4096, 5001])
def test_cuts(n):
    parts = list(packing.cuts(n, 1024))
    assert sum(x for _, x in parts) == n and [s for s, _ in parts] == list(np.cumsum([0] + [x for _, x in parts])[:-1])
    assert all(x & (x - 1) == 0 for _, x in parts)


def test_a_million_spaces(spark):
    """Longer runs of white space than the fast matcher takes, among other documents."""
    texts = ["a" + " " * 1_000_000 + "b", "short", " \n" * 400_000, "x<|endoftext|>" + " " * 1_000_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert check(packing.pack_documents(docs).collect(), dict(enumerate(reference_ids(texts))), 1024) == 0
