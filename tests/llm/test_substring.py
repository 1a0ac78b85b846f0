"""Substring dedup against a plain Python version, by query and by factor."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import substring
from tessera.llm.queries import op5_substring_dedup


def words_of(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [w for w in (text or "").split(" ") if w]


def brute(rows, window=20):
    """doc -> (words, kept words); ``rows`` are (doc, text) without repeats."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        w = words_of(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        out[doc] = (w, [x for x, g in zip(w, gone) if not g])
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(50)] + ["a", "b", "É", "ß"]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(15, 45))] for _ in range(6)]
    rows = []
    for doc in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, 5)
            w += p[a : len(p) - rng.randint(0, 5)] + [rng.choice(vocab) for _ in range(rng.randint(0, 25))]
        if rng.random() < 0.2 and rows:
            w = words_of(rng.choice(rows)[1])
            if w and rng.random() < 0.5:
                w[rng.randrange(len(w))] = "x"
        if rng.random() < 0.1:
            w += ["p", "q"] * rng.randint(8, 30)
        rows.append((doc * 3, rng.choice([" ", "\n", "  ", "\t "]).join(w)))
    return rows


def check(spark, rows, window=20):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring.parse(docs, window=window).collect()}
    want = brute(rows, window)
    assert got.keys() == want.keys()
    texts = {d: words_of(t) for d, t in rows}
    for doc, (w, kept) in want.items():
        r = got[doc]
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(w), len(w) - len(kept), " ".join(kept)), doc
        for f in r["factors"]:
            assert f["length"] >= window and (f["ref_doc"], f["ref_start"]) < (doc, f["start"])
            assert w[f["start"] : f["start"] + f["length"]] == texts[f["ref_doc"]][f["ref_start"] :][: f["length"]]


@pytest.mark.parametrize("seed,window", [(1, 20), (2, 20), (3, 8), (4, 6)])
def test_random_corpora(spark, seed, window):
    check(spark, corpus(seed), window)


def test_small_blocks_and_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT_PLACES", 3)
    monkeypatch.setattr(substring, "BLOCK_ROWS", 5)
    check(spark, corpus(7))


def test_slices_inside_long_texts(spark, monkeypatch):
    rows = corpus(8) + [(1000, " ".join(["long"] * 500)), (1001, "x" * 5000 + " " + "y z " * 400)]
    monkeypatch.setattr(substring, "SLICE", 64)
    check(spark, rows)


def test_word_hashes_follow_the_words():
    h = substring.Hasher()
    a = h.words("one  two\tthree one \x0b two")
    assert len(a) == 5 and a[0] == a[3] and a[1] == a[4] and len(set(a.tolist())) == 3
    assert np.array_equal(a, h.words("one two three one two")) and len(h.words(" \n ")) == len(h.words(None)) == 0
    assert len(set(h.words("a aa aaa b ba ab").tolist())) == 6


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = op5_substring_dedup(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = {d: (len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest())
            for d, (w, k) in brute([tuple(r) for r in rows]).items()}
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want


def test_nulls_repeats_extra_columns_and_empty(spark):
    text = " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(5, text, 1), (5, text, 2), (None, text, 3), (9, f"z {text}", 4), (2, None, 5), (3, "", 6)],
                                 "doc_id int, text string, n_words int")
    got = substring.parse(docs)
    assert got.schema["doc_id"].dataType.simpleString() == "int"
    rows = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got.collect())
    assert rows == [(False, 2, 0, 0), (False, 3, 0, 0), (False, 5, 30, 0), (False, 5, 30, 0), (False, 9, 31, 30), (True, 0, 30, 0)]
    assert substring.parse(docs.limit(0)).count() == 0


def test_places_inside_a_document_make_an_anchor_hot(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT_PLACES", 50)
    held = []
    solved = substring._solved_hot
    monkeypatch.setattr(substring, "_solved_hot", lambda places: held.append(places.count()) or solved(places))
    rows = [(d, "x " * 40 + f"only{d}") for d in range(6)]  # 6 documents: 12 places if counted up to 2 in each
    check(spark, rows)
    assert held and held[0] > 100
