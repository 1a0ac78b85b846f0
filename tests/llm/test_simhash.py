"""SimHash near-dedup against a brute-force version: every shingle hashed, every pair compared."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash

SPACE = " \t\n\x0b\x0c\r"


def brute_fingerprint(text, shingle):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, max_bits):
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, x in zip(ids, fps):
        for b, y in zip(ids, fps):
            if a < b and (x ^ y).bit_count() <= max_bits:
                ra, rb = root(a), root(b)
                label[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


TEXTS = [None, "", " \t\n", "One", "one", "One two  three", "one two three four", "A b c d e f g h", "a B c D e\x0bf g h",
         "élan ÉLAN Ünder", "x " * 300, "y z w v u t", "a b c d e f g i", "word " * 3 + "end"]


@pytest.mark.parametrize("shingle", [1, 4])
def test_fingerprint(shingle):
    for text in TEXTS:
        assert simhash.fingerprint(text, shingle) == brute_fingerprint(text, shingle), text


def test_long_text_is_hashed_whole():
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(140_000))
    words = text.split()
    hashes = np.array([xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest()
                       for i in range(len(words) - 3)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))
    assert simhash.fingerprint(text, 4) == want


def noisy(rng, n, groups, flips):
    base = [rng.getrandbits(64) for _ in range(groups)]
    out = set()
    while len(out) < n:
        x = rng.choice(base) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("seed,max_bits", [(1, 4), (2, 4), (3, 3), (4, 6), (5, 0)])
def test_links_of_random_fingerprints(spark, seed, max_bits, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_ROWS", 16)  # several levels of nodes and guests
    rng = random.Random(seed)
    fps = noisy(rng, 500, 12, 7)
    reps = spark.createDataFrame([(int(np.uint64(x).view(np.int64)), i) for i, x in enumerate(fps)], "fp long, rep long")
    links = simhash._links(reps, max_bits)
    got = {r["node"]: r["component"] for r in simhash.components(links).collect()}
    want = brute_components(range(len(fps)), fps, max_bits)
    assert {i: got.get(i, i) for i in want} == want


def test_small_frontier_and_leaves(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 7)
    monkeypatch.setattr(simhash, "LEAF_PAIRS", 1)
    rng = random.Random(9)
    fps = np.array(noisy(rng, 300, 5, 6), np.uint64)
    labels = simhash.walk(fps, np.zeros(0, np.uint64), 0, 0, 4)
    assert {i: int(x) for i, x in enumerate(labels)} == brute_components(range(300), [int(x) for x in fps], 4)


def test_query_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    texts = list(TEXTS)
    for _ in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    rows = [(i * 3 + 1, t, None, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, rep int")
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    got = {r["doc_id"]: r for r in got.collect()}
    fps = [brute_fingerprint(t, 4) for t in texts]
    want = brute_components([r[0] for r in rows], fps, 4)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert [got[r[0]]["fingerprint"] for r in rows] == [f"{x:016x}" for x in fps]


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (None, "q r s t u v"),
                                  (2, None), (9, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()),
                 key=lambda x: (x[0] is None, x[0] or 0, x[1] or 0))
    assert got == [(2, 2), (7, 7), (7, 7), (9, 2), (None, None), (None, 7)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = np.random.default_rng(3)
    weak = rng.choice(64, 14, replace=False)
    base = int(rng.integers(1, 1 << 62))
    fps = set()
    for x in rng.integers(0, 1 << 14, 6000):
        fps.add(base ^ sum(1 << int(w) for i, w in enumerate(weak) if x >> i & 1))
    fps = sorted(fps)
    reps = spark.createDataFrame([(int(np.uint64(x).view(np.int64)), i) for i, x in enumerate(fps)], "fp long, rep long")
    got = simhash.components(simhash._links(reps, 4))
    assert got.count() == len(fps) and got.select("component").distinct().count() == 1
    assert got.agg(F.max("component")).first()[0] == 0
