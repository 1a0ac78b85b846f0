"""Line dedup against a plain Python version; incremental changes against an index built anew."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import linededup

SPACE = " \t\n\x0b\x0c\r"
LONG = "The quick brown fox jumps over the lazy dog again"
UNI = "é" * 39


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows, min_docs=5, min_chars=40):
    """[(kept, n_lines, n_dropped)] in the order of ``rows`` = [(doc, text)]."""
    holders = {}
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                k = key_of(line)
                if len(k) >= min_chars:
                    holders.setdefault(k, set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = [doc is not None and len(holders.get(key_of(x), ())) >= min_docs and max(holders[key_of(x)]) != doc
                for x in lines]
        out.append(("\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    pool = [f"shared line number {i} of the pool, long enough to count" for i in range(30)]
    rows = []
    for doc in range(n):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 4))] + [f"own line {doc} " * rng.randint(1, 5)]
        lines = [rng.choice([x, x.upper(), f"  {x}\t", x + "\r"]) for x in lines]
        rng.shuffle(lines)
        rows.append((doc * 7 % 101 + (doc // 101) * 101, "\n".join(lines)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def result(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["kept"], r["n_lines"], r["n_dropped"]) for r in df.collect())


def wanted(rows, *a):
    return sorted((d is None, d or 0, *x) for (d, _), x in zip(rows, brute(rows, *a)))


EDGES = [(1, LONG), (2, LONG.upper()), (3, f" \x0b{LONG}\t"), (4, f"{LONG}\n{LONG}"), (5, f"a\n\n{LONG}\n"),
         (6, None), (7, ""), (8, "\n\n"), (9, f"\xa0{LONG}"), (None, LONG), (None, None)] + [
    (20 + i, f"{UNI}É\n{UNI}") for i in range(6)] + [(30 + i, "x" * 40 + "\n" + "x" * 39) for i in range(5)] + [
    (40, "y" * 200_000 + "\n" + LONG)]


def test_edges(spark):
    df = frame(spark, EDGES)
    assert result(linededup.drop_repeated(linededup.build(df), df)) == wanted(EDGES)


def test_repeated_rows_are_one_document(spark):
    rows = [(1, LONG)] * 6 + [(2, LONG), (3, LONG), (4, LONG)]
    df = frame(spark, rows)
    assert result(linededup.drop_repeated(linededup.build(df), df)) == wanted(rows)


@pytest.mark.parametrize("bound", [linededup.MAX_FILTER_BYTES, 0])
def test_random_corpus_with_and_without_filters_in_tasks(spark, monkeypatch, bound):
    monkeypatch.setattr(linededup, "MAX_FILTER_BYTES", bound)
    monkeypatch.setattr(linededup, "KEYS_PER_SHARD", 5)
    rows = corpus(3, 150)
    df = frame(spark, rows)
    index = linededup.build(df)
    assert index.shards > 1
    assert result(linededup.drop_repeated(index, df)) == wanted(rows)


def state(index):
    counts = {(r["h1"], r["h2"]): (r["n_docs"], r["last_doc"]) for r in index.counts.collect()}
    return {k: v for k, v in counts.items()}


def test_insertions_and_deletions_are_reversible(spark, monkeypatch):
    monkeypatch.setattr(linededup, "KEYS_PER_SHARD", 10)
    rows = corpus(5, 120)
    first, more = rows[:70], rows[70:]
    old = linededup.build(frame(spark, first))
    grown = linededup.insert(old, frame(spark, more))
    everything = linededup.build(frame(spark, rows))
    assert state(grown) == state(everything)
    df = frame(spark, rows)
    assert result(linededup.drop_repeated(grown, df)) == wanted(rows)
    back = linededup.delete(grown, frame(spark, more).select("doc_id"))
    assert state(back) == state(old)
    df = frame(spark, first)
    assert result(linededup.drop_repeated(back, df)) == wanted(first)
    # the filters hold the repeated keys and, but for false positives, no other
    held = {r["shard"]: linededup.CuckooFilter.load(r["cells"]) for r in back.filters.collect()}
    for (h1, h2), (n, _) in state(back).items():
        f = held.get(h1 % back.shards)
        a, b = (np.array([x], np.int64).view(np.uint64) for x in (h1, h2))
        assert n < 5 or f.contains(a, b)[0]
    full = sum(int((f.table > 0).sum()) for f in held.values())
    assert full == sum(n >= 5 for n, _ in state(back).values())


def test_inserting_a_document_again_changes_nothing(spark):
    rows = corpus(6, 40)
    index = linededup.build(frame(spark, rows))
    assert state(linededup.insert(index, frame(spark, rows[:10]))) == state(index)
    assert state(linededup.delete(index, frame(spark, [(999, "x"), (None, "y")]).select("doc_id"))) == state(index)


def test_cuckoo_filter():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, (5000, 2)).astype(np.uint64)
    f = linededup.CuckooFilter.of(keys[:, 0], keys[:, 1])
    assert f.contains(keys[:, 0], keys[:, 1]).all()
    other = rng.integers(0, 2**63, (20_000, 2)).astype(np.uint64)
    assert f.contains(other[:, 0], other[:, 1]).mean() < 0.002
    for a, b in keys[:2500]:
        assert f.delete(a, b)
    assert f.contains(keys[2500:, 0], keys[2500:, 1]).all()
    assert f.contains(keys[:2500, 0], keys[:2500, 1]).mean() < 0.01
    assert linededup.CuckooFilter.load(f.dump()).table.tolist() == f.table.tolist()
    tiny, inserted = linededup.CuckooFilter.sized(1), 0
    while tiny.insert(*keys[inserted]):
        inserted += 1
    assert tiny.contains(keys[:inserted, 0], keys[:inserted, 1]).all()  # a full filter stays as it was


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a\nb", 9, "k")], "doc_id long, text string, n_lines int, kept string")
    got = linededup.drop_repeated(linededup.build(df), df)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped", "kept"]
    assert tuple(got.first()) == (1, "a\nb", 2, 0, "a\nb")
    none = df.limit(0)
    assert linededup.drop_repeated(linededup.build(none), none).count() == 0
    assert linededup.build(none).refs.agg(F.count("*")).first()[0] == 0
