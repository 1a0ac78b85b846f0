"""Decontamination: WAND against exhaustive scoring, planted leaks, clean documents."""

import random

import numpy as np
import pytest

from tessera.llm import decontam
from tessera.llm.queries import op6_decontamination


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def items_of(seed, n=40):
    rng = random.Random(seed)
    vocab = vocabulary(rng, 300)
    return vocab, [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(6, 30))) + ". " + rng.choice(vocab) + " yes.")
                   for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_wand_finds_every_item_above_the_threshold(seed):
    rng = random.Random(seed)
    vocab, items = items_of(seed)
    index = decontam.Index(items)
    assert abs(sum(x for i, x in sum(index.postings, []) if i == 0) - 1) < 1e-9
    for _ in range(60):
        words = [w.encode() for w in rng.choices(vocab, k=rng.randint(1, 60))]
        if rng.random() < 0.5:
            words += decontam.terms_of(rng.choice(items)[1])[: rng.randint(1, 40)]
        terms = sorted({index.number[w] for w in words if w in index.number})
        score = np.zeros(len(items))
        for t in terms:
            for i, x in index.postings[t]:
                score[i] += x
        for threshold in (0.1, 0.4, 0.8):
            got = dict(index.search(terms, threshold))
            sure = {i for i in range(len(items)) if score[i] >= threshold + 1e-9}
            assert sure <= got.keys() <= {i for i in range(len(items)) if score[i] >= threshold - 1e-9}
            assert all(abs(got[i] - score[i]) < 1e-9 for i in got)


def brute(text, items, min_overlap=0.8):
    """Items whose five-word shingles the whole text holds; an upper bound of what passages can show."""
    found = decontam.shingles(decontam.terms_of(text))
    out = {}
    for item, t in items:
        own = decontam.shingles(decontam.terms_of(t))
        if own and len(own & found) / len(own) >= min_overlap:
            out[item] = len(own & found) / len(own)
    return out


def frames(spark, docs, items):
    return (spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, score double"),
            spark.createDataFrame(items, "item_id long, text string"))


@pytest.mark.parametrize("part_bytes", [decontam.PART_BYTES, 600])
def test_planted_leaks_and_clean_documents(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(decontam, "PART_BYTES", part_bytes)
    rng = random.Random(8)
    vocab, items = items_of(8)
    filler = vocabulary(rng, 200) + vocab
    docs = []
    for d in range(120):
        w = rng.choices(filler, k=rng.randint(0, 900))
        if d % 3 == 0:
            leak = rng.choice(items)[1]
            at = rng.randint(0, len(w))
            if d % 2:
                leak = leak.upper().replace(" ", ", ")
            w[at:at] = leak.split(" ")
        docs.append((d, rng.choice([" ", "\n"]).join(w)))
    d, i = frames(spark, docs, items)
    got = decontam.find_leaks(d, i)
    assert got.columns == ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"]
    rows = got.collect()
    want = {(d, i) for d, t in docs for i in brute(t, items)}
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    assert len(rows) == len(want) >= 40
    assert all(r["overlap"] >= 0.8 and r["score"] >= 0.5 for r in rows)


def test_near_copies_of_an_item(spark):
    item = " ".join(f"t{i}" for i in range(60)) + ". the end is near"
    w = item.split()
    one = " ".join([*w[:30], "changed", *w[31:]])
    half = " ".join(w[:30])
    d, i = frames(spark, [(1, one), (2, half), (3, item.replace(" ", "\t"))], [(7, item)])
    got = {r["doc_id"]: r for r in decontam.find_leaks(d, i).collect()}
    assert got.keys() == {1, 3} and got[3]["overlap"] == got[3]["answer_overlap"] == 1.0 and 0.8 <= got[1]["overlap"] < 1


def test_question_and_answer():
    assert decontam.question_and_answer("Is it? Yes. No.") == ("Is it? Yes.", "No.")
    assert decontam.question_and_answer("only one") == ("only one", "")
    assert decontam.question_and_answer(None) == ("", "")


def test_nulls_repeats_and_empty_tables(spark):
    long = "one two three four five six seven eight nine ten"
    docs = [(None, long), (4, long), (4, long), (5, None), (6, ""), (7, "one two")]
    d, i = frames(spark, docs, [(1, long), (1, long), (2, None), (3, ""), (None, "!!"), (9, "one two")])
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in decontam.find_leaks(d, i).collect())
    # a repeated item is found for each of its rows
    assert got == sorted([(x, y) for x in (0, 4, 4) for y in (1, 1, 9)] + [(7, 9)])
    assert decontam.find_leaks(d.limit(0), i).count() == 0
    assert decontam.find_leaks(d, i.limit(0)).count() == 0


def test_query_over_the_corpus(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r["doc_id"], r["item_id"]) for r in op6_decontamination(spark, sf).collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == {(d, i) for d, t in docs for i in brute(t, items)} and got


def test_a_common_stem_loses_no_item(spark):
    stem = "which of the following statements best describes the main function of the"
    items = [(i, f"{stem} ra{i} rb{i} rc{i}") for i in range(200)]
    docs = [(i, f"{stem} ra{i}") for i in range(0, 200, 10)]
    d, i = frames(spark, docs, items)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.find_leaks(d, i).collect()}
    assert got.keys() == {(d, i) for d, t in docs for i in brute(t, items)} and len(got) == len(docs)
    assert all(score < 0.5 for score in got.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_least_share_is_a_lower_bound(seed):
    rng = random.Random(seed)
    _, items = items_of(seed)
    index = decontam.Index(items, 0.8)
    plain = decontam.Index(items)
    for i, (_, words) in enumerate(index.items):
        share = {t: x for t, k in plain.number.items() for j, x in plain.postings[k] if j == i}
        for _ in range(30):
            kept = sorted(decontam.shingles(words))
            rng.shuffle(kept)
            kept = kept[: -(-len(kept) * 4 // 5)]
            assert sum(share[t] for t in {t for s in kept for t in s}) >= index.least[i] - 1e-9


def test_index_holds_a_value_per_posting_at_most():
    items = [(i, " ".join(f"w{i}x{j}" for j in range(30)) + " common") for i in range(8_000)]
    index = decontam.Index(items, 0.8)
    n = sum(len(own) for own in index.postings)
    arrays = [a for m in (index.fine,) for a in vars(m).values() if isinstance(a, np.ndarray)]
    assert sum(a.nbytes for a in arrays) < 40 * n  # terms x blocks would be about 2 GB
    words = decontam.terms_of(" ".join(["filler common"] * 9_000 + [items[77][1]]))
    assert decontam.leaks_of(words, index, 0.8).keys() == {77}


def test_one_repeated_text_is_dealt_over_the_parts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PART_BYTES", 600)
    sizes = []
    broadcast = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda rows: sizes.append(len(rows)) or broadcast(rows))
    text = "one two three four five six seven eight nine ten"
    d, i = frames(spark, [(1, text)], [(k, text) for k in range(60)])
    found = decontam.find_leaks(d, i)
    assert len(sizes) > 3 and max(sizes) < 40
    assert sorted(r["item_id"] for r in found.collect()) == list(range(60))


def test_an_item_does_not_depend_on_the_others(spark):
    """Halves that stand 900 words apart are no leak, alone or beside an item of 800 words; a gap of some words is one."""
    item = " ".join(f"t{i}" for i in range(40))
    w = item.split()
    filler = [f"f{i % 300}" for i in range(900)]
    docs = [(1, " ".join([*w[:20], *filler, *w[20:]])), (2, " ".join([*filler, *w[:20], *filler[:30], *w[20:], *filler])), (3, item)]
    others = [(100 + k, " ".join(f"o{k}x{i}" for i in range(n))) for k, n in enumerate((800, 5, 130, 64, 65))]
    for items in ([(7, item)], [(7, item), *others], [*others[:2], (7, item)]):
        d, i = frames(spark, docs, items)
        assert sorted(r["doc_id"] for r in decontam.find_leaks(d, i).collect() if r["item_id"] == 7) == [2, 3]


def test_bounds_in_small_steps(monkeypatch):
    vocab, items = items_of(5)
    rng = random.Random(6)
    texts = [[w.encode() for w in rng.choices(vocab, k=n)] + decontam.terms_of(items[n % 40][1]) for n in (0, 5, 700, 64, 2000)]
    index = decontam.Index(items, 0.8)
    whole = sorted(decontam.leaks_in(texts, index, 0.8))
    assert {(k, n % 40) for k, n in enumerate((0, 5, 700, 64, 2000))} <= {(k, i) for k, i, _ in whole}
    monkeypatch.setattr(decontam, "SLICE_MAXIMA", 10)
    assert sorted(decontam.leaks_in(texts, index, 0.8)) == whole


def test_a_very_long_document_and_a_very_long_item(spark):
    item = " ".join(f"w{i}" for i in range(3000))
    docs = [(1, " ".join(["filler words here"] * 200_000 + [item] + ["more"] * 50_000)), (2, "w1 w2 w3 w4 w5 w6")]
    d, i = frames(spark, docs, [(1, item), (2, "w1 w2 w3 w4 w5 w6")])
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.find_leaks(d, i).collect()) == [(1, 1), (1, 2), (2, 2)]


def test_question_and_answer_are_verified(spark):
    question = " ".join(f"word{i}" for i in range(40)) + "?"
    items = [(1, question + " the right answer"), (2, "only " + question)]
    texts = {
        1: f"before {question} the right answer after",
        2: f"before {question} some wrong reply after",
        3: f"before {question}",
        4: f"before {question} the right reply after",
        5: f"the right answer {question}",
        6: " ".join(f"word{i}" for i in range(20)) + " the right answer",
    }
    d, i = frames(spark, list(texts.items()), items)
    found = lambda **given: {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(d, i, **given).collect()}
    # item 2 is one sentence: its overlap decides alone; 4 holds two of three answer words
    every = {(doc, 2) for doc in (1, 2, 3, 4, 5)}
    assert found() == every | {(1, 1), (4, 1), (5, 1)}
    assert found(min_part=0.9) == every | {(1, 1), (5, 1)}
    assert found(min_part=0.0) == every | {(doc, 1) for doc in (1, 2, 3, 4, 5)}
