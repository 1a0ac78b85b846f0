"""Language ID: the forward pass against all segmentations, held-out accuracy, edge cases."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid
from tessera.llm.queries import op3_language_id

NAMES = sorted(["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab", "c"])


def tables(seed=1, languages=2):
    rng = np.random.default_rng(seed)
    probs = rng.random((len(NAMES) + 2, languages)) / 20
    probs[-1] = 0
    return langid.Pieces(NAMES), probs


def brute(word, probs, g):
    """Sum over every way to cut the marked word into pieces or unknown letters."""
    def total(rest):
        if not rest:
            return 1.0
        out = 0.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in NAMES:
                out += probs[NAMES.index(rest[:n]), g] * total(rest[n:])
            elif n == 1:
                out += probs[len(NAMES), g] * total(rest[1:])
        return out
    return total(langid.START + word)


WORDS = ["a", "ab", "abab", "babab", "xab", "ba" * 6, "xyz", "cab", "a"]


def test_forward_sums_all_segmentations():
    pieces, probs = tables()
    got = langid.log_likelihood(WORDS, pieces, probs)
    want = [[math.log(brute(w, probs, g)) for g in range(2)] for w in WORDS]
    assert np.allclose(got, want)


def test_long_words_do_not_underflow():
    pieces, probs = tables()
    once = langid.log_likelihood(["abx" * 160], pieces, probs)
    assert np.isfinite(once).all()
    # the matrix of one step taken to a power, in logarithms: growth per period is constant
    a, b, c = (langid.log_likelihood(["abx" * n], pieces, probs)[0] for n in (100, 120, 140))
    assert np.allclose(b - a, c - b)


def test_expected_counts_against_enumeration():
    pieces, probs = tables(4, 1)

    def cuts(rest):
        if not rest:
            yield ()
        for n in range(1, len(rest) + 1):
            if rest[:n] in NAMES or n == 1:
                number = NAMES.index(rest[:n]) if rest[:n] in NAMES else len(NAMES)
                for more in cuts(rest[n:]):
                    yield (number, *more)

    want = np.zeros(len(NAMES) + 2)
    for word, weight in zip(WORDS, range(1, 20)):
        every = [(c, math.prod(probs[i, 0] for i in c)) for c in cuts(langid.START + word)]
        z = sum(p for _, p in every)
        for c, p in every:
            for i in c:
                want[i] += weight * p / z
    got = langid.expected_counts(WORDS, np.arange(1.0, len(WORDS) + 1), pieces, probs[:, 0])
    assert np.allclose(got, want)


def test_long_words_are_summed_and_counted_whole(monkeypatch):
    """Words beyond ALONE, in one or several chunks, give what the passes over equal lengths give."""
    pieces, probs = tables(6, 2)
    words = ["abx" * 50, "babc" * 33, "cab", "x" * 97]
    whole = langid.log_likelihood(words, pieces, probs)
    counts = langid.expected_counts(words, np.array([1.0, 2.0, 3.0, 1.5]), pieces, probs[:, 0])
    for chunk in (7, 64, 1 << 16):
        monkeypatch.setattr(langid, "ALONE", 20)
        monkeypatch.setattr(langid, "CHUNK", chunk)
        assert np.allclose(langid.log_likelihood(words, pieces, probs), whole)
        assert np.allclose(langid.expected_counts(words, np.array([1.0, 2.0, 3.0, 1.5]), pieces, probs[:, 0]), counts)


def test_rare_letters_neither_underflow_nor_are_left_out():
    pieces, probs = tables(7, 1)
    probs[-2] = 1e-12
    for word in ("".join(map(chr, range(0x3B1, 0x3B1 + 60))), "ж" * 500, "ж" * 3000):
        assert np.isfinite(langid.log_likelihood([word], pieces, probs)).all()
        counts = langid.expected_counts([word], np.ones(1), pieces, probs[:, 0])
        assert np.isclose(counts[len(NAMES)], len(word))


def test_one_strange_document_leaves_the_model_alone(spark):
    """60 different Greek letters in a row, and 3,000 letters without a space, in one training document."""
    strange = "".join(chr(c) for c in range(0x370, 0x400) if chr(c).isalpha() and chr(c).lower() == chr(c))[:60]
    rows = [(i, "the house and the garden with that tree are here", "en") for i in range(90)]
    rows += [(100 + i, "la maison et le jardin avec cet arbre sont ici", "fr") for i in range(90)]
    rows += [(300, strange, "en"), (301, "наш" * 1000, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert np.isfinite(model.probs).all()
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 for i, _, lang in rows[:180])


def test_held_out_accuracy_and_columns(spark):
    got = op3_language_id(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == set(truth) and len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    own = [r for r in rows if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in own) / len(own) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def sample(spark):
    return spark.createDataFrame(
        [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog were there", "en"),
                                               ("le chat et le chien étaient là", "fr")] * 4)],
        "doc_id long, text string, lang string")


def test_edge_cases(spark):
    model = langid.train(sample(spark))
    assert model.languages == ("en", "fr")
    texts = [None, "", "123 !? _", "the dog", "THE DOG", "le chien", "汉字", "the" * 4000, "et le " * 30_000]
    docs = spark.createDataFrame([(i if i else None, t, 5, "zz") for i, t in enumerate(texts)],
                                 "doc_id long, text string, score int, lang string")
    got = langid.identify(docs, model, carry=("doc_id", "lang", "score"))
    assert got.columns == ["doc_id", "lang", "lang_pred", "score"]
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert by[None] == by[1] == by[2] == ("und", 0.0)
    assert [by[i][0] for i in (3, 4, 5, 7, 8)] == ["en", "en", "fr", "en", "fr"]
    assert by[3] == by[4] and by[6][0] in model.languages
    assert langid.identify(docs.limit(0), model).count() == 0


def test_slices_and_forgetting_change_nothing(spark, monkeypatch):
    docs = sample(spark).unionByName(sample(spark).withColumn("text", F.repeat(F.concat("text", F.lit(" ")), 50)))
    model = langid.train(sample(spark))
    once = sorted(tuple(r) for r in langid.identify(docs, model).collect())
    whole = list(langid.words_of("ab cd-ef g" * 10))
    monkeypatch.setattr(langid, "SLICE_CHARS", 10)
    monkeypatch.setattr(langid, "SLICE_WORDS", 3)
    assert [w for part in langid.words_of("ab cd-ef g" * 10) for w in part] == whole[0]
    assert once == sorted(tuple(r) for r in langid.identify(docs, model).collect())


def test_without_labels(spark):
    model = langid.train(sample(spark).withColumn("lang", F.lit(None).cast("string")))
    assert model.languages == ()
    assert {tuple(r)[1:] for r in langid.identify(sample(spark), model).collect()} == {("und", 0.0)}


@pytest.mark.parametrize("partitions", [1, 5])
def test_training_rows_do_not_depend_on_partitions(spark, partitions):
    docs = sample(spark).repartition(partitions)
    model = langid.train(docs, docs_per_language=2)
    assert np.allclose(model.probs, langid.train(sample(spark), docs_per_language=2).probs)
