"""Quantiles by brackets against sorted values, also where sketches are poor."""

import random

import numpy as np
import pytest

from tessera.operators import profile as pf

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


def _exact(values):
    return [float(np.quantile(np.array(values), p)) if values else None for p in PROBS]


def _rows(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = rng.choice(["a", "a", "a", "b", None, "c' \\"])
        out.append((g, rng.choice([None, float(rng.randint(0, 5))]), rng.gauss(0, 100), None if g == "b" else rng.randint(-9, 10**6)))
    return out + [("one", 1.5, 2.5, 7), ("nulls", None, None, None), ("two", 1.0, 3.0, None), ("two", 2.0, -3.0, 1)]


@pytest.mark.parametrize("sketch,keep,rows", [(8000, 1_000_000, 3000), (8, 1_000_000, 3000), (8, 20, 3000), (200, 5, 40)])
def test_brackets_are_exact(spark, monkeypatch, sketch, keep, rows):
    """A sketch of 8 misses most ranks; a bracket of more than 20 values is drawn again."""
    monkeypatch.setattr(pf, "SKETCH", sketch)
    monkeypatch.setattr(pf, "KEEP", keep)
    data = _rows(3, rows)
    df = spark.createDataFrame(data, "g string, few double, many double, n long").repartition(4)
    got = {(r.g, r.col, r.prob): r.value for r in pf.bracket_quantiles(df, ["g"], ["few", "many", "n"], PROBS).collect()}
    for g in {r[0] for r in data}:
        for k, c in enumerate(("few", "many", "n"), 1):
            want = _exact([r[k] for r in data if r[0] == g and r[k] is not None])
            for p, w in zip(PROBS, want):
                assert got[g, c, p] == (w if w is None else pytest.approx(w, abs=1e-9)), (g, c, p)


def test_without_groups(spark):
    data = _rows(5, 500)
    df = spark.createDataFrame(data, "g string, few double, many double, n long")
    got = {(r.col, r.prob): r.value for r in pf.bracket_quantiles(df, [], ["few", "n"], PROBS).collect()}
    for k, c in ((1, "few"), (3, "n")):
        assert [got[c, p] for p in PROBS] == pytest.approx(_exact([r[k] for r in data if r[k] is not None]))
    empty = pf.bracket_quantiles(df.limit(0), [], ["few"], (0.5,)).collect()
    assert [r.value for r in empty] == [None]


def test_infinite_and_nan(spark):
    values = [float("-inf")] * 3 + [1.0, 2.0] + [float("inf")] * 2 + [float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r.prob: r.value for r in pf.bracket_quantiles(df, [], ["x"], (0.0, 3 / 7, 4 / 7, 1.0)).collect()}
    assert got[0.0] == float("-inf") and got[1.0] != got[1.0]  # NaN is the largest, as in an ORDER BY


def test_few_values_are_shuffled(spark):
    """Of 200,000 different values less than one in a hundred lies in a bracket."""
    df = spark.range(200_000).selectExpr("id * 7919 % 200000 / 3.0 AS x")
    out = pf.bracket_quantiles(df, [], ["x"], (0.25, 0.5, 0.75))
    assert {r.prob: r.value for r in out.collect()} == {p: pytest.approx(p * 199_999 / 3) for p in (0.25, 0.5, 0.75)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    bounds = [float(x) for x in __import__("re").findall(r">= (\d+\.\d+)\)", plan)]
    assert len(bounds) >= 3 and all(min(abs(b - p * 199_999 / 3) for p in (0.25, 0.5, 0.75)) < 0.0033 * 200_000 / 3 / 2 for b in bounds)


def test_rank_between_two_values_beyond_a_bracket(spark, monkeypatch):
    """Sketches of 8 often end a bracket just below a rank: both neighbours of the rank are needed."""
    monkeypatch.setattr(pf, "SKETCH", 8)
    monkeypatch.setattr(pf, "MARGIN", 0.0)
    probs = [(k + 0.5) / 39 for k in range(2, 39, 7)]
    df = spark.createDataFrame([(float(k * k),) for k in range(40)], "x double").repartition(4)
    for _ in range(2):  # sketches are drawn at random
        got = {r.prob: r.value for r in pf.bracket_quantiles(df, [], ["x"], probs).collect()}
        assert [got[p] for p in probs] == pytest.approx([float(np.quantile([k * k for k in range(40)], p)) for p in probs])


def test_values_that_repeat_beyond_a_bracket_end(spark, monkeypatch):
    """Two values of 300 rows each can be no bracket of 20 rows; redrawing it must come to an end."""
    monkeypatch.setattr(pf, "KEEP", 20)
    from tessera import session

    kept, rounds = session.stored, []

    def counted(df, label):
        rounds.append(label)
        assert rounds.count("quantile-open") < 6, "brackets are drawn again without an end"
        return kept(df, label)

    monkeypatch.setattr(session, "stored", counted)
    values = [float(k // 300) for k in range(1200)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    probs = (0.25, 0.5, 0.75)
    got = {r.prob: r.value for r in pf.bracket_quantiles(df, [], ["x"], probs).collect()}
    assert [got[p] for p in probs] == pytest.approx([float(np.quantile(values, p)) for p in probs])


def test_many_nans(spark, monkeypatch):
    """Sketches leave NaN out, ranks do not."""
    from tessera import session

    kept, rounds = session.stored, []

    def counted(df, label):
        rounds.append(label)
        assert rounds.count("quantile-open") < 6, "brackets are drawn again without an end"
        return kept(df, label)

    monkeypatch.setattr(session, "stored", counted)
    df = spark.createDataFrame([(float(k),) for k in range(901)] + [(float("nan"),)] * 100, "x double")
    got = {r.prob: r.value for r in pf.bracket_quantiles(df, [], ["x"], (0.25, 0.5, 1.0)).collect()}
    assert (got[0.25], got[0.5]) == (250.0, 500.0) and got[1.0] != got[1.0]
