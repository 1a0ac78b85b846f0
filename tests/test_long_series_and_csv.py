"""Lags of series that span partitions; CSV inference and its quarantine."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ordering
from tessera.operators import timeseries as ts
from tessera.sources import files as fs


def _want(rows, lags, roll):
    out, by = {}, {}
    for i, s, v in sorted(rows, key=lambda r: r[0]):
        seen = by.setdefault(s, [])
        seen.append(v)
        window = seen[-roll:]
        mean = round(sum(window) / roll, 4) if len(window) == roll and None not in window else None
        out[i] = (*[seen[-1 - k] if len(seen) > k else None for k in lags], mean)
    return out


@pytest.mark.parametrize("lags,roll,parts", [((1, 2, 3), 3, 6), ((5,), 2, 3), ((1,), 7, 1), ((4,), 3, 40)])
def test_a_series_of_half_the_rows_spans_partitions(spark, lags, roll, parts):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", "a", "b", None, f"s{i % 40}"]), rng.choice([None, float(rng.randint(0, 99))]) if i % 9 == 0
             else float(rng.randint(0, 99))) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, s string, v double").repartition(4)
    got = ts.long_lag_features(df, "s", ["i"], "v", lags, roll, num_partitions=parts)
    want = _want(rows, lags, roll)
    names = [f"lag_{k}" for k in lags] + [f"rolling_{roll}"]
    assert got.columns == ["i", "s", "v", *names]
    for r in got.collect():
        assert tuple(r[n] for n in names) == pytest.approx(want[r.i]), r
    if parts == 6:
        laid_out = ordering._sorted_checkpoint(df, ["s", "i"], parts, None)
        assert laid_out.where("s = 'hot'").select(ordering._PID).distinct().count() >= 2
    assert ts.long_lag_features(df.limit(0), "s", ["i"], "v").count() == 0


def test_csv_inference_and_quarantine(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    good = [f'{i},{i / 4},2024-01-{1 + i % 28:02d},"a, b",{"true" if i % 2 else "false"}' for i in range(400)]
    (folder / "a.csv").write_text("\n".join(["n,x,d,s,t", *good[:200], "1,2.0", "", "oops,1.0,2024-01-01,s,true"]) + "\n")
    (folder / "b.csv").write_text("\n".join(["n,x,d,s,t", *good[200:], "1,2,2024-01-01,s,true,more", ",,,,"]) + "\n")
    rows, bad, report = fs.infer_csv(spark, str(folder))
    assert dict(rows.dtypes) == {"n": "bigint", "x": "double", "d": "date", "s": "string", "t": "boolean"}
    assert rows.count() == 401 and rows.agg(F.sum("n")).first()[0] == sum(range(400))
    assert sorted((r.line, r.reason) for r in bad.collect()) == [
        ("1,2,2024-01-01,s,true,more", "fields"), ("1,2.0", "fields"), ("oops,1.0,2024-01-01,s,true", "value")]
    assert {r.column_name: r.n_bad for r in report.collect()} == {"n": 1, "x": 0, "d": 0, "s": 0, "t": 0}
    strict = fs.infer_csv(spark, str(folder), bad_share=0.0)[0]
    assert dict(strict.dtypes)["n"] == "string" and strict.count() == 402
