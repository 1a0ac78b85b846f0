"""Embedding near-dedup against brute force: links, components, recall."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import embed


def brute(rows, threshold=0.93):
    good = [k for k, (i, x, g) in enumerate(rows) if i is not None and g is not None and x is not None and len(x)
            and all(v is not None and np.isfinite(v) for v in x) and any(v != 0 for v in x)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], float) for k in (a, b))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i is None, i or 0, links[k], -1 if i is None else least[find(k)],
                   i is not None and i == least[find(k)]) for k, (i, _, _) in enumerate(rows))


def result(df):
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"],
                   -1 if r["component_id"] is None else r["component_id"], r["kept"]) for r in df.collect())


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, 0.5) for r in rows],
                                 f"vec_id long, embedding array<{kind}>, label int, x double")


def clusters(seed, n, dim=16, labels=3, near=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dim))
    rows = []
    for i in range(n):
        c = int(rng.integers(len(centres)))
        x = centres[c] + near * rng.standard_normal(dim) if rng.random() < 0.7 else rng.standard_normal(dim)
        if rng.random() < 0.1:
            x = centres[c]
        rows.append((int(i * 5 % n + 1) if n % 5 else i + 1, [float(v) for v in np.float32(x)], int(c % labels)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_one_leaf_is_exact(spark, seed):
    rows = clusters(seed, 301)
    assert result(embed.near_duplicates(frame(spark, rows))) == brute(rows)


def test_recall_over_many_leaves(spark):
    rows = clusters(5, 1201)
    got, want = result(embed.near_duplicates(frame(spark, rows), leaf=60)), brute(rows)
    found, there = sum(r[2] for r in got), sum(r[2] for r in want)
    assert all(g[2] <= w[2] for g, w in zip(got, want))  # none below the threshold, none counted twice
    assert found / there >= 0.97
    assert sum(g[3] == w[3] for g, w in zip(got, want)) / len(want) >= 0.98


def test_pairs_that_meet_in_several_leaves_count_once(spark):
    rows = clusters(6, 401, near=0.02)
    got, want = result(embed.near_duplicates(frame(spark, rows), leaf=100, spill=0.3)), brute(rows)
    assert all(g[2] <= w[2] for g, w in zip(got, want)) and sum(r[2] for r in got) >= 0.99 * sum(r[2] for r in want)


def test_bad_vectors_and_labels(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 1), (2, one, 1), (3, [2.0, 4.0, 6.0], 1), (4, one, 2), (5, one, None), (6, None, 1), (7, [], 1),
            (8, [0.0, 0.0, 0.0], 1), (9, [1.0, None, 3.0], 1), (10, [float("nan"), 2.0, 3.0], 1), (11, [float("inf"), 2.0, 3.0], 1),
            (12, [1.0, 2.0], 1), (None, one, 1), (2, one, 1), (13, [-0.0, 0.0, 1.0], 1), (14, [0.0, -0.0, 1.0], 1),
            (15, [1e200, 2e200, 3e200], 1), (16, [1e-200, 2e-200, 3e-200], 1)]
    assert result(embed.near_duplicates(frame(spark, rows, "double"))) == brute(rows)


def test_empty(spark):
    assert embed.near_duplicates(frame(spark, [(1, [1.0], 1)]).limit(0)).count() == 0
    assert embed.near_duplicates(frame(spark, [(1, None, 1)])).count() == 1


def test_alike_vectors_do_not_stop_a_tree():
    x = np.ones((500, 4)) / 2
    tree = embed.fit_tree(x, 3, 0.1, 1)
    rows, leaves = tree.leaves(x)
    assert set(rows) == set(range(500)) and len(rows) == len(leaves)


def test_a_group_of_a_third_keeps_its_links(spark):
    rng = np.random.default_rng(3)
    n, group, dim = 60_000, 20_000, 64
    x = rng.standard_normal((n, dim))
    centre = rng.standard_normal(dim)
    x[:group] = centre / np.linalg.norm(centre) + np.sqrt(0.0526 / dim) * rng.standard_normal((group, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = np.zeros(n, np.int64)
    for low in range(0, n, 2_000):
        want += (x[low : low + 2_000] @ x.T >= 0.93).sum(axis=0)
    want -= 1
    flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(x.ravel()))
    table = pa.table({"vec_id": pa.array(np.arange(n)), "embedding": flat, "label": pa.array(np.ones(n, np.int32))})
    got = embed.near_duplicates(spark.createDataFrame(table)).toArrow().sort_by("vec_id")
    links = got.column("n_links").to_numpy()
    assert (links == want).all() and want.sum() > group * group / 2  # trees alone keep 0.60 of them
    component = got.column("component_id").to_numpy()
    assert (component[want > 0] == component[np.argmax(want > 0)]).all()
