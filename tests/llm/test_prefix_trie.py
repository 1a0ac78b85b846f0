"""The trie against a dictionary of prefixes; parentheses against a stack."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import prefix_trie as pt
from tessera.llm.queries import op12_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, words string, key binary"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, digest), role, text))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def _brute(sequences):
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in sorted(sequences.items()):
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = [totals[k] for k in children[node]]
        totals[node] = (sum(b[0] for b in below) if below else 1,
                        (len(members[node]) - 1) * words + sum(b[1] for b in below))
    return sorted((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), *totals[n],
                   hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n in members)


def _trie(spark, rows, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    conv = F.col("conv_id")
    rebuilt = pt.with_heads(pt.turn_lists(df), conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, most=3)
    return sorted((tuple(r[c] for c in COLUMNS) for r in pt.trie(rebuilt).collect()), key=lambda r: (r[0], r[1]))


def _case(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8]) if c % 20 else 6):
            rows.append((c, turn * 2, rng.choice(["user", "assistant", None]) if turn > 3 else "user",
                         rng.choice(["hi there", "a  b\tc", "", None, "é  ü"]), "clash", None))
    return rows


@pytest.mark.parametrize("seed,n", [(1, 120), (2, 60), (3, 7)])
def test_matches_brute_force(spark, seed, n):
    rows = _case(seed, n)
    assert _trie(spark, rows) == _brute(_rebuilt(rows))


def test_many_shards_merge_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(pt, "SHARD_TURNS", 20)
    monkeypatch.setattr(pt, "FAN", 2)
    rows = _case(4, 150)
    assert _trie(spark, rows) == _brute(_rebuilt(rows))


def test_copies_in_every_shard(spark, monkeypatch):
    """Copies of one conversation, more than one list of ids long and over many shards; long and turnless ones beside them."""
    monkeypatch.setattr(pt, "SHARD_TURNS", 400)
    monkeypatch.setattr(pt, "FAN", 3)
    rows = [(c, t, "user", f"turn {t}", None, None) for c in range(0, 60_000, 20) for t in range(3)]
    rows += [(20 * c + 1, t, "user", "only", None, None) for c in range(100) for t in range(1)]
    rows += [(100_001, t, "user", f"turn {t}", None, None) for t in range(3000)]
    assert _trie(spark, rows) == _brute(_rebuilt(rows))


def test_edges(spark):
    assert _trie(spark, []) == []
    assert _trie(spark, [(None, 1, "user", "x", None, None)]) == []
    rows = [(3, None, None, None, None, None), (3, 1, "u", "b", None, None), (3, 1, "u", "a", None, None), (3, 1, "u", "a", None, None),
            (None, 0, "u", "x", None, None), (23, 0, "u", "word " * 200_000, None, None), (43, 0, "u", "word " * 200_000, None, None)]
    assert _trie(spark, rows) == _brute(_rebuilt(rows))


def test_parentheses(monkeypatch):
    rng = random.Random(5)
    for block in (4, 64):
        monkeypatch.setattr(pt, "BLOCK", block)
        for n in (1, 2, 3, 50, 700):
            for deep in (True, False):
                depths = [0]
                while len(depths) < n:
                    depths.append(depths[-1] + 1 if deep and rng.random() < 0.8 else rng.randint(1, depths[-1] + 1))
                tree = pt.parens_of(np.array(depths))
                stack, close, parent, order = [], {}, {}, []
                for i, b in enumerate(tree.bits):
                    if b:
                        order.append(i)
                        parent[i] = stack[-1] if stack else None
                        stack.append(i)
                    else:
                        close[stack.pop()] = i
                assert tree.find_close(tree.opens).tolist() == [close[i] for i in order]
                depth, last, leaves, up = tree.shape()
                assert depth.tolist() == depths
                assert [None if p < 0 else order[p] for p in up] == [parent[i] for i in order]
                for k, i in enumerate(order):
                    inside = [j for j in order if i <= j <= close[i]]
                    assert order[last[k]] == inside[-1] and leaves[k] == sum(close[j] == j + 1 for j in inside)


def test_query_has_one_root_that_everyone_joins(spark):
    rows = op12_prefix_trie(spark, "/root/testdata/sf0.001").collect()
    root = [r for r in rows if r.depth == 0]
    assert len(root) == 1 and root[0].n_convs == 20 and root[0].n_leaves == sum(r.n_children == 0 for r in rows)
