"""Prefix trie of conversations, as balanced parentheses per shard.

A conversation is the sequence of its turns; a node of the trie is a distinct sequence of first turns. The
sequences, as digests of 16 bytes a turn, are range-sorted, so every shard holds a run of neighbours, whose
trie is written as balanced parentheses in one pass: between two neighbours the turns that they do not share are
closed and opened. On the parentheses,

* ``findclose`` delimits the subtree of a node. It searches the excess (opened less closed) by blocks: their
  smallest and largest excess, and a tree over these, say which block to enter;
* the rank of ``()`` counts the leaves of a subtree;
* differences of cumulative arrays give the members and the savings of a subtree.

Only the nodes on the path of a shard's first or last conversation (its spine) can go on in another shard.
They are returned as partial sums, and merged in groups of ``FAN`` neighbouring shards by the same parentheses,
until one group is left. A first turn that very many conversations share is a spine node of many shards and
never one task; equal conversations are split between shards as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored, width

#: Parentheses of one block of the excess search.
BLOCK = 64
#: Turns a shard is sized for, shards whose spines one task merges, and conversation ids in one row of a list.
SHARD_TURNS = 200_000
FAN = 64
LIST_IDS = 1000
DIGEST = 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Parens:
    """Balanced parentheses (1 opens, 0 closes) of one tree; nodes are numbered as they open."""

    def __init__(self, bits: np.ndarray):
        self.bits = np.asarray(bits, np.int8)
        self.excess = np.cumsum(2 * self.bits.astype(np.int64) - 1)
        self.opens = np.flatnonzero(self.bits)
        leaf = self.bits.astype(bool) & np.append(self.bits[1:] == 0, False)
        self.leaves_to = np.concatenate([[0], np.cumsum(leaf)])  # rank of "()" before a place
        self.opens_to = np.concatenate([[0], np.cumsum(self.bits, dtype=np.int64)])
        blocks = -(-len(self.bits) // BLOCK)
        wide = 1 << max(0, blocks - 1).bit_length()
        filled = np.full(wide * BLOCK, np.iinfo(np.int64).max)
        filled[: len(self.bits)] = self.excess
        low = filled.reshape(wide, BLOCK).min(axis=1)
        filled[len(self.bits) :] = np.iinfo(np.int64).min
        high = filled.reshape(wide, BLOCK).max(axis=1)
        self.low, self.high = [low], [high]
        while len(low) > 1:
            low, high = low.reshape(-1, 2).min(axis=1), high.reshape(-1, 2).max(axis=1)
            self.low.append(low)
            self.high.append(high)

    def _scan(self, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place from ``start`` to the end of its block with the excess ``target``, -1 if there is none."""
        found = np.full(len(start), -1)
        at = start.copy()
        end = np.minimum((start // BLOCK + 1) * BLOCK, len(self.bits))
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self.excess[at[live]] == target[live]
            found[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return found

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The places where the parentheses opened at ``opens`` close."""
        target = self.excess[opens] - 1
        next_at = opens + 1
        same = next_at // BLOCK == opens // BLOCK
        found = np.full(len(opens), -1)
        found[same] = self._scan(next_at[same], target[same])
        rest = np.flatnonzero(found < 0)
        if len(rest):
            found[rest] = self._beyond(opens[rest] // BLOCK, target[rest])
        return found

    def _holds(self, level: int, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        return (self.low[level][block] <= target) & (target <= self.high[level][block])

    def _beyond(self, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        """As ``find_close``, from the blocks after ``block``: up the tree of blocks, down again, then inside."""
        at, level_of = block.copy(), np.full(len(block), -1)
        for level in range(len(self.low) - 1):
            live = np.flatnonzero(level_of < 0)
            right = live[at[live] % 2 == 0]
            right = right[self._holds(level, at[right] + 1, target[right])]
            at[right] += 1
            level_of[right] = level
            up = np.flatnonzero(level_of < 0)
            at[up] //= 2
        for level in range(len(self.low) - 2, -1, -1):
            down = np.flatnonzero(level_of > level)
            left = at[down] * 2
            at[down] = np.where(self._holds(level, left, target[down]), left, left + 1)
        return self._scan(at * BLOCK, target)

    def shape(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every node: depth, last node of its subtree, leaves of its subtree, parent (-1 for the root)."""
        close = self.find_close(self.opens)
        depth = self.excess[self.opens] - 1
        last = self.opens_to[close] - 1
        leaves = self.leaves_to[close] - self.leaves_to[self.opens]
        # the parent is the last node before it that is one less deep
        n = len(depth)
        order = np.lexsort((np.arange(n), depth))
        code = depth[order] * n + order
        parent = order[np.searchsorted(code, (depth - 1) * n + np.arange(n)) - 1]
        parent[0] = -1
        return depth, last, leaves, parent


def parens_of(depths: np.ndarray) -> Parens:
    """The tree whose nodes, in the order in which they open, have these depths (0 first)."""
    n = len(depths)
    closed = np.append(depths[:-1] - depths[1:] + 1, depths[-1] + 1)  # closed after each node
    bits = np.zeros(2 * n, np.int8)
    bits[np.arange(n) + np.concatenate([[0], np.cumsum(closed[:-1])])] = 1
    return Parens(bits)


def subtree_sums(values: np.ndarray, last: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[last + 1] - total[: len(values)]


def shared_turns(a: bytes, b: bytes) -> int:
    """Number of leading turns that two sequences share."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * DIGEST : mid * DIGEST] == b[low * DIGEST : mid * DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


def prefix_ids(key: bytes) -> list[bytes]:
    """An id of 16 bytes for every prefix of a sequence, the empty one first."""
    h = hashlib.md5()
    out = [h.digest()]
    for i in range(0, len(key), DIGEST):
        h.update(key[i : i + DIGEST])
        out.append(h.copy().digest())
    return out


_FIELDS = ("kind string, shard int, node int, id binary, parent_id binary, conv_id long, depth long, parent_conv_id long, "
           "n_convs long, n_children long, n_leaves long, saved_tokens long, words long, first boolean, last boolean, ends string")
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]
_ARROW = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in _FIELDS.split(", ")])


def _rows(kind: str, shard: int, n: int, **columns) -> Iterator[pa.RecordBatch]:
    """Record batches of at most 10,000 rows; columns that are not given are null."""
    given = {"kind": [kind] * n, "shard": [shard] * n, **columns}
    for at in range(0, n, 10_000):
        m = min(10_000, n - at)
        yield pa.RecordBatch.from_arrays(
            [pa.array(given[f.name][at : at + m], f.type) if f.name in given else pa.nulls(m, f.type) for f in _SCHEMA],
            schema=_SCHEMA)


def _shard_trie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the trie of one shard: complete nodes, partial spine nodes, lists of ids that end on the spine."""
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    depths, words, ids, ends = [0], [0], [], []  # ends: the node at which each conversation ends
    path, key, first_key = [0], b"", None
    for batch in batches:
        for own, counts, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            first_key = own if first_key is None else first_key
            same = shared_turns(key, own)
            del path[same + 1 :]
            for d in range(same, len(counts)):
                path.append(len(depths))
                depths.append(d + 1)
                words.append(counts[d])
            key = own
            ids.append(conv)
            ends.append(path[-1])
    if not ids:
        return
    depth, last, leaves, parent = parens_of(np.array(depths)).shape()
    n, words, ids, ends = len(depth), np.array(words, np.int64), np.array(ids, np.int64), np.array(ends, np.int64)
    low, high = np.searchsorted(ends, np.arange(n)), np.searchsorted(ends, last, "right")
    members = high - low
    smallest = np.minimum.reduceat(np.append(ids, ids[-1]), np.stack([low, high], 1).ravel())[::2]
    children = np.bincount(parent[1:], minlength=n)
    nodes = np.arange(n)
    on_first = (nodes <= ends[0]) & (ends[0] <= last)
    on_last = (nodes <= ends[-1]) & (ends[-1] <= last)
    spine = on_first | on_last
    inner = ~spine
    saved = subtree_sums(np.where(inner, (members - 1) * words, 0), last)
    own_high = np.searchsorted(ends, nodes, "right")  # ends[low:own_high] == node

    id_of = {}
    for on, whole in ((on_first, first_key), (on_last, key)):
        id_of.update(zip(np.flatnonzero(on).tolist(), prefix_ids(whole)))
    at = np.flatnonzero(inner)
    up = parent[at]
    pending = spine[up]
    yield from _rows(
        "node", shard, len(at), parent_id=[id_of[p] if w else None for p, w in zip(up.tolist(), pending.tolist())],
        conv_id=smallest[at], depth=depth[at], parent_conv_id=[None if w else c for w, c in zip(pending.tolist(), smallest[up].tolist())],
        n_convs=members[at], n_children=children[at], n_leaves=leaves[at], saved_tokens=saved[at],
        ends=[hashlib.sha256(",".join(map(str, ids[a:b].tolist())).encode()).hexdigest() if b > a else EMPTY_SHA
              for a, b in zip(low[at].tolist(), own_high[at].tolist())])
    # the spine: what hangs on it below, and its own members; children and leaves on the spine come with the merge
    at = np.flatnonzero(spine)
    spine_children = np.bincount(parent[at[at > 0]], minlength=n)
    hung_leaves = subtree_sums(np.where(inner & (last == nodes), 1, 0), last)
    on_spine_below = np.zeros(n, np.int64)
    saved_below = np.zeros(n, np.int64)
    for child in at[at > 0].tolist():  # each spine node keeps what does not hang on a deeper one
        on_spine_below[parent[child]] += hung_leaves[child]
        saved_below[parent[child]] += saved[child]
    yield from _rows(
        "spine", shard, len(at), node=np.arange(len(at)), id=[id_of[k] for k in at.tolist()], conv_id=smallest[at],
        depth=depth[at], n_convs=members[at], n_children=(children - spine_children)[at],
        n_leaves=(hung_leaves - on_spine_below)[at], saved_tokens=(saved - saved_below)[at], words=words[at],
        first=on_first[at], last=on_last[at])
    for k in at.tolist():
        listed = range(int(low[k]), int(own_high[k]), LIST_IDS)
        yield from _rows("ends", shard, len(listed), node=list(range(len(listed))), id=[id_of[k]] * len(listed),
                         ends=[",".join(map(str, ids[a : min(a + LIST_IDS, own_high[k])].tolist())) for a in listed])


_PARTIAL = ["shard", "node", "id", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "words", "first", "last"]
_MERGED = ("kind string, shard int, node int, id binary, parent_id binary, conv_id long, depth long, parent_conv_id long, "
           "n_convs long, n_children long, n_leaves long, saved_tokens long, words long, first boolean, last boolean")


def _merge_spines(part: pd.DataFrame, whole: bool) -> pd.DataFrame:
    """The spines of neighbouring shards as one: nodes that are complete, and the group's own spine.

    A shard's spine lists its nodes as they open, so a node that the path so far holds already is the same node.
    """
    part = part.sort_values(["shard", "node"])
    path: list[int] = []
    nodes: dict[str, list] = {c: [] for c in _PARTIAL}
    first_shard, last_shard = part.shard.iloc[0], part.shard.iloc[-1]
    for row in part[_PARTIAL].itertuples(index=False):
        d = row.depth
        begins, finishes = row.first and row.shard == first_shard, row.last and row.shard == last_shard
        if d < len(path) and nodes["id"][path[d]] == row.id:
            k = path[d]
            for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                nodes[c][k] += getattr(row, c)
            nodes["conv_id"][k] = min(nodes["conv_id"][k], row.conv_id)
            nodes["first"][k] |= begins
            nodes["last"][k] |= finishes
            continue
        del path[d:]
        path.append(len(nodes["id"]))
        for c, v in zip(_PARTIAL, row):
            nodes[c].append(v)
        nodes["first"][-1], nodes["last"][-1] = begins, finishes
    got = pd.DataFrame(nodes)
    depth, last, _, parent = parens_of(got.depth.to_numpy()).shape()
    n = len(got)
    spine = np.zeros(n, bool) if whole else (got["first"] | got["last"]).to_numpy(bool)
    done = ~spine
    below = np.bincount(parent[1:], minlength=n)  # children on the merged spines
    children = got.n_children.to_numpy() + below
    own_leaves = got.n_leaves.to_numpy() + np.where(done & (children == 0), 1, 0)
    own_saved = got.saved_tokens.to_numpy() + np.where(done, (got.n_convs.to_numpy() - 1) * got.words.to_numpy(), 0)
    leaves, saved = subtree_sums(own_leaves, last), subtree_sums(own_saved, last)
    up = np.maximum(parent, 0)
    waits = (parent >= 0) & spine[up]
    conv = got.conv_id.to_numpy()
    out = pd.DataFrame({
        "kind": np.where(done, "node", "spine"), "shard": first_shard, "node": np.arange(n, dtype=np.int32), "id": got["id"],
        "parent_id": [got["id"][p] if w else None for p, w in zip(up.tolist(), waits.tolist())], "conv_id": conv, "depth": depth,
        "parent_conv_id": pd.array([None if w or p < 0 else int(conv[p]) for p, w in zip(parent.tolist(), waits.tolist())], "Int64"),
        "n_convs": got.n_convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "words": got.words,
        "first": got["first"].astype(bool), "last": got["last"].astype(bool)})
    if whole or not spine.any():
        return out
    # what stays open keeps only what hangs on it directly: less its children on the spine, which come again
    at = np.flatnonzero(spine)
    for values, name in ((leaves, "n_leaves"), (saved, "saved_tokens")):
        kept = values.copy()
        for child in at[at > 0].tolist():
            kept[parent[child]] -= values[child]
        out.loc[at, name] = kept[at]
    open_children = np.bincount(parent[at[at > 0]], minlength=n)
    out.loc[at, "n_children"] = (children - open_children)[at]
    out.loc[at, "node"] = np.arange(len(at), dtype=np.int32)
    return out


def _merge_group(part: pd.DataFrame) -> pd.DataFrame:
    return _merge_spines(part, whole=False)


def _merge_all(part: pd.DataFrame) -> pd.DataFrame:
    return _merge_spines(part, whole=True)


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sha) of the joined lists of each id; rows come sorted, so nothing but a hash is held."""
    schema = pa.schema([("end_id", pa.binary()), ("sha", pa.string())])
    own, h = None, None
    for batch in batches:
        out = []
        for node, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node != own:
                if own is not None:
                    out.append((own, h.hexdigest()))
                own, h = node, hashlib.sha256(ends.encode())
            else:
                h.update(b"," + ends.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
    if own is not None:
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array([h.hexdigest()])], schema=schema)


def turn_lists(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as digest of role and text and words of the text.

    Null turn numbers come first; equal ones are ordered by the digest. A null role or text is an empty one; rows
    without a conv_id belong to no conversation. A conversation is one row: its turns must fit a task, its texts not.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).isNotNull().alias("known"), F.col(turn_col).alias("turn"),
        digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    by_order = F.array_sort(F.collect_list(F.struct("known", "turn", "digest", "words")))
    return turns.groupBy("conv_id").agg(by_order.alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def with_heads(lists: DataFrame, source: Column, head: Column, most: int) -> DataFrame:
    """Conversations whose first ``head`` turns are replaced by those of the conversation ``source`` (none if absent).

    ``head`` is at most ``most``, which bounds what is joined.
    """
    heads = lists.select(F.col("conv_id").alias("__source"), F.slice("turns", 1, most).alias("__head"))
    named = lists.withColumns({"__from": source, "__n": head.cast("int")})
    met = named.join(heads, F.col("__from") == F.col("__source"), "left")
    own = F.slice("turns", F.col("__n") + 1, F.greatest(F.size("turns"), F.lit(1)))
    front = F.when(F.col("__head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("__head", F.lit(1), F.col("__n")))
    return met.select("conv_id", F.concat(front, own).alias("turns"))


def trie(lists: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of ``lists(conv_id, turns)`` (see ``turn_lists``).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Members of a node are the conversations that begin with its turns; those without a turn are members of
    the root. Conversation ids are distinct and not null. An empty table has no root and gives no rows.
    """
    spark = lists.sparkSession
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    sequences = stored(lists.select(key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"), "conv_id"),
                       "trie-sequences")
    size = sequences.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    shards = width(spark, size, SHARD_TURNS)
    sorted_ = sequences.repartitionByRange(shards, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = stored(sorted_.mapInArrow(_shard_trie, _FIELDS), "trie-shards")

    nodes = [found.where("kind = 'node'").select("shard", "parent_id", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                                                 "n_leaves", "saved_tokens", "ends")]
    spines = found.where("kind = 'spine'").select(*_PARTIAL)
    of_shard = found.where("kind = 'spine'").select("shard", "id")
    groups, merged = shards, []
    while not merged or groups > 1:
        groups = -(-groups // FAN)
        grouped = spines.groupBy(F.floor(F.col("shard") / F.lit(FAN ** (len(merged) + 1))).cast("int").alias("group"))
        merge = _merge_all if groups == 1 else _merge_group
        level = stored(grouped.applyInPandas(merge, _MERGED), "trie-spines")
        merged.append(level.where("kind = 'node'"))
        spines = level.where("kind = 'spine'").select(*_PARTIAL)
    spine = merged[0]
    for level in merged[1:]:
        spine = spine.unionByName(level)
    # the smallest members of spine nodes, for the children that wait for them
    named = stored(spine, "trie-spine")
    known = named.select(F.col("id").alias("__id"), F.col("conv_id").alias("__conv"))
    per_shard = of_shard.join(known, F.col("id") == F.col("__id")).select(
        F.col("shard").alias("__shard"), F.col("id").alias("__parent"), F.col("__conv").alias("__parent_conv"))
    done = nodes[0].join(per_shard, (F.col("shard") == F.col("__shard")) & (F.col("parent_id") == F.col("__parent")), "left")
    complete = done.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "__parent_conv"))
    lists_ = found.where("kind = 'ends'").select("id", "ends", "shard", "node")
    digests = lists_.repartition("id").sortWithinPartitions("id", "shard", "node").select("id", "ends").mapInArrow(
        _list_digests, "end_id binary, sha string")
    upper = known.select(F.col("__id").alias("__up"), F.col("__conv").alias("__up_conv"))
    closed = named.join(upper, F.col("parent_id") == F.col("__up"), "left").join(digests, F.col("id") == F.col("end_id"), "left")
    closed = closed.withColumns({"parent_conv_id": F.coalesce("parent_conv_id", "__up_conv"),
                                 "ends": F.coalesce("sha", F.lit(EMPTY_SHA))})
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    return complete.select(*out).unionByName(closed.select(*out))
