"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints are the leaves of a binary trie, one bit a level. The join walks
pairs of nodes of the same depth together, adds one to a pair's error whenever
the two paths differ in a bit, and drops the pair once its error budget is
spent; pairs that reach their leaves are links.

With at most ``d`` differing bits spread over ``d // 2 + 1`` parts of the
fingerprint, some part holds at most one of them. So the join runs over one
trie per part, the fingerprint rotated until that part leads: the budget is 1
inside the leading part and ``d`` over the whole path. The pairs visited per
fingerprint then grow with the trie's depth, not with its fourth power.

Spark holds the top of each trie: a fingerprint goes to its own node at depth
``top`` and, as a guest, to the nodes whose path differs in one bit. Tasks walk
the subtrees below. Inside a task a pair of nodes is dropped as well when all
its leaves are already one component, so a large group of near copies costs
about its size, not its square, and only a spanning forest leaves the task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, stored, width

#: Fingerprints a node at the top of a trie is sized for, rows (with guests) a task is sized for, and
#: rows that a task walks at a time.
NODE_ROWS = 8_192
TASK_ROWS = 400_000
CHUNK_ROWS = 150_000
#: Node pairs that are walked at a time, and pairs of leaves below which a node pair is compared directly.
FRONTIER = 200_000
LEAF_PAIRS = 64


# ---- fingerprints ---------------------------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit fingerprint of the whole text: a bit is set if it is in over half of the shingles' hashes.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a shingle is ``shingle`` words joined
    by a space, hashed as UTF-8 by XXH64 with seed 42. Fewer words are one shingle; none give zero.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for low in range(0, n, 65_536):
        high = min(n, low + 65_536)
        spans = zip(starts[low:high].tolist(), ends[low + shingle - 1 : high + shingle - 1].tolist())
        hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in spans], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""
    def compute(batches):
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [id_col, "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(compute, f"`{id_col}` {id_type}, fp long")


# ---- the walk below a trie's top ------------------------------------------------------------------------


class Forest:
    """Union-find over positions, for whole arrays of links at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def _changes(labels: np.ndarray) -> np.ndarray:
    """A range [lo, hi) holds one label if and only if changes[hi - 1] == changes[lo]."""
    return np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])]) if len(labels) else np.zeros(0, np.int64)


def _expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ..., then lo[1], ...: n[i] numbers from each."""
    total = int(n.sum())
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)


def walk(own: np.ndarray, guests: np.ndarray, top: int, lead: int, budget: int,
         lead_budget: int = 1) -> np.ndarray:
    """Component labels of ``own`` followed by ``guests`` under links of at most ``budget`` bits.

    Both are sorted uint64 arrays. Their first ``top`` bits name the node; guests carry the node's path
    there and are one bit further away than their bits show. Links inside ``own`` and between ``own`` and
    ``guests`` of a node are all respected (those among guests may be, they belong to other nodes).
    """
    n_own = len(own)
    everything = np.concatenate([own, guests])
    forest = Forest(len(everything))
    one = np.uint64(1)
    if n_own == 0:
        return forest.root
    # neighbours in sorted order: cheap links that join most of a large group before the walk
    for lo, hi in ((0, n_own), (n_own, len(everything))):
        part = everything[lo:hi]
        spare = budget if lo == 0 else budget - 2  # two guests may differ in two bits more than they show
        for step in (1, 2, 3):
            near = np.flatnonzero(np.bitwise_count(part[step:] ^ part[:-step]) <= spare) if len(part) > step else []
            if len(near):
                forest.link(lo + near, lo + near + step)
    shift = np.uint64(64 - top)
    path = (own >> shift) if top else np.zeros(n_own, np.uint64)
    a_lo = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
    a_hi = np.append(a_lo[1:], n_own)
    node = path[a_lo]
    guest_path = (guests >> shift) if top else np.zeros(len(guests), np.uint64)
    b_lo = n_own + np.searchsorted(guest_path, node, "left")
    b_hi = n_own + np.searchsorted(guest_path, node, "right")
    zero = np.zeros(len(node), np.int64)
    stack = [(top, a_lo, a_hi, a_lo, a_hi, zero), (top, a_lo, a_hi, b_lo, b_hi, zero + 1)]
    labels = forest.root
    change = _changes(labels)
    while stack:
        depth, a_lo, a_hi, b_lo, b_hi, err = stack.pop()
        live = (a_hi > a_lo) & (b_hi > b_lo) & (err <= budget)
        live[live] = ~((change[a_hi[live] - 1] == change[a_lo[live]]) & (change[b_hi[live] - 1] == change[b_lo[live]])
                       & (labels[a_lo[live]] == labels[b_lo[live]]))
        a_lo, a_hi, b_lo, b_hi, err = (x[live] for x in (a_lo, a_hi, b_lo, b_hi, err))
        if len(a_lo) > FRONTIER:
            half = len(a_lo) // 2
            stack.append((depth, a_lo[:half], a_hi[:half], b_lo[:half], b_hi[:half], err[:half]))
            stack.append((depth, a_lo[half:], a_hi[half:], b_lo[half:], b_hi[half:], err[half:]))
            continue
        small = (a_hi - a_lo) * (b_hi - b_lo) <= LEAF_PAIRS if depth < 64 else np.ones(len(a_lo), bool)
        if small.any():
            # the last levels of small subtrees at once: every pair of leaves, its errors counted by xor
            na, nb = (a_hi - a_lo)[small], (b_hi - b_lo)[small]
            rows = _expand(a_lo[small], na)
            of = np.repeat(np.arange(len(na)), na)
            left = np.repeat(rows, nb[of])
            right = _expand(b_lo[small][of], nb[of])
            extra = np.repeat((b_lo[small] >= n_own).astype(np.int64)[of], nb[of])
            close = np.bitwise_count(everything[left] ^ everything[right]) + extra <= budget
            close &= left != right
            if close.any():
                forest.link(left[close], right[close])
                labels = forest.root
                change = _changes(labels)
        a_lo, a_hi, b_lo, b_hi, err = (x[~small] for x in (a_lo, a_hi, b_lo, b_hi, err))
        if not len(a_lo):
            continue
        bit = one << np.uint64(63 - depth)
        above = ~((bit << one) - one) if depth else np.uint64(0)
        a_mid = np.searchsorted(own, (own[a_lo] & above) | bit)
        a_mid = np.clip(a_mid, a_lo, a_hi)
        to_own = b_lo < n_own
        b_mid = np.empty_like(b_lo)
        first = (everything[b_lo] & above) | bit
        b_mid[to_own] = np.searchsorted(own, first[to_own])
        b_mid[~to_own] = n_own + np.searchsorted(guests, first[~to_own])
        b_mid = np.clip(b_mid, b_lo, b_hi)
        same = (a_lo == b_lo) & to_own  # a node with itself: its two children meet once
        keep_cross = err + 1 <= (budget if depth >= lead else lead_budget)
        twice = keep_cross & ~same
        stack.append((depth + 1,
                      np.concatenate([a_lo, a_mid, a_lo[keep_cross], a_mid[twice]]),
                      np.concatenate([a_mid, a_hi, a_mid[keep_cross], a_hi[twice]]),
                      np.concatenate([b_lo, b_mid, b_mid[keep_cross], b_lo[twice]]),
                      np.concatenate([b_mid, b_hi, b_hi[keep_cross], b_mid[twice]]),
                      np.concatenate([err, err, err[keep_cross] + 1, err[twice] + 1])))
    return forest.root


# ---- the join -------------------------------------------------------------------------------------------


def parts_of(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, length) of the parts: among ``max_bits // 2 + 1`` one holds at most one differing bit."""
    n = max_bits // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _links(reps: DataFrame, max_bits: int) -> DataFrame:
    """(u, v): a spanning forest of the links between the representatives ``(fp, rep)``, per task."""
    spark = reps.sparkSession
    parts = parts_of(max_bits)
    n = reps.count()
    top = max(1, min(min(length for _, length in parts), math.ceil(math.log2(max(2, n / NODE_ROWS)))))
    turned = []
    for i, (first, _) in enumerate(parts):
        turn = (F.shiftleft("fp", first).bitwiseOR(F.shiftrightunsigned("fp", 64 - first)) if first else F.col("fp"))
        turned.append(F.struct(F.lit(i).alias("part"), turn.alias("bits")))
    rows = reps.select("rep", F.explode(F.array(*turned)).alias("t")).select("rep", "t.part", "t.bits")
    rows = rows.withColumn("node", F.shiftrightunsigned("bits", 64 - top))
    # a guest goes from the node with the bit to the one without it, so that two nodes meet once
    nodes = [F.struct(F.col("node").alias("node"), F.lit(False).alias("guest"))] + [
        F.struct(F.col("node").bitwiseXOR(F.lit(1 << b)).alias("node"), F.lit(True).alias("guest")) for b in range(top)]
    wanted = F.filter(F.array(*nodes), lambda x: ~x["guest"] | (x["node"] < F.col("node")))
    sent = rows.select("rep", "part", "bits", F.explode(wanted).alias("n")).select(
        "part", "n.node", "n.guest", "bits", "rep")
    tasks = width(spark, len(parts) * n * (1 + top // 2), TASK_ROWS)
    dealt = sent.repartition(tasks, "part", "node").sortWithinPartitions("part", "node")
    low = np.uint64((1 << (64 - top)) - 1)

    def solve(part, node, guest, bits, rep):
        out_u, out_v = [], []
        for p in np.unique(part):
            own, far = (part == p) & ~guest, (part == p) & guest
            a, b = bits[own], (node[far] << np.uint64(64 - top)) | (bits[far] & low)
            ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
            labels = walk(a[ia], b[ib], top, parts[p][1], max_bits)
            reps_ = np.concatenate([rep[own][ia], rep[far][ib]])
            linked = np.flatnonzero(labels != np.arange(len(labels)))
            out_u.append(reps_[linked])
            out_v.append(reps_[labels[linked]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (out_u, out_v)], ["u", "v"])

    def join(batches):
        held, size = [], 0

        def columns(table):
            get = lambda name: table.column(name).to_numpy()
            return [get("part"), get("node").astype(np.uint64), table.column("guest").to_pandas().to_numpy(bool),
                    get("bits").view(np.uint64), get("rep")]

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < CHUNK_ROWS:
                continue
            part, node, guest, bits, rep = columns(pa.Table.from_batches(held))
            new = np.flatnonzero((part[1:] != part[:-1]) | (node[1:] != node[:-1]))
            if not len(new):
                continue  # one node only: it is walked as a whole
            cut = int(new[-1]) + 1
            yield solve(part[:cut], node[:cut], guest[:cut], bits[:cut], rep[:cut])
            held = pa.Table.from_batches(held).slice(cut).to_batches()
            size -= cut
        if size:
            yield solve(*columns(pa.Table.from_batches(held)))

    return dealt.mapInArrow(join, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_bits: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    ``fingerprint`` has 16 lowercase hex digits. Rows link if their fingerprints differ in at most
    ``max_bits`` bits; ``component_id`` is the smallest id that links reach, itself included. Exact copies
    are met once, by their smallest id. Null and empty texts have fingerprint zero and link like any
    other; repeated rows are returned each; a row without an id gets the component of its fingerprint
    (null if no row with an id has it); other columns are not read; an empty table gives no rows.
    """
    if not 0 <= max_bits < 64:
        raise ValueError("max_bits must be from 0 to 63")
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    reps = stored(fps.groupBy("fp").agg(F.min(F.col(id_col).cast("long")).alias("rep")).where("rep IS NOT NULL"),
                  "simhash-reps")
    found = components(stored(_links(reps, max_bits), "simhash-links"), "simhash-components")
    classes = reps.join(found, reps.rep == found.node, "left").select(
        F.col("fp").alias("__fp"), F.coalesce("component", "rep").alias("component_id"))
    out = fps.join(classes, fps.fp == F.col("__fp"), "left")
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
