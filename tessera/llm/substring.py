"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is parsed into factors that are copies of earlier text (a smaller
document id, or an earlier place of the same document) and the words between.
A factor of at least ``window`` words is a duplicate span.

The reference is the whole corpus, indexed by anchors: the smallest hash among
the ``window - GRAM + 1`` word n-grams of each window. Equal windows have equal
anchors, so windows whose anchor is found once in the corpus are settled by
counts of anchors alone. Of the others, the windows of one place of an anchor
go together to the reference block of that anchor, each as a hash of its words;
the block holds every place of the anchor and gives each window the earliest
place with the same words. The parse is greedy: a factor starts at the first
window with a reference and is extended word by word while the next window
continues the same reference; where it does not, the factor ends, and the
windows across the boundary are judged by their own references.

Two windows count as equal if their anchors (64 bits) and their own hashes (64
bits) are. Anchors are counted in each task before they are shuffled. An anchor
with more than ``HOT_PLACES`` places is no block of its own: its windows are
reduced to their earliest places in each task and then joined, which Spark
splits when it is skewed.

Texts are compressed before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_SPACE, stored

#: Words of the n-grams that anchors are chosen from.
GRAM = 6
#: Bytes and words handled at a time inside a long document.
SLICE = 1 << 20
#: Places of an anchor that one task takes as a block, and rows that a task solves at a time.
HOT_PLACES = 20_000
BLOCK_ROWS = 40_000

_BYTE_BASE = 0xD6E8FEB86659FD93
_GRAM_BASE = np.uint64(0xA0761D6478BD642F)
_WINDOW_BASE = np.uint64(0xE7037ED1A0B428DB)
_PLACE_BITS = np.uint64(22)  # SLICE and a window fit in
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in ASCII_SPACE]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of the words of a text, from prefix sums over its bytes."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            size = 1 << int(n).bit_length()
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))])
                                  for b in (np.uint64(_BYTE_BASE), np.uint64(pow(_BYTE_BASE, -1, 1 << 64))))

    def words(self, text: str | bytes | None) -> np.ndarray:
        raw = np.frombuffer(text.encode() if isinstance(text, str) else text or b"", np.uint8)
        if not len(raw):
            return np.zeros(0, np.uint64)
        inside = np.concatenate([[False], ~_IS_SPACE[raw], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        out = np.empty(len(starts), np.uint64)
        low = 0
        while low < len(starts):  # whole words, about SLICE bytes at a time
            high = max(low + 1, int(np.searchsorted(ends, starts[low] + SLICE, "right")))
            base = starts[low]
            part = raw[base : ends[high - 1]].astype(np.uint64) + np.uint64(1)
            self._powers(len(part))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(part * self.up[: len(part)])])
            a, b = starts[low:high] - base, ends[low:high] - base
            out[low:high] = _mix((sums[b] - sums[a]) * self.down[a])
            low = high
        return out


def _rolling(values: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    h = np.zeros(len(values) - n + 1, np.uint64)
    for j in range(n):
        h = h * base + values[j : j + len(h)]
    return _mix(h)


def _sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of ``n`` values, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def window_anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window its anchor and the anchor's place; empty if the text is shorter than a window.

    Of n-grams whose hashes begin alike, the first of the window is taken; places never go back.
    """
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = _rolling(words, GRAM, _GRAM_BASE)
    span = window - GRAM + 1
    places = np.empty(len(grams) - span + 1, np.int64)
    low_bits = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    for low in range(0, len(places), SLICE):
        part = grams[low : low + SLICE + span - 1]
        marked = (part & ~low_bits) | np.arange(len(part), dtype=np.uint64)
        least = _sliding_min(marked, span)
        places[low : low + len(least)] = (least & low_bits).astype(np.int64) + low
    return grams[places], places


def _place_starts(places: np.ndarray) -> np.ndarray:
    """First window of each place."""
    return np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))


def greedy_factors(starts: np.ndarray, counts: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray,
                   window: int) -> list[tuple[int, int, int, int]]:
    """(start, length, ref_doc, ref_start) of the parse, from runs of windows that have a reference.

    A run is ``counts`` windows from ``starts`` that continue one reference.
    """
    order = np.argsort(starts)
    starts, counts, ref_doc, ref_start = starts[order], counts[order], ref_doc[order], ref_start[order]
    follows = ((starts[1:] == starts[:-1] + counts[:-1]) & (ref_start[1:] == ref_start[:-1] + counts[:-1])
               & (ref_doc[1:] == ref_doc[:-1]))
    first = np.concatenate([[0], np.flatnonzero(~follows) + 1]) if len(starts) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    return [(int(starts[a]), int(starts[b] + counts[b] - starts[a]) + window - 1, int(ref_doc[a]), int(ref_start[a]))
            for a, b in zip(first, last)]


def runs_of(doc: np.ndarray, start: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray) -> pa.RecordBatch:
    """(doc, start, n, ref_doc, ref_start): neighbouring windows that continue one reference as one row."""
    order = np.lexsort((start, doc))
    doc, start, ref_doc, ref_start = doc[order], start[order], ref_doc[order], ref_start[order]
    same = ((doc[1:] == doc[:-1]) & (start[1:] == start[:-1] + 1) & (ref_doc[1:] == ref_doc[:-1])
            & (ref_start[1:] == ref_start[:-1] + 1))
    first = np.flatnonzero(np.concatenate([[True], ~same])) if len(doc) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(doc)))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[first], pa.int64()), pa.array(start[first], pa.int32()), pa.array(n, pa.int32()),
         pa.array(ref_doc[first], pa.int64()), pa.array(ref_start[first], pa.int32())],
        ["doc", "start", "n", "ref_doc", "ref_start"])


RUNS = "doc long, start int, n int, ref_doc long, ref_start int"


def _packed(docs: DataFrame) -> DataFrame:
    """(doc, text) with the text compressed."""
    def pack(batches):
        from zstandard import ZstdCompressor

        press = ZstdCompressor(level=3)
        for batch in batches:
            texts = [press.compress(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc", "text"])

    return docs.mapInArrow(pack, "doc long, text binary")


def _unpacked(column: pa.Array) -> Iterator[bytes]:
    from zstandard import ZstdDecompressor

    press = ZstdDecompressor()
    for text in column:
        yield press.decompress(text.as_py()) if text.is_valid else b""


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, doc, n): distinct anchors of each document, n the number of places."""
    def compute(batches):
        hasher = Hasher()
        for batch in batches:
            found, owner, many = [], [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                anchors, places = window_anchors(hasher.words(text.as_py()), window)
                if len(anchors):
                    value, n = np.unique(anchors[_place_starts(places)], return_counts=True)
                    found.append(value.view(np.int64))
                    many.append(n)
                    owner.append(np.full(len(value), i))
            if found:
                ids = batch.column(0).take(pa.array(np.concatenate(owner)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), ids,
                                                  pa.array(np.concatenate(many), pa.int64())], ["anchor", "doc", "n"])

    return docs.mapInArrow(compute, "anchor long, doc long, n long")


def _places(asked: DataFrame, window: int) -> DataFrame:
    """(anchor, doc, start, hashes) of each place of an asked anchor: ``asked(doc, text, anchors)``.

    ``hashes`` are those of the windows that have the anchor there, the first of them at ``start``.
    """
    def compute(batches):
        hasher = Hasher()
        for batch in batches:
            for doc, text, wanted in zip(batch.column(0).to_pylist(), _unpacked(batch.column(1)), batch.column(2)):
                words = hasher.words(text)
                anchors, places = window_anchors(words, window)
                if not len(anchors):
                    continue
                first = _place_starts(places)
                n = np.diff(np.append(first, len(places)))
                hit = np.isin(anchors[first], wanted.values.to_numpy().view(np.uint64))
                if not hit.any():
                    continue
                hashes = _rolling(words, window, _WINDOW_BASE)[np.repeat(hit, n)].view(np.int64)
                first, n = first[hit], n[hit]
                offsets = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors[first].view(np.int64)), pa.array(np.full(len(first), doc, np.int64)),
                     pa.array(first, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes))],
                    ["anchor", "doc", "start", "hashes"])

    return asked.mapInArrow(compute, "anchor long, doc long, start int, hashes array<long>")


def earliest(anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, sizes: np.ndarray,
             hashes: np.ndarray) -> pa.RecordBatch:
    """Runs of the windows whose words start earlier, among whole blocks of places."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    doc, anchor = doc[row], anchor[row]
    order = np.lexsort((at, doc, hashes, anchor))
    doc, at, anchor, hashes = doc[order], at[order], anchor[order], hashes[order]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (hashes[1:] != hashes[:-1])])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (doc[first] != doc) | (at[first] != at)
    return runs_of(doc[later], at[later], doc[first][later], at[first][later])


def _solved(places: DataFrame) -> DataFrame:
    """Runs from ``places``, each anchor's block in one task."""
    def solve(batches):
        held, size = [], 0

        def columns(table):
            hashes = table.column("hashes").combine_chunks()
            return [table.column(c).to_numpy() for c in ("anchor", "doc", "start")] + [
                np.diff(hashes.offsets.to_numpy()), hashes.flatten().to_numpy()]

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < BLOCK_ROWS:
                continue
            table = pa.Table.from_batches(held)
            anchor = table.column("anchor").to_numpy()
            new = np.flatnonzero(anchor[1:] != anchor[:-1])
            if not len(new):
                continue
            cut = int(new[-1]) + 1
            yield earliest(*columns(table.slice(0, cut)))
            held, size = table.slice(cut).to_batches(), size - cut
        if size:
            yield earliest(*columns(pa.Table.from_batches(held)))

    dealt = places.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(solve, RUNS)


def _solved_hot(places: DataFrame) -> DataFrame:
    """The same for anchors with very many places: windows as rows, reduced before they are shuffled."""
    windows = places.select("anchor", "doc", "start", F.posexplode("hashes").alias("i", "hash")).select(
        "anchor", "hash", "doc", (F.col("start") + F.col("i")).alias("start"))
    least = windows.groupBy("anchor", "hash").agg(F.min(F.struct("doc", "start")).alias("first"))
    met = windows.join(least, ["anchor", "hash"])
    earlier = (F.col("first.doc") < F.col("doc")) | (
        (F.col("first.doc") == F.col("doc")) & (F.col("first.start") < F.col("start")))
    return met.where(earlier).select("doc", "start", F.lit(1).alias("n"), F.col("first.doc").alias("ref_doc"),
                                     F.col("first.start").alias("ref_start"))


def references(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc, start, n, ref_doc, ref_start): runs of windows of ``docs(doc, text)`` whose words start earlier."""
    if window < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    anchors = _anchors(docs, window)
    counts = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    met = anchors.select("anchor", "doc").join(counts, "anchor")
    hot = F.col("n") > HOT_PLACES
    asks = stored(met.groupBy("doc").agg(
        F.collect_set(F.when(~hot, F.col("anchor"))).alias("anchors"),
        F.collect_set(F.when(hot, F.col("anchor"))).alias("hot")), "rlz-anchors")

    def places(column: str) -> DataFrame:
        wanted = asks.where(F.size(column) > 0).select("doc", F.col(column).alias("anchors"))
        return _places(_packed(docs).join(wanted, "doc").select("doc", "text", "anchors"), window)

    found = _solved(places("anchors"))
    if not asks.where(F.size("hot") > 0).isEmpty():
        found = found.unionByName(_solved_hot(places("hot")))
    return found


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """One row per input row: (id, n_words, n_removed, kept, factors).

    ``kept`` is the words outside every factor joined by one space; ``factors`` are the duplicate spans as
    (start, length, ref_doc, ref_start) in words. Words are runs of anything but ASCII white space, whole
    texts, unchanged. Null and empty texts have no words; rows without an id keep their words and are no
    reference; rows that repeat an id and its text are one document, each returned; documents shorter than
    the window have no factor; other columns are not read; an empty table gives no rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    runs = references(own.where("doc IS NOT NULL AND text IS NOT NULL"), window)
    runs = stored(runs, "rlz-runs").groupBy(F.col("doc").alias("__doc")).agg(
        F.collect_set(F.struct("start", "n", "ref_doc", "ref_start")).alias("__runs"))
    joined = _packed(own.withColumn("text", F.coalesce("text", F.lit("")))).join(
        runs, F.col("doc") == F.col("__doc"), "left")

    def cut(batches):
        names = [id_col, "n_words", "n_removed", "kept", "factors"]
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "ref_doc", "ref_start")]))
        for batch in batches:
            out = [[], [], [], []]
            for text, runs in zip(_unpacked(batch.column(1)), batch.column(2)):
                words = text.split()
                factors = []
                gone = np.zeros(len(words) + 1, np.int64)
                if runs.is_valid:
                    start, n, doc, at = (runs.values.field(i).to_numpy().astype(np.int64) for i in range(4))
                    factors = greedy_factors(start, n, doc, at, window)
                    for a, length, _, _ in factors:
                        gone[a] += 1
                        gone[a + length] -= 1
                covered = np.cumsum(gone)[:-1] > 0
                kept = b" ".join([w for w, c in zip(words, covered) if not c]) if factors else b" ".join(words)
                for column, value in zip(out, (len(words), int(covered.sum()), kept, [
                        dict(zip(("start", "length", "ref_doc", "ref_start"), f)) for f in factors])):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.binary()).cast(pa.string()), pa.array(out[3], kind)], names)

    found = joined.select("doc", "text", "__runs").mapInArrow(
        cut, f"`{id_col}` long, n_words long, n_removed long, kept string, "
             "factors array<struct<start: long, length: long, ref_doc: long, ref_start: long>>")
    return found.withColumn(id_col, F.col(id_col).cast(docs.schema[id_col].dataType))
