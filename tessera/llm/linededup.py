"""Line deduplication over documents that come and go.

State of an index, all of it in tables of the shared folder:

``refs``    exact references: one row per (key, document) that holds an eligible line;
``counts``  exact reference counts: key -> number of documents, largest document;
``filters`` one cuckoo filter per shard over the *repeated* keys, those that at
            least ``min_docs`` documents hold.

Inserting documents adds references, raises counts and inserts the keys that
become repeated; deleting documents takes the references away, lowers counts
and deletes from the filters the keys that are no longer repeated, so the index
is as if they had never been there. Lines are first tested against the filter
of their shard; what passes is settled by the exact counts, so a filter's false
positive never removes a line.

A key is carried as the two halves of a 128-bit hash of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from tessera.llm.common import ASCII_SPACE, stored

#: All filters of an index are sent to every task while they are at most so large; beyond it lines are
#: settled by the exact counts alone, in a shuffled join with the same result.
MAX_FILTER_BYTES = 32 << 20
#: Repeated keys a shard is sized for.
KEYS_PER_SHARD = 50_000
SLOTS = 4
MAX_KICKS = 500
_SALT = 0x9E3779B97F4A7C15
_SPACE = ASCII_SPACE.encode()


class CuckooFilter:
    """16-bit fingerprints in buckets of four; supports deletion. Keys are pairs of 64-bit hashes."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.8)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def places(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and the two buckets of each key."""
        fp = ((h2.astype(np.uint64) >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = h2.astype(np.uint64) & self.mask
        return fp, first, self.other(first, fp)

    def other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            jump = (fp.astype(np.uint64) * np.uint64(_SALT)) >> np.uint64(20)
        return (bucket ^ jump) & self.mask

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        fp, one, two = self.places(h1, h2)
        same = (self.table[one] == fp[:, None]) | (self.table[two] == fp[:, None])
        return same.any(axis=1)

    def insert(self, h1: int, h2: int) -> bool:
        """False if the key found no place; the filter is unchanged then."""
        fp, one, two = (x[0] for x in self.places(np.array([h1], np.uint64), np.array([h2], np.uint64)))
        for bucket in (one, two):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = fp
                return True
        moved, bucket = [], two
        for kick in range(MAX_KICKS):
            slot = (int(fp) + kick) % SLOTS
            moved.append((bucket, slot, self.table[bucket, slot]))
            fp, self.table[bucket, slot] = self.table[bucket, slot], fp
            bucket = self.other(np.array([bucket], np.uint64), np.array([fp], np.uint16))[0]
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = fp
                return True
        for at, slot, old in reversed(moved):
            self.table[at, slot] = old
        return False

    def delete(self, h1: int, h2: int) -> bool:
        """Remove one copy of a key that was inserted; False if its fingerprint is nowhere."""
        fp, one, two = (x[0] for x in self.places(np.array([h1], np.uint64), np.array([h2], np.uint64)))
        for bucket in (one, two):
            slots = np.flatnonzero(self.table[bucket] == fp)
            if len(slots):
                self.table[bucket, slots[0]] = 0
                return True
        return False

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray, room: int = 0) -> CuckooFilter:
        """A filter that holds all the keys: the table doubles until each finds a place."""
        made = cls.sized(max(len(h1), room))
        for a, b in zip(h1.astype(np.uint64), h2.astype(np.uint64)):
            if not made.insert(a, b):
                return cls.of(h1, h2, max(len(h1), room) * 2 + 4 * SLOTS)
        return made


@dataclass(frozen=True)
class LineIndex:
    """Tables of an index; see the module's text. ``shards`` and the limits are fixed when it is built."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int
    id_col: str
    text_col: str


def eligible(lines: list[bytes], min_chars: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Places of the lines whose key has at least ``min_chars`` code points, and both halves of the keys' hashes.

    A key is the line without ASCII white space at its ends, A-Z lower-cased.
    """
    places, digests = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(_SPACE).lower()
            if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                places.append(i)
                digests.append(xxh3_128_digest(key))
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return places, halves[:, 0], halves[:, 1]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for text in batch.column(column).cast(pa.binary()):
        yield text.as_py() or b""


def _held_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, wanted=None) -> DataFrame:
    """(h1, h2, doc) of the eligible lines, once per document; ``wanted(h1, h2)`` picks among them.

    Rows without an id are no document of the index.
    """
    def found(batches):
        picks = wanted() if wanted else None
        for batch in batches:
            h1s, h2s, owner = [], [], []
            for i, text in enumerate(_texts(batch, 1)):
                _, h1, h2 = eligible(text.split(b"\n"), min_chars)
                if len(h1):
                    keys = np.unique(np.stack([h1, h2], axis=1), axis=0) if len(h1) > 1 else np.stack([h1, h2], axis=1)
                    h1s.append(keys[:, 0])
                    h2s.append(keys[:, 1])
                    owner.append(np.full(len(keys), i))
            if h1s:
                h1, h2, at = map(np.concatenate, (h1s, h2s, owner))
                if picks:
                    hit = picks(h1, h2)
                    h1, h2, at = h1[hit], h2[hit], at[hit]
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), batch.column(0).take(pa.array(at))],
                                                 ["h1", "h2", "doc"])

    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), text_col)
    return own.mapInArrow(found, "h1 long, h2 long, doc long")


def _count(refs: DataFrame) -> DataFrame:
    return refs.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))


def _shard(shards: int) -> Column:
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int")


def _filters(repeated: DataFrame, shards: int) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        made = CuckooFilter.of(pdf.h1.to_numpy().view(np.uint64), pdf.h2.to_numpy().view(np.uint64))
        return pd.DataFrame({"shard": [pdf.shard.iloc[0]], "cells": [made.dump()]})

    keys = repeated.select(_shard(shards).alias("shard"), "h1", "h2")
    return keys.groupBy("shard").applyInPandas(one, "shard int, cells binary")


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5,
          min_chars: int = 40) -> LineIndex:
    """Index of the lines of ``docs``. Null and empty texts hold no eligible line.

    Rows that repeat an id are one document; rows without an id are not indexed.
    """
    refs = stored(_held_lines(docs, id_col, text_col, min_chars).distinct(), "line-refs")
    counts = stored(_count(refs), "line-counts")
    repeated = counts.where(F.col("n_docs") >= min_docs)
    shards = max(1, -(-repeated.count() // KEYS_PER_SHARD))
    return LineIndex(refs, counts, stored(_filters(repeated, shards), "line-filters"), shards, min_docs, min_chars,
                     id_col, text_col)


def _updated(index: LineIndex, refs: DataFrame, touched: DataFrame) -> LineIndex:
    """The index after ``refs`` changed at the keys of ``touched``: only these are counted again."""
    keys = stored(touched.select("h1", "h2").distinct(), "line-touched")
    old = index.counts.join(keys, ["h1", "h2"], "left_semi")
    new = _count(refs.join(keys, ["h1", "h2"], "left_semi"))
    kept = index.counts.join(keys, ["h1", "h2"], "left_anti")
    counts = stored(kept.unionByName(new), "line-counts")
    before = old.where(F.col("n_docs") >= index.min_docs).select("h1", "h2")
    after = counts.join(keys, ["h1", "h2"], "left_semi").where(F.col("n_docs") >= index.min_docs).select("h1", "h2")
    change = after.exceptAll(before).withColumn("add", F.lit(True)).unionByName(
        before.exceptAll(after).withColumn("add", F.lit(False)))
    change = change.withColumn("shard", _shard(index.shards))

    def one(key, cells: pd.DataFrame, ops: pd.DataFrame) -> pd.DataFrame:
        held = CuckooFilter.load(cells.cells.iloc[0]) if len(cells) else CuckooFilter.sized(len(ops))
        for gone in (True, False):  # deletions first: they make room
            for h1, h2, add in zip(ops.h1, ops.h2, ops["add"]):
                if add == gone:
                    continue
                a, b = np.int64(h1).view(np.uint64), np.int64(h2).view(np.uint64)
                if not (held.insert(a, b) if add else held.delete(a, b)):
                    return pd.DataFrame({"shard": [key[0]], "cells": [None]})  # full: built anew below
        return pd.DataFrame({"shard": [key[0]], "cells": [held.dump()]})

    tried = stored(index.filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(
        one, "shard int, cells binary"), "line-filters")
    filters = tried.where("cells IS NOT NULL")
    if full := [r["shard"] for r in tried.where("cells IS NULL").select("shard").collect()]:
        again = counts.where((F.col("n_docs") >= index.min_docs) & _shard(index.shards).isin(full))
        filters = stored(filters.unionByName(_filters(again, index.shards)), "line-filters")
    return replace(index, refs=refs, counts=counts, filters=filters)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with ``docs`` added. Documents that it already holds gain the lines that are new to them."""
    found = _held_lines(docs, index.id_col, index.text_col, index.min_chars).distinct()
    new = stored(found.join(index.refs, ["h1", "h2", "doc"], "left_anti"), "line-refs")
    return _updated(index, index.refs.unionByName(new), new)


def delete(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents of ``ids(id_col)``; unknown and null ids change nothing."""
    gone = ids.select(F.col(index.id_col).cast("long").alias("doc")).where("doc IS NOT NULL").distinct()
    lost = stored(index.refs.join(gone, "doc", "left_semi").select("h1", "h2", "doc"), "line-refs")
    left = stored(index.refs.join(lost, ["h1", "h2", "doc"], "left_anti").select("h1", "h2", "doc"), "line-refs")
    return _updated(index, left, lost)


def _candidates(index: LineIndex, docs: DataFrame) -> DataFrame:
    """(h1, h2, doc) of the eligible lines of ``docs``, only those that the filters let through."""
    total = index.filters.agg(F.coalesce(F.sum(F.length("cells")), F.lit(0))).first()[0]
    pick = None
    if total <= MAX_FILTER_BYTES:
        held = {r["shard"]: bytes(r["cells"]) for r in index.filters.collect()}  # MAX_FILTER_BYTES at most
        sent, shards = docs.sparkSession.sparkContext.broadcast(held), index.shards

        def pick():
            filters = {k: CuckooFilter.load(v) for k, v in sent.value.items()}

            def probe(h1, h2):
                shard, hit = np.mod(h1, shards), np.zeros(len(h1), bool)
                for k, keys in filters.items():
                    own = np.flatnonzero(shard == k)
                    if len(own):
                        hit[own] = keys.contains(h1[own].view(np.uint64), h2[own].view(np.uint64))
                return hit

            return probe

    return _held_lines(docs, index.id_col, index.text_col, index.min_chars, pick)


def drop_repeated(index: LineIndex, docs: DataFrame,
                  added: tuple[str, str, str] = ("n_lines", "n_dropped", "kept")) -> DataFrame:
    """``docs`` with three more columns: its lines, how many of them go, and the kept text.

    A line goes if its key is repeated in the index and another document with a larger id holds it.
    Null texts count as one empty line and become the empty text; rows without an id keep every line;
    repeated rows are treated alike. The texts are shuffled once, to meet their lists of lost lines;
    lists are bounded by the lines of one document. Input columns that are named like ``added`` are replaced.
    """
    repeated = index.counts.where(F.col("n_docs") >= index.min_docs).select("h1", "h2", "last_doc")
    lost = _candidates(index, docs).join(repeated, ["h1", "h2"]).where("doc <> last_doc")
    lost = lost.groupBy(F.col("doc").alias("__doc")).agg(
        F.collect_set(F.concat_ws(",", F.col("h1").cast("string"), F.col("h2").cast("string"))).alias("__lost"))
    kept_cols = [c for c in docs.columns if c not in added]
    text_at, lost_at = kept_cols.index(index.text_col), len(kept_cols)
    joined = docs.select(kept_cols).join(lost, docs[index.id_col].cast("long") == F.col("__doc"), "left")
    schema = docs.select(kept_cols).schema.add(added[0], "long").add(added[1], "long").add(added[2], "string")
    min_chars = index.min_chars

    def drop(batches):
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, gone in zip(_texts(batch, text_at), batch.column(lost_at)):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if gone.is_valid:
                    keys = set(gone.as_py())
                    places, h1, h2 = eligible(lines, min_chars)
                    out = {i for i, a, b in zip(places, h1.tolist(), h2.tolist()) if f"{a},{b}" in keys}
                    text = b"\n".join([x for i, x in enumerate(lines) if i not in out])
                    n_dropped.append(len(out))
                else:
                    n_dropped.append(0)
                kept.append(text)
            new = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                   pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept_cols)], *new], schema.names)

    return joined.select(*[joined[c] for c in kept_cols], "__lost").mapInArrow(drop, schema)
