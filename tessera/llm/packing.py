"""Harmonic packing of token sequences.

A class ``k`` takes the pieces of at most ``capacity / k`` tokens (and more than
``capacity / (k + 1)``), and every bin of the class is filled with exactly ``k``
of them. Documents may be cut, so each is cut into full bins and, for the rest,
into pieces whose lengths are the exact reciprocals ``capacity / 2**j``: these
fill the bins of their class without a gap. What a worker has left over at its
end (fewer than ``k`` pieces of a class) goes to shorter bins of a power of two,
which need no padding either.

Each worker (an input partition) packs what it reads, alone and in one pass:
no shuffle, no global counter. A sequence id is the partition's number and a
counter in it, so a task that runs again writes the same ids.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Sequences of one partition are numbered from ``partition << PARTITION_SHIFT``.
PARTITION_SHIFT = 40
#: The one special string of the byte-level vocabularies.
END_OF_TEXT = "<|endoftext|>"
SCHEMA = ("{id} {id_type}, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


class Harmonic:
    """Bins of one worker. ``add`` returns the pieces of the bins that it closes; ``close`` the rest.

    A piece is ``(length, payload)``; what comes back is ``(payload, bin, offset)``. Lengths must be
    from 1 to ``capacity``. Any length is accepted: a class ``k = capacity // length`` mixes lengths
    between the reciprocals, its bins hold ``k`` pieces and the gap is padding.
    """

    def __init__(self, capacity: int, first_bin: int = 0):
        self.capacity, self.next_bin = capacity, first_bin
        self.open: dict[int, list[tuple[int, object]]] = {}

    def _close(self, pieces: list[tuple[int, object]]) -> list[tuple[object, int, int]]:
        number, at, out = self.next_bin, 0, []
        self.next_bin += 1
        for length, payload in pieces:
            out.append((payload, number, at))
            at += length
        return out

    def add(self, length: int, payload: object) -> list[tuple[object, int, int]]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece has 1 to {self.capacity} tokens, not {length}")
        k = self.capacity // length
        pieces = self.open.setdefault(k, [])
        pieces.append((length, payload))
        if len(pieces) < k:
            return []
        self.open[k] = []
        return self._close(pieces)

    def close(self) -> list[tuple[object, int, int]]:
        """Leftovers, in bins that hold a power of two pieces of a class: 5 pieces make bins of 4 and 1."""
        out = []
        for k in sorted(self.open):
            pieces = self.open[k]
            while pieces:
                take = 1 << (len(pieces).bit_length() - 1)
                out += self._close(pieces[:take])
                pieces = pieces[take:]
        self.open = {}
        return out


def cuts(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole bins, then the binary digits of the rest."""
    start = 0
    while n - start >= capacity:
        yield start, capacity
        start += capacity
    part = capacity
    while start < n:
        part >>= 1
        if n - start >= part:
            yield start, part
            start += part


class Encoder:
    """Byte-level BPE of ``public_tokenizers``. ``specials`` names the strings that are one id; others are plain text.

    ``tiktoken`` reads the same vocabulary several times faster than ``tokenizers``, but its pattern matcher gives up
    on very long runs of white space; such a text goes to ``tokenizers``. Tests hold both against each other.
    """

    def __init__(self, name: str, specials: bool = False):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.name, self.specials, self.whole = name, specials, None
        known = {END_OF_TEXT: len(self.ranks)} if specials else {}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens=known)

    def _whole(self, text: str) -> list[int]:
        if self.whole is None:
            import public_tokenizers
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(public_tokenizers.path(f"{self.name}.json"))
            self.whole.encode_special_tokens = not self.specials
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, allowed_special="all" if self.specials else set(), disallowed_special=())
        except ValueError:
            return self._whole(text)

    def to_numpy(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all" if self.specials else set(), disallowed_special=())
        except ValueError:
            return np.array(self._whole(text), np.uint32)


def load_encoder(name: str, specials: bool = False) -> Encoder:
    return Encoder(name, specials)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024,
                   vocabulary: str = "byte_bpe_50k", end_id: int = 0) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its tokens and ``end_id``. ``capacity`` must be a power of two. Null text counts as
    empty (one piece that holds ``end_id``), null ids are carried, repeated rows are packed each,
    other columns are not read, an empty table gives no rows. ``<|endoftext|>`` inside a text is its one id,
    as ``tokenizers`` has it. A very long text, one of white space too, is cut like any other;
    memory holds one Arrow batch and, per class, the pieces of one open bin.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    id_type = docs.schema[id_col].dataType.simpleString()

    def pack(batches):
        from pyspark import TaskContext

        encoder = load_encoder(vocabulary, specials=True)
        bins = Harmonic(capacity, TaskContext.get().partitionId() << PARTITION_SHIFT)
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        kinds = None

        def rows(placed):
            columns = list(zip(*((*payload, number, at) for payload, number, at in placed)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        for batch in batches:
            kinds = kinds or [batch.schema.field(0).type, *[pa.int64()] * 6]
            placed = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids = np.append(encoder.to_numpy(text), np.uint32(end_id)).astype("<u4")
                raw, n = memoryview(ids).cast("B"), len(ids)
                for start, length in cuts(n, capacity):
                    crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                    placed += bins.add(length, (doc, start, length, crc, n))
                if len(placed) >= 50_000:
                    yield rows(placed)
                    placed = []
            if placed:
                yield rows(placed)
        if rest := bins.close():
            yield rows(rest)

    return docs.select(id_col, text_col).mapInArrow(pack, SCHEMA.format(id=f"`{id_col}`", id_type=id_type))
