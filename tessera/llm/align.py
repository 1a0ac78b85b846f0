"""Alignment of two public tokenizers over a corpus, each distinct text tokenised once.

1. Texts are shuffled by their full text and counted, so copies are one row with a multiplicity (a hot text is
   counted in every task before it moves).
2. Each distinct text is encoded by a byte-level BPE (A, of a space and the text) and by a piece BPE (B, which adds
   the space). Both cut the same bytes, so their ends, put together, give the groups (ends that both have) and the
   links (each stretch between neighbouring ends lies in one token of each). A text's own results and its linked id
   pairs are written once.
3. The pairs are counted over all texts, weighted by multiplicity, and each pair learns whether it is the most
   frequent of its A id.
4. Every text's pairs are held against these counts. They are broadcast in blocks of ``BLOCK_PAIRS`` pairs by range
   of the A id; sums over links add up over blocks. The number of blocks is bounded by the vocabularies, not the corpus.
5. The measures are joined to the documents by the SHA-256 of the text; the most frequent texts in a broadcast of
   bounded size, all others in a shuffle in which no key is hot.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.llm.packing import load_encoder

#: Text bytes that one numpy step aligns (a longer text is one step), pairs in one broadcast, most texts taken as hot.
SLICE_BYTES = 2 << 20
BLOCK_PAIRS = 2_000_000
HOT_TEXTS, HOT_COPIES = 20_000, 1_000
_TEXT_SCHEMA = ("sha binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                "pairs array<long>, times array<int>")


class Tokens:
    """Encoder of one vocabulary with the bytes of its entries."""

    def __init__(self, entries: list[bytes], encode):
        self.encode = encode
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(entries), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the entries ``ids``, joined."""
        lengths = self.lengths[ids]
        before = np.cumsum(lengths) - lengths
        return self.pool[np.arange(lengths.sum()) + np.repeat(self.starts[ids] - before, lengths)]


@functools.cache
def byte_level(name: str) -> Tokens:
    """Byte-level BPE; special strings are plain text."""
    encoder = load_encoder(name)
    entries = [b""] * (max(encoder.ranks.values()) + 1)
    for token, number in encoder.ranks.items():
        entries[number] = token
    return Tokens(entries, lambda texts: [encoder.to_numpy(" " + t) for t in texts])


@functools.cache
def piece_level(name: str) -> Tokens:
    """Piece BPE with byte fallback; it puts a space before the text itself."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    entries = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        entries.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return Tokens(entries, lambda texts: [np.array(ids, np.uint32) for ids in model.encode(texts, num_threads=1)])


@functools.cache
def _written(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of "i,", "i|" and "i;" for every i below ``n``, at i, n + i and 2 n + i."""
    forms = [f"{i}{sep}".encode() for sep in ",|;" for i in range(n)]
    widest = max(map(len, forms))
    table = np.frombuffer(b"".join(f.ljust(widest) for f in forms), np.uint8).reshape(-1, widest)
    return table, np.array([len(f) for f in forms])


def align(texts: list[str], a: Tokens, b: Tokens) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each text, pairs as ``a id * |B| + b id``, ascending."""
    raw = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    own, ids_a, ids_b = [], [], []
    for i, (whole, x, y) in enumerate(zip(raw, a.encode(texts), b.encode(texts))):
        if whole and a.spelled(x).tobytes() == whole and b.spelled(y).tobytes() == whole:
            own.append(i)
            ids_a.append(x)
            ids_b.append(y)
    out: list[tuple] = [(0, 0, 0, 0, "", [], [])] * len(texts)
    if not own:
        return out
    n_a, n_b = (np.array([len(x) for x in ids]) for ids in (ids_a, ids_b))
    ids_a, ids_b = np.concatenate(ids_a).astype(np.int64), np.concatenate(ids_b).astype(np.int64)
    # one line of bytes for all texts, with the ends of both marked; where a text ends, both end
    ends_a, ends_b = np.cumsum(a.lengths[ids_a]) - 1, np.cumsum(b.lengths[ids_b]) - 1
    size = ends_a[-1] + 1
    mark_a, mark_b = np.zeros(size, bool), np.zeros(size, bool)
    mark_a[ends_a], mark_b[ends_b] = True, True
    stretches = np.flatnonzero(mark_a | mark_b)
    in_a, in_b = mark_a[stretches], mark_b[stretches]
    at_a, at_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b  # the tokens that a stretch lies in
    both = in_a & in_b
    group = np.cumsum(both) - both
    group_a, group_b = group[in_a], group[in_b]  # of every token, counted through
    text_of_link = np.repeat(np.arange(len(own)), n_a)[at_a]
    groups = np.bincount(text_of_link, both, len(own)).astype(np.int64)
    links = np.bincount(text_of_link, minlength=len(own))
    # written form: the A ids of a group, then its B ids
    n_groups = group[-1] + 1
    before_a = np.concatenate([[0], np.cumsum(np.bincount(group_a, minlength=n_groups))])
    before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n_groups))])
    known = max(len(a.lengths), len(b.lengths))
    line = np.empty(len(ids_a) + len(ids_b), np.int64)
    line[np.arange(len(ids_a)) + before_b[group_a]] = ids_a + known * mark_b[ends_a]
    line[np.arange(len(ids_b)) + before_a[group_b + 1]] = ids_b + 2 * known * mark_a[ends_b]
    forms, widths = _written(known)
    widths = widths[line]
    written = forms[line][np.arange(forms.shape[1]) < widths[:, None]].tobytes()
    bounds = np.concatenate([[0], np.cumsum(widths)])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
    # distinct pairs of each text
    code = len(a.lengths) * len(b.lengths)
    keys = np.sort(text_of_link * code + ids_a[at_a] * len(b.lengths) + ids_b[at_b])
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    times = np.diff(np.append(starts, len(keys)))
    text_of_pair, pair = np.divmod(keys[starts], code)
    cuts = np.searchsorted(text_of_pair, np.arange(len(own) + 1)).tolist()
    for k, (i, *counts) in enumerate(zip(own, n_a.tolist(), n_b.tolist(), groups.tolist(), links.tolist())):
        sha = hashlib.sha256(written[bounds[k] : bounds[k + 1] - 1]).hexdigest()
        out[i] = (*counts, sha, pair[cuts[k] : cuts[k + 1]], times[cuts[k] : cuts[k + 1]])
    return out


def _slices(sizes: list[int]):
    """(start, end) of runs of rows with about ``SLICE_BYTES``; a longer row is a run of its own."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE_BYTES:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def align_texts(texts: DataFrame, vocabulary_a: str, vocabulary_b: str) -> DataFrame:
    """The alignment of every row of ``texts(text, copies)``; ``sha`` is the SHA-256 of the text."""

    def run(batches):
        a, b = byte_level(vocabulary_a), piece_level(vocabulary_b)
        names = ["sha", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
        for batch in batches:
            copies = batch.column(1).to_pylist()
            sizes = pa.compute.binary_length(batch.column(0)).to_pylist()
            for start, end in _slices(sizes):
                part = batch.column(0).slice(start, end - start).to_pylist()
                found = align(part, a, b)
                flat = [pa.array([f[c] for f in found], t) for c, t in
                        enumerate([pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())])]
                sha = pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in part], pa.binary())
                yield pa.RecordBatch.from_arrays([sha, pa.array(copies[start:end], pa.int64()), *flat], names)

    import pyarrow.compute  # noqa: F401  (loaded with the function)

    return texts.mapInArrow(run, _TEXT_SCHEMA)


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, is_best): documents that hold the pair linked, and whether no pair of its A id has more."""
    counts = aligned.select("copies", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("copies").alias("n"))
    counts = stored(counts.withColumn("a", F.floor(F.col("pair") / F.lit(n_b)).cast("int")), "align-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("top"))
    return stored(counts.join(best, "a").select("a", "pair", "n", (F.col("n") == F.col("top")).alias("is_best")), "align-pairs")


def _blocks(counts: DataFrame) -> list[tuple[int, int]]:
    """Ranges [low, high) of A ids, each with about ``BLOCK_PAIRS`` pairs; one A id has at most |B| of them."""
    per = counts.groupBy("a").count().orderBy("a").collect()  # at most a row per A id
    out, low, held = [], 0, 0
    for r in per:
        if held and held + r["count"] > BLOCK_PAIRS:
            out.append((low, r["a"]))
            low, held = r["a"], 0
        held += r["count"]
    return [*out, (low, per[-1]["a"] + 1)] if per else []


def text_measures(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """(sha, n_best, count_sum) of every text that has links."""
    spark = aligned.sparkSession
    parts = None
    for low, high in _blocks(counts):
        table = counts.where((F.col("a") >= low) & (F.col("a") < high)).select("pair", "n", "is_best").toArrow().sort_by("pair")
        sent = spark.sparkContext.broadcast(tuple(c.to_numpy() for c in table.columns))  # about BLOCK_PAIRS rows

        def look_up(batches, sent=sent):
            known, n, best = sent.value
            for batch in batches:
                lists = batch.column(1)
                pairs = lists.flatten().to_numpy()
                times = batch.column(2).flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
                at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                hit = known[at] == pairs
                at, row, times = at[hit], row[hit], times[hit]
                sums = [np.zeros(len(batch), np.int64) for _ in range(2)]
                np.add.at(sums[0], row, times * best[at])
                np.add.at(sums[1], row, times * n[at])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums[0]), pa.array(sums[1])],
                                                 ["sha", "n_best", "count_sum"])

        part = aligned.where("n_links > 0").select("sha", "pairs", "times").mapInArrow(
            look_up, "sha binary, n_best long, count_sum long")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return spark.createDataFrame([], "sha binary, n_best long, count_sum long")
    return parts.groupBy("sha").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_documents(docs: DataFrame, vocabulary_a: str = "byte_bpe_50k", vocabulary_b: str = "piece_bpe_32k.model",
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, and one whose tokens do not spell a space and the text, has zeros and ''. Rows that repeat
    an id or a text are counted and returned each, null ids too; other columns are not read; an empty table gives no
    rows. A text is encoded whole and must fit a task, as must its tokens.
    """
    given = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    texts = given.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    aligned = stored(align_texts(texts.select("text", "copies"), vocabulary_a, vocabulary_b), "align-texts")
    counts = pair_counts(aligned, len(piece_level(vocabulary_b).lengths))
    own = aligned.select("sha", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    measures = stored(own.join(text_measures(aligned, counts).withColumnRenamed("sha", "__sha"),
                               F.col("sha") == F.col("__sha"), "left").drop("__sha"), "align-measures")
    total = measures.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("copies") > max(HOT_COPIES, total // HOT_TEXTS)  # so fewer than HOT_TEXTS texts are
    named = given.select("__id", F.when(F.col("text") != "", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).alias("__sha"))
    first = measures.where(hot).select(F.struct(*[c for c in measures.columns if c != "sha"]).alias("__hot"), F.col("sha").alias("__s1"))
    rest = measures.where(~hot).select(F.struct(*[c for c in measures.columns if c != "sha"]).alias("__rest"), F.col("sha").alias("__s2"))
    met = named.join(F.broadcast(first), F.col("__sha") == F.col("__s1"), "left")
    # hot rows are settled, as are those without a text: they are dealt by their place instead
    key = F.coalesce(F.when(F.col("__hot").isNull(), F.col("__sha")),
                     F.md5(F.monotonically_increasing_id().cast("string").cast("binary")).cast("binary"))
    met = met.withColumn("__key", key).join(rest, F.col("__key") == F.col("__s2"), "left")
    got = F.coalesce("__hot", "__rest")
    numbers = [F.coalesce(got[c], F.lit(0)).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return met.select(F.col("__id").alias(id_col), *numbers, F.coalesce(got["groups_sha256"], F.lit("")).alias("groups_sha256"))
