"""Text tables: lines, assembled documents, chunks, tokens, vocabulary, n-gram sequences.

Whole texts are always processed (no prefixes, no caps). Work is per row
(explode/transform) or a group-by on the token, so it spreads over
partitions; the only per-group collection is of one document's own pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.ordering import global_index
from tessera.operators.skewjoin import split_join


def text_lines(df: DataFrame, id_cols: Sequence[str], text_col: str = "text") -> DataFrame:
    """One row per '\\n'-separated line: (*ids, line_no, line)."""
    return df.select(*id_cols, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))


def assemble(df: DataFrame, doc_col: str, part_col: str, text_col: str = "text") -> DataFrame:
    """Join a document's parts in part order with '\\n'; a missing text counts as ''."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(part_col).alias("k"),
                                                 F.coalesce(F.col(text_col), F.lit("")).alias("t"))))
    return df.groupBy(doc_col).agg(
        F.count(F.lit(1)).alias("n_parts"),
        F.array_join(F.transform(parts, lambda s: s["t"]), "\n").alias("text"),
    )


def chunks(df: DataFrame, id_col: str, text_col: str = "text", size: int = 110,
           overlap: int = 25, preview: int = 90) -> DataFrame:
    """(id, chunk_id, chunk, n_words, n_chars, preview) -- overlapping word windows."""
    # the word array is its own projected column (referenced twice, so it is
    # not inlined back into the lambda): each text is split exactly once
    words = df.select(id_col, tx.words(text_col).alias("__words"))
    exploded = words.select(id_col, F.posexplode(tx.chunks_of_words("__words", size, overlap))
                            .alias("chunk_id", "chunk"))
    return exploded.select(
        id_col, "chunk_id", "chunk",
        F.when(F.col("chunk") == "", F.lit(0)).otherwise(F.size(F.split("chunk", " "))).alias("n_words"),
        F.length("chunk").alias("n_chars"),
        F.substring("chunk", 1, preview).alias("preview"),
    )


def tokens(df: DataFrame, id_cols: Sequence[str], text_col: str = "text") -> DataFrame:
    """(*ids, pos, token) with Keras tokenisation."""
    return df.select(*id_cols, F.posexplode(tx.keras_tokens(text_col)).alias("pos", "token"))


def vocabulary(token_rows: DataFrame, order_cols: Sequence[str], token_col: str = "token",
               out: str = "token_id") -> DataFrame:
    """Word ids 1.. by frequency (desc), ties by first appearance in ``order_cols`` order.

    The count is a partially aggregated group-by; the numbering is a
    range-sorted global index, so a large vocabulary never sits in one task.
    """
    first = F.min(F.struct(*[F.col(c) for c in order_cols])).alias("first_seen")
    counts = token_rows.groupBy(token_col).agg(F.count(F.lit(1)).alias("n"), first)
    ranked = global_index(counts, [F.desc("n"), F.col("first_seen")], "__i")
    return ranked.select(token_col, "n", (F.col("__i") + 1).cast("int").alias(out))


def id_sequences(token_rows: DataFrame, vocab: DataFrame, group_cols: Sequence[str],
                 pos_col: str = "pos", token_col: str = "token", id_col: str = "token_id") -> DataFrame:
    """Re-assemble token ids per group in position order; unknown tokens are dropped.

    Frequent tokens are joined where their rows are, the others by a shuffle (``split_join``).
    """
    ids = split_join(token_rows, vocab.select(token_col, id_col), token_col)
    seq = F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(id_col).alias("i"))))
    return ids.groupBy(*group_cols).agg(F.transform(seq, lambda s: s["i"]).alias("seq"))


def prefixes(df: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Every prefix of length 2..n of each sequence (no rows when n < 2)."""
    n = F.size(seq_col)
    lengths = F.when(n >= 2, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    return df.select("*", F.explode(lengths).alias("prefix_len")).withColumn(
        "prefix", F.slice(seq_col, 1, F.col("prefix_len")))


def pad_and_cut(df: DataFrame, max_len: int, seq_col: str = "prefix") -> DataFrame:
    """Left-pad with 0 to ``max_len`` (longer keeps its tail); x = all but last, y = last."""
    n = F.size(seq_col)
    padded = F.when(n >= max_len, F.slice(seq_col, -max_len, max_len)).otherwise(
        F.concat(F.array_repeat(F.lit(0), F.lit(max_len) - n), F.col(seq_col)))
    return df.withColumn("__p", padded).withColumn("x", F.slice("__p", 1, max_len - 1)) \
        .withColumn("y", F.element_at("__p", -1)).drop("__p")
