"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a hash, read as a number ``u`` in (0, 1); the record goes to the shard with the
highest ``weight / -ln(u)``. A shard so gets its share of the weights, and the choice depends on the key and
the list of shards alone: one more shard takes rows only into itself (the scores of the others stay as they
are), one shard less gives up only its own rows. The hash is MD5, so any engine finds the same shard again.

Choosing needs no shuffle. Slots inside a shard come from one range sort of narrow rows (no texts), because a
window over a shard would hold a share of all rows that does not shrink with more machines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.operators.ordering import rank_within

#: Hex digits of the MD5 that make the number; 13 are 52 bits, which a double holds exactly.
DIGITS = 13


def key_of(*cols: str) -> Column:
    """The key as text: one column as it is, several each with its length before it. Null counts as empty."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    if len(texts) == 1:
        return texts[0]
    return F.concat(*[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts])


def _score(key: Column, shard: Column, weight: Column) -> Column:
    digest = F.md5(F.concat(key, F.lit("/"), shard.cast("string")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / F.lit(16.0**DIGITS)
    return weight / -F.ln(u)


def _best(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """(score, rank) of the best of the shards ``first``, ``first + 1``, ...; rank is minus the shard's number."""
    shards = F.array(*[F.struct(F.lit(first + i).alias("shard"), F.lit(float(w)).alias("weight"))
                       for i, w in enumerate(weights)])
    return F.array_max(F.transform(shards, lambda s: F.struct(
        _score(key, s["shard"], s["weight"]).alias("score"), (-s["shard"]).alias("rank"))))


def assign(records: DataFrame, key: Column, weights: Sequence[float], added: Sequence[float] = (),
           shard_col: str = "shard", grown_col: str = "grown_shard") -> DataFrame:
    """``records`` with their shard, and the one they would have if shards with the weights ``added`` joined.

    Shards are numbered in the order of ``weights``. Weights are finite and not negative, with a positive one
    among the first; a shard of weight 0 gets no row. A tie of scores goes to the smaller number. Rows with the
    same key go together; a null key is an empty one. Columns that have the new names are replaced.
    """
    if not weights or max(weights) <= 0 or any(not 0 <= w < float("inf") for w in [*weights, *added]):
        raise ValueError("weights must be finite, not negative, and one of the shards must have a positive one")
    kept = [c for c in records.columns if c not in (shard_col, grown_col)]
    staged = records.select(*kept, key.alias("__key")).withColumn("__best", _best(F.col("__key"), weights))
    grown = F.col("__best")
    if added:
        staged = staged.withColumn("__more", F.greatest("__best", _best(F.col("__key"), added, len(weights))))
        grown = F.col("__more")
    return staged.select(*kept, (-F.col("__best.rank")).cast("int").alias(shard_col),
                         (-grown["rank"]).cast("int").alias(grown_col))


def shard_documents(docs: DataFrame, weights: Sequence[float], added: Sequence[float] = (1.0,), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 bytes of the text plus 1. Slots count from 0 in each shard without a gap, in the order
    of id (null first), size and checksum; rows alike in all of these are interchangeable. A null text counts as
    empty, a null id as the empty key; rows that repeat an id share a shard and have a slot each. Other columns
    are not read; an empty table gives no rows. The range sort that numbers the slots orders by a row's place in
    the input last, so that no key, however frequent, has to fit one task.
    """
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    narrow = docs.select(F.col(id_col), (F.octet_length(raw) + 1).cast("long").alias("__size"),
                         F.crc32(raw).alias("__crc"), F.monotonically_increasing_id().alias("__row"))
    placed = stored(assign(narrow, key_of(id_col), weights, added, "__shard", "__grown"), "shards")
    ranked = rank_within(placed, ["__shard"], [id_col, "__size", "__crc", "__row"], "__slot")
    return ranked.select(id_col, F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"),
                         F.lit("key").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"),
                         F.col("__grown").alias("grown_shard"))


def write_shards(records: DataFrame, key: Column, weights: Sequence[float], path: str, rows_per_file: int = 1_000_000) -> None:
    """``records`` as Parquet in one folder a shard (``shard=0``, ``shard=1``, ...), in files of bounded size.

    Every task writes the rows that it reads into the folders of their shards, so no shard passes one task.
    """
    assign(records, key, weights).drop("grown_shard").write.option("maxRecordsPerFile", rows_per_file).partitionBy(
        "shard").parquet(path)
