"""Reproducible splits and mini-batches.

Randomness comes from a hash of the row id, never from ``rand()`` or
``randomSplit`` (both change with partitioning and on task retry). The hash
is Knuth's multiplicative hash done in DECIMAL(38,0), so it never overflows
and any SQL engine with 128-bit integers reproduces it exactly:

    h(id, seed) = (id * 2654435761 + seed * 40503) mod 2^32,   u = h / 2^32

Exact-size splits need a global position; that comes from
``ordering.global_index`` (range sort + per-partition offsets), never from a
single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import broadcast_if_small, global_index, rank_within

# Fixed constants of the shared hash.
HASH_MULTIPLIER = 2654435761
SEED_MULTIPLIER = 40503
HASH_MODULUS = 4294967296


def hash_bits(id_col: str | Column, seed: int = 0) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    mixed = c.cast("decimal(38,0)") * F.lit(HASH_MULTIPLIER) + F.lit(seed * SEED_MULTIPLIER)
    return F.pmod(mixed, F.lit(HASH_MODULUS).cast("decimal(38,0)")).cast("long")


def hash_unit(id_col: str | Column, seed: int = 0) -> Column:
    """Uniform-looking value in [0, 1) from an id and a seed."""
    return hash_bits(id_col, seed).cast("double") / F.lit(float(HASH_MODULUS))


def epoch_hash(id_col: str, epoch_col: str, seed: int = 0) -> Column:
    """A different permutation per epoch: h(h(id) XOR h(epoch + 1)).

    The multiplicative hash is linear, so adding the epoch would only rotate
    the order; the XOR mask makes each epoch's order a genuine reshuffle.
    """
    mask = hash_bits(F.col(epoch_col) + F.lit(1), seed)
    return hash_bits(hash_bits(id_col, seed).bitwiseXOR(mask), seed)


def sql_hash(expr: str, seed: int = 0) -> str:
    """The same hash in DuckDB SQL (HUGEINT is exact for these products)."""
    return (f"(((CAST({expr} AS HUGEINT) * {HASH_MULTIPLIER} + {seed * SEED_MULTIPLIER}) "
            f"% {HASH_MODULUS} + {HASH_MODULUS}) % {HASH_MODULUS})::BIGINT")


def hash_split(df: DataFrame, id_col: str, train_frac: float = 0.8, seed: int = 42,
               out: str = "split") -> DataFrame:
    """Bernoulli split: train when u(id, seed) < train_frac; stable under repartition."""
    return df.withColumn(out, F.when(hash_unit(id_col, seed) < F.lit(train_frac), "train").otherwise("test"))


def stratified_split(df: DataFrame, label: str, id_col: str, train_frac: float = 0.8,
                     seed: int = 42, out: str = "split") -> DataFrame:
    """Per class, the round(train_frac * n_class) rows with the smallest hash are train.

    The per-class rank is computed without a per-class window (a class may
    hold most rows): see ``ordering.rank_within``.
    """
    keyed = df.withColumn("__h", hash_bits(id_col, seed))
    ranked = rank_within(keyed, [label], ["__h", id_col], "__r")
    sizes = keyed.groupBy(F.col(label).alias("__class")).agg(F.count(F.lit(1)).alias("__n"))
    return (
        ranked.join(broadcast_if_small(sizes), F.col(label).eqNullSafe(F.col("__class"))).drop("__class")
        .withColumn(out, F.when(F.col("__r") < F.round(F.col("__n") * F.lit(train_frac)), "train")
                    .otherwise("test"))
        .drop("__h", "__r", "__n")
    )


def exact_split(df: DataFrame, id_col: str, val_frac: float = 0.15, seed: int = 7,
                out: str = "split") -> DataFrame:
    """Exactly floor(val_frac * N) rows (smallest hash first) are 'val', the rest 'train'."""
    n = df.count()
    n_val = int(val_frac * n)
    keyed = df.withColumn("__h", hash_bits(id_col, seed))
    idx = global_index(keyed, ["__h", id_col], "__i", rows=n)
    return idx.withColumn(out, F.when(F.col("__i") < n_val, "val").otherwise("train")).drop("__h", "__i")


def validation_tail(df: DataFrame, order_col: str, val_frac: float = 0.1,
                    out: str = "split") -> DataFrame:
    """The last rows in ``order_col`` order form the validation part (Keras ``validation_split``)."""
    n = df.count()
    cut = int(n * (1.0 - val_frac))
    idx = global_index(df, [order_col], "__i", rows=n)
    return idx.withColumn(out, F.when(F.col("__i") >= cut, "val").otherwise("train")).drop("__i")


def mini_batches(df: DataFrame, id_col: str, batch_size: int = 128, epochs: int = 1,
                 seed: int = 0, drop_last: bool = True) -> DataFrame:
    """(epoch, id, batch_id, pos_in_batch) with a fresh hash shuffle per epoch.

    All epochs are ranked in one range sort on (epoch, hash, id); the rank
    within the epoch is the global index minus epoch * N. With ``drop_last``
    the final partial batch is left out, as a training loader does.
    """
    n = df.count()
    epoch = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")
    per_epoch = df.select(F.col(id_col), epoch).withColumn("__h", epoch_hash(id_col, "epoch", seed))
    idx = global_index(per_epoch, ["epoch", "__h", id_col], "__i", rows=n * epochs)
    rank = F.col("__i") - F.col("epoch") * F.lit(n)
    out = idx.select(
        "epoch", id_col,
        F.floor(rank / F.lit(batch_size)).cast("long").alias("batch_id"),
        F.pmod(rank, F.lit(batch_size)).cast("long").alias("pos_in_batch"),
    )
    if drop_last:
        out = out.where(F.col("batch_id") < F.lit(n // batch_size))
    return out
