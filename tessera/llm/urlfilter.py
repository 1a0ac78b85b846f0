"""URL rules judged by a cascade of Bloom filters.

The listed keys are rules ``host/path-prefix``. The key universe is every key
that a URL of the corpus can ask for: its host and the suffixes of its host,
joined to the prefixes of its path. Level 1 of a cascade encodes the listed
keys; level 2 the keys of the universe that level 1 lets through wrongly;
level 3 the listed keys that level 2 lets through, and so on until a level has
no error left. For a key of the universe the first level that rejects it then
tells exactly whether it is listed, so URLs are judged by bit tests in one
projection: no join, no shuffle, no Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, stored

#: A level's bits travel as a literal of the plan; larger levels are refused (``ListTooLarge``).
MAX_LEVEL_BYTES = 4 << 20
#: Bits used of each byte: the literal stays ASCII, so that a byte can be read as a character.
BITS = 7
#: Part of the strangers that levels after the first let through.
LATER_ERROR = 0.5


class ListTooLarge(ValueError):
    """A level would be larger than ``MAX_LEVEL_BYTES``; split the rules by host and judge each part."""


@dataclass(frozen=True)
class Level:
    seed: int
    n_bits: int
    n_hashes: int
    bits: bytes

    def positions(self, key: Column) -> list[Column]:
        return _positions(key, self.seed, self.n_bits, self.n_hashes)

    def has(self, key: Column) -> Column:
        test = F.lit(True)
        for at in self.positions(key):
            byte = F.substring(F.lit(self.bits), (at / BITS).cast("int") + 1, F.lit(1)).cast("string")
            test = test & (F.getbit(F.ascii(byte), F.pmod(at, F.lit(BITS))) == 1)
        return test


def _positions(key: Column, seed: int, n_bits: int, n_hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed * 64 + i), key), F.lit(n_bits)).cast("int") for i in range(n_hashes)]


def _level(keys: DataFrame, n: int, error: float, seed: int) -> Level:
    """The filter of ``keys(key)``: bits are gathered by byte, so that what is collected is the filter."""
    n_hashes = max(1, round(-math.log2(error)))
    n_bits = max(64, math.ceil(n * n_hashes / math.log(2)))
    if n_bits / BITS > MAX_LEVEL_BYTES:
        raise ListTooLarge(f"{n} keys need {n_bits} bits")
    bits = bytearray(n_bits // BITS + 1)
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), seed, n_bits, n_hashes))).alias("at"))
    byte = at.groupBy((F.col("at") / BITS).cast("int").alias("byte")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod("at", F.lit(BITS)))).alias("value"))
    for row in byte.collect():  # at most MAX_LEVEL_BYTES rows
        bits[row["byte"]] = row["value"]
    return Level(seed, n_bits, n_hashes, bytes(bits))


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels for ``listed(key)`` that are exact over every key of ``universe(key)``.

    ``universe`` may repeat keys; it is read twice (a size estimate, then the test of level 1). Only
    keys that pass level 1 are kept, about as many as are listed. An empty list gives no level.
    """
    listed = stored(listed.where("key IS NOT NULL").distinct(), "listed")
    n = listed.count()
    if n == 0:
        return []
    size = universe.agg(F.approx_count_distinct("key")).first()[0]  # sizes level 1; exactness needs no count
    error = min(LATER_ERROR, max(n / max(size, 1), 2.0**-20))
    levels = [_level(listed, n, error, 1)]
    passed = universe.where(levels[0].has(F.col("key"))).select("key", F.lit(0).alias("is_listed"))
    marked = passed.unionByName(listed.withColumn("is_listed", F.lit(1)))
    marked = stored(marked.groupBy("key").agg(F.max("is_listed").alias("is_listed")), "cascade")
    inside, wrong = listed, marked.where("is_listed = 0").select("key")
    while n_wrong := wrong.count():
        levels.append(_level(wrong, n_wrong, LATER_ERROR, len(levels) + 1))
        inside, wrong = wrong, inside.where(levels[-1].has(F.col("key")))
    return levels


def is_listed(key: Column, levels: Sequence[Level]) -> Column:
    """Exact for keys of the cascade's universe: the level at which the key first fails decides."""
    answer = F.lit(len(levels) % 2 == 1)
    for depth in range(len(levels) - 1, -1, -1):
        answer = F.when(~levels[depth].has(key), F.lit(depth % 2 == 1)).otherwise(answer)
    return answer


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def shapes_of(rules: Sequence[tuple[str, str, str]]) -> list[tuple[int, int]]:
    """Distinct (host length, path length) of the rules, longest rule first, then longest host."""
    shapes = {(len(host), len(path)) for _, host, path in rules}
    return sorted(shapes, key=lambda s: (-(s[0] + s[1]), -s[0]))


def key_of(shape: tuple[int, int], host: Column, path: Column) -> Column:
    """The key of this shape that a URL asks for, null if it has none.

    The last characters of the host count only when they are the whole host or follow a dot.
    """
    n_host, n_path = shape
    before = F.length(host) - n_host
    whole = (before == 0) | ((before > 0) & (F.substring(host, before, F.lit(1)) == "."))
    fits = whole & (F.length(path) >= n_path)
    tail = F.substring(host, before + 1, F.lit(n_host))
    return F.when(fits, F.concat(tail, F.substring(path, 1, n_path)))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id",
          url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every page; ``rules`` are (verdict, host, path prefix).

    Verdicts are ``allow`` and ``block``. The longest rule that fits wins, a longer host at the same
    length, and ``block`` over ``allow`` where a rule is listed twice. A URL that no rule fits gets
    ``default``. Null URLs and URLs without ``://`` have an empty host and path, so no rule fits;
    repeated rows are judged each; other columns are ignored; null ids are carried; empty tables give
    empty results. Rules whose host is empty or holds upper case never fit.
    """
    spark = pages.sparkSession
    known = {v for v, _, _ in rules} - {"allow", "block"}
    if known:
        raise ValueError(f"unknown verdicts {sorted(known)}")
    parts = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rules = [r for r in rules if r[1]]
    if not rules:
        return parts.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"),
                            F.lit(default).alias("verdict"))
    shapes = shapes_of(rules)
    keys = [key_of(s, F.col("host"), F.col("path")) for s in shapes]
    universe = parts.select(F.explode(F.array_compact(F.array(*keys))).alias("key"))

    def cascade(verdict: str) -> list[Level]:
        own = [(host + path,) for v, host, path in rules if v == verdict]
        return build_cascade(spark.createDataFrame(own, "key string"), universe)

    block, allow = cascade("block"), cascade("allow")
    rule, verdict = F.lit(None).cast("string"), F.lit(default)
    for i in range(len(shapes) - 1, -1, -1):
        key = F.col(f"key_{i}")
        blocked, allowed = is_listed(key, block), is_listed(key, allow)
        hit = key.isNotNull() & (blocked | allowed)
        rule = F.when(hit, key).otherwise(rule)
        verdict = F.when(hit, F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).otherwise(verdict)
    asked = parts.select("*", *[k.alias(f"key_{i}") for i, k in enumerate(keys)])
    return asked.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("verdict"))
