"""Key-value reads over a log of operations: ``key, value, version, ts, seq, is_deleted``."""

from __future__ import annotations

import math
import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import GraphError, NotFound

OPERATION = "key string, value string, version bigint, ts timestamp_ntz, seq bigint, is_deleted boolean"


def newest(log: DataFrame, order: tuple[str, ...] = ("version", "seq"), tombstones: bool = False) -> DataFrame:
    """The newest operation of each key, by map-side combine; deleted keys only with ``tombstones``."""
    rest = [c for c in log.columns if c not in ("key", *order)]
    last = log.where(F.col("key").isNotNull()).groupBy("key").agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("o"))
    whole = last.select("key", *(F.col(f"o.{c}").alias(c) for c in log.columns if c != "key"))
    return whole if tombstones else whole.where(~F.col("is_deleted"))


def get(log: DataFrame, key: str) -> str:
    """The value in force; an error if the key is absent or deleted."""
    row = newest(log.where(F.col("key") == key)).select("value").first()
    if row is None:
        raise NotFound(f"key not found: {key}")
    return row[0]


def contains(log: DataFrame, key: str) -> bool:
    return not newest(log.where(F.col("key") == key)).isEmpty()


def scan(log: DataFrame, prefix: str = "", limit: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Living keys with the prefix (pushed down to the scan), from ``start`` up to and including ``end``; the first ``limit`` by key."""
    own = log.where(F.col("key").startswith(prefix))
    if start is not None:
        own = own.where(F.col("key") >= start)
    if end is not None:
        own = own.where(F.col("key") <= end)
    found = newest(own)
    return found if limit is None else found.orderBy("key").limit(limit)


def listing(log: DataFrame, tombstones: bool = False) -> DataFrame:
    """Keys in order with what they hold; deleted ones only with ``tombstones``."""
    return newest(log, tombstones=tombstones).orderBy("key")


def seek(log: DataFrame, key: str | None = None, last: bool = False) -> DataFrame:
    """The first living key at or after ``key`` (any, by default), or the last: one row or none."""
    found = newest(log if key is None else log.where(F.col("key") >= key))
    return found.orderBy(F.col("key").desc() if last else F.col("key")).limit(1)


def key_range(log: DataFrame) -> DataFrame:
    return newest(log).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("n_keys"))


def as_of(log: DataFrame, at: str | float) -> DataFrame:
    """What each key held at a time: the newest operation with ``ts`` not after it.

    ``at``: a timestamp text, or seconds since 1970, which must be positive; the future is taken as now.
    """
    if isinstance(at, int | float):
        if at <= 0:
            raise GraphError("timestamp must be positive")
        when = F.timestamp_seconds(F.lit(min(at, time.time()))).cast("timestamp_ntz")
    else:
        when = F.lit(at).cast("timestamp_ntz")
    return newest(log.where(F.col("ts") <= when), ("ts", "seq"))


def scan_as_of(log: DataFrame, start: str, end: str, at: str | float) -> DataFrame:
    return as_of(log.where(F.col("key").between(start, end)), at)


def recover_to(log: DataFrame, at: str | float, path: str) -> None:
    """Write the state at a time as a table."""
    as_of(log, at).write.parquet(path)


def compact(*tables: DataFrame, keep_tombstones: bool = True) -> DataFrame:
    """One table in place of several: the newest operation of each key, whatever table holds it."""
    return newest(reduce(lambda a, b: a.unionByName(b), tables), tombstones=keep_tombstones)


def put(log: DataFrame, rows: list[tuple[str, str]], version: int, ts=None) -> DataFrame:
    """The log with puts appended; their order within ``rows`` is their ``seq``."""
    return _append(log, [(k, v, version, ts, i, False) for i, (k, v) in enumerate(rows)])


def delete(log: DataFrame, keys: list[str], version: int, ts=None) -> DataFrame:
    return _append(log, [(k, None, version, ts, i, True) for i, k in enumerate(keys)])


def _append(log: DataFrame, rows: list[tuple]) -> DataFrame:
    return log.unionByName(log.sparkSession.createDataFrame(rows, OPERATION))


def stats(log: DataFrame) -> DataFrame:
    """Operations, deletions, keys, living keys and bytes."""
    per = newest(log, tombstones=True).agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(~F.col("is_deleted")).alias("n_living"))
    whole = log.agg(F.count(F.lit(1)).alias("n_operations"), F.count_if("is_deleted").alias("n_deletions"), F.coalesce(F.sum(F.length("key") + F.coalesce(F.length("value"), F.lit(0))), F.lit(0)).alias("n_chars"))
    return whole.join(F.broadcast(per), F.lit(True))  # one row each


# ---------------------------------------------------------------- Bloom filters


#: Bits up to which a filter's words are broadcast (a million rows).
MOST_BROADCAST_BITS = 63 << 20


def bloom_size(n: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions of a filter for ``n`` keys with so many false positives."""
    if not 0 < rate < 1:
        raise GraphError("the rate must lie between 0 and 1")
    bits = max(64, math.ceil(-max(1, n) * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(1, n) * math.log(2)))


def _places(key: str, bits: int, hashes: int):
    return F.array(*(F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(hashes)))


_BIT = "shiftleft(1L, cast(pmod(at, 63) as int))"


def bloom_filter(keys: DataFrame, column: str, bits: int, hashes: int) -> DataFrame:
    """The filter as a table ``word, mask`` of 63-bit words that have a bit set; built by map-side combine, stored as any table is."""
    at = keys.where(F.col(column).isNotNull()).select(F.explode(_places(column, bits, hashes)).alias("at"))
    word = F.floor(F.col("at") / 63).cast("bigint")
    return at.select(word.alias("word"), F.expr(_BIT).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("mask"))


def bloom_contains(probes: DataFrame, column: str, words: DataFrame, bits: int, hashes: int) -> DataFrame:
    """The rows of ``probes`` whose key may be in the filter: all that are, and few others.

    Each hash function is a semi-join with the filter's words, so rows drop out one after another and
    none is shuffled as long as the words (at most ``bits`` / 63) are few enough to be broadcast.
    """
    words = F.broadcast(words) if bits <= MOST_BROADCAST_BITS else words
    left = probes.where(F.col(column).isNotNull())
    for i in range(hashes):
        place = F.pmod(F.xxhash64(column, F.lit(i)), F.lit(bits))
        set_there = F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(63)).cast("int"))) != 0
        left = left.join(words, (F.floor(place / 63).cast("bigint") == F.col("word")) & set_there, "left_semi")
    return left


def bloom_rate(words: DataFrame, bits: int, hashes: int) -> DataFrame:
    """The share of false positives to expect: that of set bits to the power of the hash functions."""
    return words.agg(F.pow(F.sum(F.bit_count("mask")) / bits, F.lit(hashes)).alias("false_positive_rate"))
