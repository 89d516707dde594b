"""Replaying a write-ahead log: ``seq, type, key, value, ts, tx_id, version``.

Types as in ``changes``: 1 put, 2 delete, 3 begin, 4 commit, 5 rollback; others are corrupted. ``tx_id``
0 is outside any transaction. Where records have a ``checksum`` (``sealed``), one that doesn't fit makes
a record corrupted, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import GraphError
from .changes import BEGIN, COMMIT, DELETE, PUT, ROLLBACK

RECORD = "seq bigint, type int, key string, value string, ts timestamp_ntz, tx_id bigint, version bigint"
KINDS = (PUT, DELETE, BEGIN, COMMIT, ROLLBACK)


class CorruptedLog(GraphError):
    """A strict replay met a corrupted record."""


def _checksum():
    """Of all fields; a null differs from any text."""
    return F.crc32(F.to_json(F.struct("seq", "type", "key", "value", "ts", "tx_id", "version"), {"ignoreNullFields": "false"}).cast("binary"))


def sealed(log: DataFrame) -> DataFrame:
    """The log with a ``checksum`` of each record."""
    return log.withColumn("checksum", _checksum())


def _corrupted(log: DataFrame):
    bad = ~F.coalesce(F.col("type").isin(*KINDS), F.lit(False)) | (F.col("type").isin(PUT, DELETE) & F.col("key").isNull())
    return bad | ~F.col("checksum").eqNullSafe(_checksum()) if "checksum" in log.columns else bad


def corrupted(log: DataFrame) -> DataFrame:
    """The records of unknown type, without a key that they need, or changed since they were sealed."""
    return log.where(_corrupted(log))


def classify(log: DataFrame) -> DataFrame:
    """``tx_id, state``: corrupted, rolled_back, committed or active, in that order of precedence."""
    t = log.where(F.col("tx_id") != 0).groupBy("tx_id").agg(
        F.max(_corrupted(log)).alias("bad"), F.max(F.col("type") == ROLLBACK).alias("back"), F.max(F.col("type") == COMMIT).alias("done")
    )
    state = F.when(F.col("bad"), "corrupted").when(F.coalesce("back", F.lit(False)), "rolled_back").when(F.coalesce("done", F.lit(False)), "committed").otherwise("active")
    return t.select("tx_id", state.alias("state"))


def effective(log: DataFrame, atomic: bool = True, strict: bool = False) -> DataFrame:
    """The puts and deletes that count.

    ``atomic``: only those of committed transactions (and outside any); otherwise all that aren't rolled
    back. ``strict``: a corrupted record is an error, at once; all records are looked at, in a pass of
    its own, since filters on the changes would skip them. Otherwise corrupted records are left out.
    """
    if strict and not corrupted(log).isEmpty():
        raise CorruptedLog("corrupted log record")
    whole = log
    log = log.where(~_corrupted(log)) if "checksum" in log.columns else log
    changes = log.where(F.col("type").isin(PUT, DELETE) & F.col("key").isNotNull())
    states = classify(whole)
    inside = changes.where(F.col("tx_id") != 0)
    if atomic:
        inside = inside.join(states.where(F.col("state") == "committed"), "tx_id", "left_semi")
    else:
        inside = inside.join(states.where(F.col("state") == "rolled_back"), "tx_id", "left_anti")
    return changes.where(F.col("tx_id") == 0).unionByName(inside.select(*changes.columns))


def replay(log: DataFrame, atomic: bool = True, strict: bool = False) -> DataFrame:
    """``key, value`` after replay: the highest version, then the highest ``seq``, of each key decides."""
    last = effective(log, atomic, strict).groupBy("key").agg(F.max_by(F.struct("type", "value"), F.struct("version", "seq")).alias("o"))
    return last.where(F.col("o.type") == PUT).select("key", F.col("o.value").alias("value"))


def replay_stats(log: DataFrame, atomic: bool = True) -> DataFrame:
    """One row of counters."""
    n = lambda cond, name: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    records = log.agg(
        F.count(F.lit(1)).alias("n_records"),
        n(_corrupted(log), "n_corrupted"),
        *(n(F.col("type") == k, name) for k, name in zip(KINDS, ("n_puts", "n_deletes", "n_begins", "n_commits", "n_rollbacks"), strict=True)),
        n(F.col("type").isin(PUT, DELETE) & (F.col("tx_id") == 0), "n_standalone"),
    )
    states = classify(log).agg(F.count(F.lit(1)).alias("n_transactions"), *(n(F.col("state") == s, f"n_tx_{s}") for s in ("committed", "rolled_back", "active", "corrupted")))
    applied = effective(log, atomic).agg(F.count(F.lit(1)).alias("n_applied"))
    return records.join(F.broadcast(states), F.lit(True)).join(F.broadcast(applied), F.lit(True))  # one row each
