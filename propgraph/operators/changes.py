"""Applying a stream of inserts, updates and deletes.

Method: equality-delete files with sequence numbers. Every batch of changes is appended as two sets of
rows: inserts, and equality deletes that hold a key and a sequence number. A delete kills the inserts
of its key with a lower sequence number; a put adds an insert and, being an upsert, a delete of what
precedes it. Readers anti-join the inserts against later delete keys. The sequence number is the
record's version, so late, repeated and out-of-order changes need no sorting.

Scale: a writer keeps one insert per key and batch and readers keep the latest delete per key, both by
map-side combine, so a key with a third of all rows arrives at the join as one row per batch.

Defined results: changes without key or version, of other types, or of transactions that aren't
committed are ignored; a null ``tx_id`` is no committed transaction; a delete wins over a put of the
same version; copies of a change count once (of differing copies the greatest value wins); an empty
log gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ensure_columns, materialize, scratch_path
from ..sources.manifests import Conflict, Manifests

PUT, DELETE, BEGIN, COMMIT, ROLLBACK = 1, 2, 3, 4, 5
#: Rows of the log, in arrival order, that make up one batch.
BATCH_ROWS = 1_000_000
#: Appends by which ``stored_changes`` writes a whole log.
APPENDS = 4


LOG = ["seq", "record_type", "record_key", "record_value", "record_ts", "tx_id", "record_version"]


def only_changes(log: DataFrame) -> DataFrame:
    """Puts and deletes with a key, a version and a transaction (0: none), committed or not."""
    ensure_columns(log, LOG)
    there = F.col("record_key").isNotNull() & F.col("record_version").isNotNull() & F.col("tx_id").isNotNull()
    return log.select(*LOG).where(F.col("record_type").isin(PUT, DELETE) & there)


def only_commits(log: DataFrame) -> DataFrame:
    """``tx_id`` of the commit records."""
    return log.where((F.col("record_type") == COMMIT) & (F.col("tx_id") != 0)).select("tx_id")


def committed_changes(log: DataFrame) -> DataFrame:
    """Puts and deletes with a key and a version that are outside transactions or in committed ones.

    The outside ones skip the join, so ``tx_id`` 0 is no hot key there.
    """
    changes = only_changes(log)
    inside = changes.where(F.col("tx_id") != 0).join(only_commits(log).distinct(), "tx_id", "left_semi")
    return changes.where(F.col("tx_id") == 0).unionByName(inside.select(*changes.columns))


def split_inserts(changes: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """The insert rows a writer appends: the last put of each key within each batch of ``batch_rows`` arrivals."""
    return (
        changes.where(F.col("record_type") == PUT)
        .groupBy("record_key", F.floor(F.coalesce(F.col("seq"), F.lit(0)) / batch_rows).alias("batch"))
        .agg(F.max(F.struct("record_version", "record_value")).alias("put"))
        .select("record_key", "put.*")
    )


def split_deletes(changes: DataFrame) -> DataFrame:
    """The equality deletes, one per key: ``below`` covers inserts of lower sequence numbers, ``upto`` also those of that very number."""
    kind = F.col("record_type")
    return changes.groupBy("record_key").agg(
        F.max(F.when(kind == PUT, F.col("record_version"))).alias("below"), F.max(F.when(kind == DELETE, F.col("record_version"))).alias("upto")
    )


def read_current(inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """Readers' anti-join: ``record_key, record_version, record_value`` of inserts without a later delete key."""
    last = deletes.groupBy(F.col("record_key").alias("delete_key")).agg(F.max("below").alias("below"), F.max("upto").alias("upto"))
    version = F.col("record_version")
    later = (F.col("record_key") == F.col("delete_key")) & (F.coalesce(F.col("below") > version, F.lit(False)) | F.coalesce(F.col("upto") >= version, F.lit(False)))
    alive = inserts.join(last, later, "left_anti")
    return alive.groupBy("record_key").agg(F.max(F.struct("record_version", "record_value")).alias("put")).select("record_key", "put.*")


def apply_changes(log: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """The current record of every key alive at the end of ``log``."""
    changes = committed_changes(log)
    return read_current(split_inserts(changes, batch_rows), split_deletes(changes))


class EqualityDeleteTable:
    """A stored table that grows by batches: ``inserts`` and ``deletes`` folders, a numbered manifest for each batch.

    A batch is visible once its manifest is published, which happens last; half-written batches are
    never read. ``append_log`` takes raw log records: changes of transactions that aren't committed yet
    wait in ``pending`` until a commit record arrives. ``compact`` folds everything into one batch
    without changing what readers see.
    """

    INSERTS = "record_key string, record_version bigint, record_value string"
    DELETES = "record_key string, below bigint, upto bigint"
    PENDING = "seq bigint, record_type int, record_key string, record_value string, record_ts timestamp_ntz, tx_id bigint, record_version bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, f"{self.path}/manifests")

    def append(self, changes: DataFrame) -> str:
        """Add changes (as from ``committed_changes``) as one batch; returns its name."""
        return self._write(split_inserts(changes, 1 << 62), split_deletes(changes))

    def append_log(self, records: DataFrame) -> str:
        """Add log records, among them commits. Records that are added again change nothing."""
        name, held = uuid.uuid4().hex, self._live()
        only_commits(records).distinct().write.parquet(f"{self.path}/commits/batch={name}")
        commits = self._read("commits", [name], "tx_id bigint")
        known = commits.unionByName(self._read("commits", [m["log"] for m in held if m["log"]], "tx_id bigint")).distinct()
        changes = only_changes(records)
        inside = changes.where(F.col("tx_id") != 0)
        inside.join(known, "tx_id", "left_anti").select(*LOG).write.parquet(f"{self.path}/pending/batch={name}")
        released = self._read("pending", [m["log"] for m in held if m["log"]], self.PENDING).join(commits, "tx_id", "left_semi").select(*LOG)
        ready = changes.where(F.col("tx_id") == 0).unionByName(inside.join(known, "tx_id", "left_semi").select(*LOG)).unionByName(released)
        return self._write(split_inserts(ready, 1 << 62), split_deletes(ready), log=name)

    def _write(self, inserts: DataFrame, deletes: DataFrame, replaces: list[str] | None = None, log: str | None = None) -> str:
        batch = uuid.uuid4().hex
        inserts.write.parquet(f"{self.path}/inserts/batch={batch}")
        deletes.write.parquet(f"{self.path}/deletes/batch={batch}")
        number = len(self.manifests.numbers())
        while True:
            try:
                self.manifests.publish(number, {"batch": batch, "replaces": replaces or [], "log": log})
                return batch
            except Conflict:  # another writer's batch came first; batches don't depend on each other
                number += 1

    def _live(self) -> list[dict]:
        rows = self.manifests.read_all().values()
        gone = {b for r in rows for b in r["replaces"]}
        return [r for r in rows if r["batch"] not in gone]

    def batches(self) -> list[str]:
        return sorted(r["batch"] for r in self._live())

    def _read(self, kind: str, batches: list[str], schema: str) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{kind}/batch={b}" for b in batches))

    def read(self) -> DataFrame:
        now = self.batches()
        return read_current(self._read("inserts", now, self.INSERTS), self._read("deletes", now, self.DELETES))

    def compact(self) -> str:
        """One batch in place of all; deletes stay, since late puts they cover may still arrive, and so does what is pending."""
        held = self._live()
        old, logs = [m["batch"] for m in held], [m["log"] for m in held if m["log"]]
        log = None
        if logs:
            log = uuid.uuid4().hex
            commits = self._read("commits", logs, "tx_id bigint").distinct()
            commits.write.parquet(f"{self.path}/commits/batch={log}")
            self._read("pending", logs, self.PENDING).join(commits, "tx_id", "left_anti").select(*LOG).write.parquet(f"{self.path}/pending/batch={log}")
        deletes = self._read("deletes", old, self.DELETES).groupBy("record_key").agg(F.max("below").alias("below"), F.max("upto").alias("upto"))
        current = read_current(self._read("inserts", old, self.INSERTS), self._read("deletes", old, self.DELETES))
        return self._write(current, deletes, old, log)


def stored_changes(log: DataFrame, appends: int = APPENDS) -> EqualityDeleteTable:
    """A table in the shared folder to which ``log`` is appended in about equal batches, in the order of arrival.

    Transactions are judged by the whole log, so a commit may arrive in a later batch than its changes.
    """
    changes = materialize(committed_changes(log))
    arrival = F.coalesce(F.col("seq"), F.lit(0))
    low, high = changes.agg(F.min(arrival), F.max(arrival)).first()
    stored = EqualityDeleteTable(log.sparkSession, scratch_path(log.sparkSession))
    low, high = low or 0, high or 0
    bounds = [low - 1 + (high - low + 1) * i // appends for i in range(appends + 1)]
    for after, upto in zip(bounds[:-1], bounds[1:], strict=True):
        stored.append(changes.where((arrival > after) & (arrival <= upto)))
    return stored
