import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from propgraph.model import GraphError, NotFound
from propgraph.operators import kv, oplog
from propgraph.sources.log import LogStore

T0 = dt.datetime(2025, 1, 1)
LOG = "seq bigint, type int, key string, value string, ts timestamp_ntz, tx_id bigint, version bigint"


@pytest.fixture(scope="module")
def ops(spark):
    day = lambda n: T0 + dt.timedelta(n)
    return spark.createDataFrame(
        [("a1", "x", 1, day(0), 1, False), ("a1", "y", 2, day(1), 2, False), ("a2", "z", 3, day(1), 3, False), ("a2", None, 4, day(3), 4, True), ("b", "", 5, day(2), 5, False), (None, "n", 6, None, 6, False)], kv.OPERATION
    )


def keys(df):
    return sorted(r.key for r in df.collect())


def test_reads(ops):
    assert kv.get(ops, "a1") == "y" and kv.get(ops, "b") == ""
    with pytest.raises(NotFound):
        kv.get(ops, "a2")
    assert kv.contains(ops, "a1") and not kv.contains(ops, "zz")
    assert keys(kv.scan(ops, "a")) == ["a1"] and keys(kv.scan(ops, "", 1)) == ["a1"] and keys(kv.scan(ops, start="a2", end="b")) == ["b"]
    assert keys(kv.seek(ops, "a2")) == ["b"] and keys(kv.seek(ops, last=True)) == ["b"]
    assert tuple(kv.key_range(ops).first()) == ("a1", "b", 2)
    assert keys(kv.newest(ops, tombstones=True)) == ["a1", "a2", "b"]


def test_as_of(ops, tmp_path, spark):
    assert {r.key: r.value for r in kv.as_of(ops, "2025-01-02 00:00:00").collect()} == {"a1": "y", "a2": "z"}
    assert keys(kv.scan_as_of(ops, "a", "a9", "2025-01-01 12:00:00")) == ["a1"]
    assert keys(kv.as_of(ops, time.time() + 1e6)) == ["a1", "b"]
    with pytest.raises(GraphError):
        kv.as_of(ops, 0)
    kv.recover_to(ops, "2025-01-02 00:00:00", str(tmp_path / "r"))
    assert keys(spark.read.parquet(str(tmp_path / "r"))) == ["a1", "a2"]


def test_compaction_keeps_the_newest(ops):
    new, old = ops.where("version > 2"), ops.where("version <= 2")
    for tables in ((new, old), (old, new)):
        c = kv.compact(*tables)
        assert {r.key: r.version for r in c.collect()} == {"a1": 2, "a2": 4, "b": 5}
    assert keys(kv.compact(new, old, keep_tombstones=False)) == ["a1", "b"]


def test_writes(ops):
    more = kv.delete(kv.put(ops, [("c", "1"), ("c", "2")], 10), ["a1", "nothing"], 11)
    assert keys(kv.newest(more)) == ["b", "c"] and kv.get(more, "c") == "2"
    s = kv.stats(more).first()
    assert (s.n_operations, s.n_deletions, s.n_keys, s.n_living) == (10, 3, 5, 2)


def test_replay(spark):
    log = spark.createDataFrame(
        [
            (1, 3, None, None, None, 7, None), (2, 1, "key1", "value1", None, 7, 1), (3, 4, None, None, None, 7, None),
            (4, 3, None, None, None, 8, None), (5, 1, "key2", "value2", None, 8, 2), (6, 5, None, None, None, 8, None),
            (7, 1, "key3", "value3", None, 9, 3), (8, 1, "key4", "v", None, 0, 4), (9, 2, "key4", None, None, 0, 5),
            (10, 9, None, None, None, 10, None), (11, 1, "key5", "v", None, 10, 6), (12, 4, None, None, None, 10, None),
            (13, 1, "key6", "new", None, 0, 9), (14, 1, "key6", "old", None, 0, 8),
        ], LOG)
    assert {r.key: r.value for r in oplog.replay(log).collect()} == {"key1": "value1", "key6": "new"}
    assert {r.key for r in oplog.replay(log, atomic=False).collect()} == {"key1", "key3", "key5", "key6"}
    assert {r.tx_id: r.state for r in oplog.classify(log).collect()} == {7: "committed", 8: "rolled_back", 9: "active", 10: "corrupted"}
    with pytest.raises(oplog.CorruptedLog):
        oplog.replay(log, strict=True)
    s = oplog.replay_stats(log).first()
    assert (s.n_records, s.n_corrupted, s.n_puts, s.n_transactions, s.n_applied) == (14, 1, 7, 4, 5)
    assert oplog.replay(log.limit(0)).count() == 0


def test_strict_replay_sees_corruption_in_files_of_its_own(spark, tmp_path):
    """Filters that are pushed down to the scan must not hide it."""
    good = spark.createDataFrame([(i, 1, f"k{i}", "v", None, 0, i) for i in range(50)], LOG)
    for part in (good, spark.createDataFrame([(99, 9, None, None, None, 0, None)], LOG)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    with pytest.raises(oplog.CorruptedLog):
        oplog.replay(log, strict=True)
    assert oplog.replay(log).count() == 50 and oplog.replay(log.where("seq < 99"), strict=True).count() == 50


def test_checksums(spark):
    log = oplog.sealed(spark.createDataFrame([(1, 1, "a", "x", T0, 0, 1), (2, 1, "b", None, None, 3, 2), (3, 4, None, None, None, 3, None)], LOG))
    assert oplog.corrupted(log).count() == 0 and oplog.replay(log, strict=True).count() == 2
    for change in ({"value": F.lit("")}, {"ts": F.lit(None).cast("timestamp_ntz")}, {"version": F.col("version") + 1}, {"checksum": F.lit(None).cast("bigint")}):
        assert oplog.corrupted(log.withColumns(change)).count() > 0
    changed = log.withColumn("value", F.when(F.col("key") == "a", F.lit("y")).otherwise(F.col("value")))
    assert [r.seq for r in oplog.corrupted(changed).collect()] == [1]
    assert {r.key for r in oplog.replay(changed).collect()} == {"b"}
    with pytest.raises(oplog.CorruptedLog):
        oplog.replay(changed, strict=True)
    assert {r.tx_id: r.state for r in oplog.classify(log.withColumn("value", F.lit("z"))).collect()} == {3: "corrupted"}


def test_stored_log(spark, tmp_path):
    one, two = (LogStore(spark, str(tmp_path / "log")) for _ in range(2))
    assert one.read().count() == 0
    assert one.append([(1, "a", "x", 0, 1), (1, "b", "y", 0, 2)], T0) == 1 and two.append([(2, "a", None, 0, 3)]) == 3
    assert {r.key for r in oplog.replay(one.read(), strict=True).collect()} == {"b"}
    one.truncate()
    assert two.read().count() == 0 and two.append([(1, "c", "z", 0, 4)]) == 4
    assert [(r.seq, r.key) for r in one.read().collect()] == [(4, "c")]
    assert one.vacuum() == 2 and oplog.replay(one.read()).count() == 1


def test_listing(ops):
    assert [r.key for r in kv.listing(ops).collect()] == ["a1", "b"]
    assert [(r.key, r.is_deleted) for r in kv.listing(ops, tombstones=True).collect()] == [("a1", False), ("a2", True), ("b", False)]


def test_bloom_filter(spark):
    bits, hashes = kv.bloom_size(500, 0.01)
    assert 4700 < bits < 4900 and hashes == 7
    keys = spark.createDataFrame([(f"k{i}",) for i in range(500)] + [(None,), ("k1",)], "key string")
    words = kv.bloom_filter(keys, "key", bits, hashes)
    probes = spark.createDataFrame([(f"k{i}",) for i in range(3000)] + [(None,)], "key string")
    maybe = {r.key for r in kv.bloom_contains(probes, "key", words, bits, hashes).collect()}
    assert {f"k{i}" for i in range(500)} <= maybe and len(maybe) < 500 + 2500 * 0.03
    assert 0.001 < kv.bloom_rate(words, bits, hashes).first()[0] < 0.03
    assert kv.bloom_contains(probes, "key", words.limit(0), bits, hashes).count() == 0
    with pytest.raises(GraphError):
        kv.bloom_size(5, 1.0)
