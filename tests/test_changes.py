import random

import pytest

from propgraph.operators import changes
from propgraph.streaming.changes import LOG, apply_stream, log_stream, windowed_counts


def brute(records):
    """Last change of each key by version, over all records."""
    done = {r[5] for r in records if r[1] == 4 and r[5]}
    state = {}
    for _, kind, key, value, _, tx, version in records:
        if kind in (1, 2) and key is not None and version is not None and tx is not None and (tx == 0 or tx in done):
            state[key] = max(state.get(key, (-1, 0, "")), (version, kind, value or ""))
    return sorted((k, v, x) for k, (v, kind, x) in state.items() if kind == 1)


def random_log(seed, n=400, keys=12):
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = r.choice([1, 1, 1, 1, 2, 3, 4, 5, 9])
        key = None if kind in (3, 4, 5) or r.random() < 0.03 else "hot" if r.random() < 0.4 else f"k{r.randrange(keys)}"
        out.append((i, kind, key, f"v{i}" if kind == 1 else None, None, r.choice([0, 0, r.randrange(1, 30), None]), None if kind > 2 else i * 2))
    out += [(n + i, *r.choice(out)[1:]) for i in range(60)]
    r.shuffle(out)
    return [(i, *x[1:]) for i, x in enumerate(out)]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, rows, seed):
    log = random_log(seed)
    for batch in (7, 10**6):
        assert rows(changes.apply_changes(spark.createDataFrame(log, LOG), batch)) == brute(log)


def test_ties_and_nulls(spark, rows):
    log = [(1, 1, "a", "x", None, 0, 5), (2, 2, "a", None, None, 0, 5), (3, 1, "b", "y", None, 0, None), (4, 1, "c", None, None, 0, 1), (5, 1, None, "z", None, 0, 9), (6, 1, "d", "q", None, 3, 2), (7, 1, "", "e", None, 0, 1)]
    assert rows(changes.apply_changes(spark.createDataFrame(log, LOG))) == [("", 1, "e"), ("c", 1, None)]


def test_empty_and_extra_columns(spark, rows):
    assert rows(changes.apply_changes(spark.createDataFrame([], LOG))) == []
    extra = spark.createDataFrame([(1, 1, "a", "x" * 500_000, None, 0, 5, "n")], LOG + ", put string")
    assert rows(changes.apply_changes(extra), "record_key", "record_version") == [("a", 5)]


def test_stored_table_in_any_order(spark, rows, tmp_path):
    log = [x for x in random_log(9) if x[1] in (1, 2) and x[2] is not None and x[5] == 0]
    t = changes.EqualityDeleteTable(spark, str(tmp_path / "t"))
    parts = [log[i::4] for i in range(4)]
    for p in (parts[2], parts[0], parts[3], parts[0], parts[1]):
        t.append(spark.createDataFrame(p, LOG))
    assert rows(t.read()) == brute(log)
    t.compact()
    assert len(t.batches()) == 1 and rows(t.read()) == brute(log)
    late = [(999, 1, "hot", "old", None, 0, -1)]
    t.append(spark.createDataFrame(late, LOG))
    assert rows(t.read()) == brute(log)


def test_two_writers_and_nothing(spark, rows, tmp_path):
    one, two = (changes.EqualityDeleteTable(spark, str(tmp_path / "t")) for _ in range(2))
    assert rows(one.read()) == [] and one.batches() == []
    publish = one.manifests.publish

    def late(number, content):  # the other writer comes in between
        one.manifests.publish = publish
        two.append(spark.createDataFrame([(2, 1, "b", "y", None, 0, 2)], LOG))
        publish(number, content)

    one.manifests.publish = late
    one.append(spark.createDataFrame([(1, 1, "a", "x", None, 0, 1)], LOG))
    assert rows(two.read()) == [("a", 1, "x"), ("b", 2, "y")]


def test_log_in_batches_with_transactions(spark, rows, tmp_path):
    """Changes wait for their commit, whichever comes first, over compaction and repeated batches."""
    log = random_log(11)
    t = changes.EqualityDeleteTable(spark, str(tmp_path / "t"))
    for i in range(0, len(log), 120):
        t.append_log(spark.createDataFrame(log[i : i + 120], LOG))
        if i == 240:
            t.compact()
            t.append_log(spark.createDataFrame(log[i : i + 120], LOG))
    assert rows(t.read()) == brute(log)


def test_stream(spark, rows, tmp_path):
    log = random_log(4)
    for i in range(3):
        spark.createDataFrame(log[i::3], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t = changes.EqualityDeleteTable(spark, str(tmp_path / "t"))
    apply_stream(log_stream(spark, str(tmp_path / "in"), 1), t, str(tmp_path / "c")).awaitTermination()
    assert rows(t.read()) == brute(log)
    counts = windowed_counts(log_stream(spark, str(tmp_path / "in")))
    assert counts.isStreaming and counts.columns == ["start", "end", "record_type", "n"]


def test_found_is_read_from_appended_files(spark, rows, tmp_path):
    from propgraph.queries import QUERIES
    from propgraph.runtime import shared_dir

    log = spark.createDataFrame(
        [(i, 2 if i % 7 == 0 else 1, f"k{i % 5}", f"v{i}", None, 9 if i % 3 == 0 else 0, i * 13 % 40) for i in range(1, 40)]
        + [(None, 1, "late", "v", None, 0, 1), (40, 4, None, None, None, 9, None)],
        "seq bigint, record_type int, record_key string, record_value string, record_ts timestamp_ntz, tx_id bigint, record_version bigint",
    )
    stored = changes.stored_changes(log)
    assert len(stored.batches()) == changes.APPENDS and stored.path.startswith(shared_dir(spark))
    assert rows(stored.read()) == rows(changes.apply_changes(log))
    assert rows(changes.stored_changes(log.limit(0)).read()) == []
    log.write.parquet(str(tmp_path / "wal_records.parquet"))
    found = QUERIES["p2_found"](spark, str(tmp_path))
    assert any("/inserts/batch=" in f for f in found.inputFiles()) and rows(found) == rows(changes.apply_changes(log).select("record_key", "record_version"))
