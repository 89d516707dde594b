import random
from collections import defaultdict

import pytest

from propgraph.operators import skew

EDGES = "edge_id string, ord bigint, source_id bigint, target_id bigint, label string, n_rows string"


def random_edges(seed, n=3000):
    r = random.Random(seed)
    out = [(r.choice([None, f"e{i}", f"e{r.randrange(i + 1)}"]), i, r.choice([1, 1, 1, None, r.randrange(50)]), r.choice([None, 5, 5, r.randrange(40)]), r.choice(["A", "A", "A", "a", None]), "x") for i in range(n)]
    return out + out[: n // 3]


def brute(rows):
    n, e, t = defaultdict(int), defaultdict(set), defaultdict(set)
    for edge, _, s, target, label, _ in rows:
        n[s, label] += 1
        e[s, label] |= {edge} - {None}
        t[s, label] |= {target} - {None}
    return {k: (n[k], len(e[k]), len(t[k])) for k in n}


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_against_brute_force(spark, partitions):
    data = random_edges(partitions)
    df = skew.balanced_distinct(spark.createDataFrame(data, EDGES).repartition(6), ["source_id", "label"], {"n_edges": "edge_id", "n_targets": "target_id"}, partitions)
    assert {(r.source_id, r.label): (r.n_rows, r.n_edges, r.n_targets) for r in df.collect()} == brute(data)


def test_one_value_over_many_partitions(spark):
    """All rows equal: only the tie-breaking number can split them, and the value still counts once."""
    data = [("same", i, 1, 1, "A", "") for i in range(2000)]
    df = skew.balanced_distinct(spark.createDataFrame(data, EDGES).repartition(5), ["source_id", "label"], {"n_edges": "edge_id"}, 16)
    assert [tuple(r) for r in df.collect()] == [(1, "A", 2000, 1)]


def test_heavy_key_is_split(spark):
    data = [(f"e{i}", i, 1, i, "A", "") for i in range(4000)]
    df = spark.createDataFrame(data, EDGES)
    sizes = df.repartitionByRange(8, "source_id", "label", "edge_id").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) < 1000


def test_empty_and_long(spark):
    df = spark.createDataFrame([], EDGES)
    assert skew.balanced_distinct(df, ["source_id", "label"], {"n_edges": "edge_id"}).collect() == []
    long = spark.createDataFrame([("e" * 300_000, 1, 1, 1, "l" * 100_000, "")] * 2, EDGES)
    assert [r.n_edges for r in skew.balanced_distinct(long, ["source_id", "label"], {"n_edges": "edge_id"}).collect()] == [1]


def test_heavy_pairs(spark, rows):
    pairs = spark.createDataFrame([(1, 90), (2, 9), (None, 1)], "k int, n bigint")
    assert rows(skew.heavy_pairs(pairs, "n", 0.09)) == [(1, 90), (2, 9)]
