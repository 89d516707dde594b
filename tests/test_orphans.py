import datetime as dt
import random

import pytest

from propgraph.operators import orphans

NODES = "id bigint, created_at timestamp_ntz, deleted_at timestamp_ntz, child_id string"
EDGES = "edge_id string, ord bigint, source_id bigint, target_id bigint, created_at timestamp_ntz, key string"
T0 = dt.datetime(2025, 1, 30)


def run(spark, nodes, edges, blocks=256):
    p = orphans.parents(spark.createDataFrame(nodes, NODES), "nodes", "id", "created_at", "deleted_at")
    r = orphans.references(spark.createDataFrame(edges, EDGES), "edges", "edge_id", "nodes", {"source": "source_id", "target": "target_id"}, "created_at")
    return orphans.orphan_references(p, r, blocks)


def brute(nodes, edges):
    out = set()
    for e, _, s, t, at, _ in edges:
        for side, key in (("source", s), ("target", t)):
            own = [n for n in nodes if n[0] == key]
            if key is None:
                continue
            times = [n[1] for n in own if n[1] is not None]
            kind = "missing" if not own else "deleted" if all(n[2] for n in own) else "late" if times and at and min(times) > at else None
            if kind:
                out.add((e, side, kind))
    return sorted(out)


def random_data(seed):
    r = random.Random(seed)
    at = lambda: r.choice([None, T0 + dt.timedelta(hours=r.randrange(100))])
    nodes = [(r.randrange(30), at(), r.choice([None, None, T0]), "x") for _ in range(40)]
    edges = [(f"e{i}", i, r.choice([None, 3, 3, 77, r.randrange(40)]), r.choice([None, 3, r.randrange(40)]), at(), "k") for i in range(300)]
    return nodes, edges + [(e[0], 1000 + i, *e[2:]) for i, e in enumerate(edges[:60])]


@pytest.mark.parametrize("blocks", [2, 8, 256])
def test_against_brute_force(spark, rows, blocks):
    """Few blocks make every, some or no key heavy."""
    nodes, edges = random_data(blocks)
    assert rows(run(spark, nodes, edges, blocks), "child_id", "side", "kind") == brute(nodes, edges)


def test_empty(spark, rows):
    assert rows(run(spark, [], [])) == []
    assert rows(run(spark, [], [("e", 1, 5, None, None, "")]), "child_id", "side", "kind") == [("e", "source", "missing")]
    assert rows(run(spark, [(5, None, None, "")], [])) == []


def test_totals(spark, rows):
    edges = [("a", 1, 5, 6, T0, ""), ("b", 2, 5, None, T0 + dt.timedelta(5), ""), ("c", 3, 5, None, None, ""), ("a", 4, 5, 6, T0, "")]
    assert rows(orphans.orphan_totals(run(spark, [], edges))) == [("edges", "source", "missing", None, 1), ("edges", "source", "missing", "2025-01", 1), ("edges", "source", "missing", "2025-02", 1), ("edges", "target", "missing", "2025-01", 1)]


def test_ids_beyond_doubles(spark, rows):
    big = 2**53
    assert rows(run(spark, [(big, None, None, "")], [("e", 1, big + 1, big, None, "")]), "child_id", "side", "kind") == [("e", "source", "missing")]
