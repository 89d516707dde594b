import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from propgraph.model import Graph, GraphError, NotFound
from propgraph.operators import index, reads, traverse, writes
from propgraph.session import GraphSession

#: Three ships that follow each other and the harbours they serve; node 40 can only be reached against an edge.
NODES = [(10, "Ship", {"title": "Petrel", "tons": "310"}), (20, "Ship", {"title": "Heron", "tons": "275"}), (30, "Ship", {"title": "Curlew", "tons": "420"}), (40, "Harbour", {"title": "Saltwick Quay", "depth": "9"}), (50, "Harbour", {"title": "Ness", "depth": "14"})]
EDGES = [("f1", 1, 10, 20, "FOLLOWS", {"since": "spring"}), ("f2", 2, 10, 30, "FOLLOWS", {"since": "autumn"}), ("f3", 3, 20, 30, "FOLLOWS", {"since": "winter"}), ("c1", 4, 10, 40, "CALLS_AT", {"cargo": "salt", "since": "autumn"}), ("c2", 5, 20, 50, "CALLS_AT", {"cargo": "wool", "since": "spring"}), ("c3", 6, 30, 50, "CALLS_AT", {"cargo": "salt", "since": "summer"})]


@pytest.fixture(scope="module")
def g(spark):
    return Graph.of(spark, NODES, EDGES)


def ids(df, c="id"):
    return sorted(r[0] for r in df.select(c).collect())


@pytest.mark.parametrize("label, n", [("Ship", 3), ("Harbour", 2), ("Lighthouse", 0), ("ship", 0)])
def test_nodes_by_label(g, label, n):
    assert reads.nodes_by_label(g, label).count() == n


@pytest.mark.parametrize("label, n", [("FOLLOWS", 3), ("CALLS_AT", 3), ("OWNS", 0)])
def test_edges_by_label(g, label, n):
    assert reads.edges_by_label(g, label).count() == n


@pytest.mark.parametrize("node, direction, nodes, n", [(10, "outgoing", [20, 30, 40], 3), (20, "both", [10, 30, 50], 3), (50, "incoming", [20, 30], 2), (40, "outgoing", [], 0)])
def test_neighbours(g, node, direction, nodes, n):
    found, edges = reads.find_neighbors(g, node, direction)
    assert ids(found) == nodes and edges.count() == n


def test_missing_start(g):
    with pytest.raises(NotFound):
        reads.find_neighbors(g, 77)
    with pytest.raises(GraphError):
        reads.find_neighbors(g, "-1")


@pytest.mark.parametrize("a, b, hops, want", [(10, 30, 4, [10, 30]), (10, 50, 2, [10, 20, 50]), (40, 50, 6, [40, 10, 20, 50]), (40, 50, 2, []), (40, 50, 3, [40, 10, 20, 50]), (50, 40, 3, [50, 20, 10, 40]), (30, 30, 1, [30])])
def test_paths(g, a, b, hops, want):
    assert [r.node_id for r in traverse.find_path(g, a, b, hops).orderBy("pos").collect()] == want


def test_path_edges_and_errors(g):
    assert [r.edge_id for r in traverse.find_path(g, 10, 50, 3).orderBy("pos").collect()] == [None, "f1", "c2"]
    with pytest.raises(NotFound):
        traverse.find_path(g, 77, 10)


def test_properties(g):
    assert ids(reads.nodes_by_property(g, "title", "Petrel")) == [10] and ids(reads.nodes_by_property(g, " tons ", "275")) == [20]
    assert ids(reads.edges_by_property(g, "cargo", "salt"), "edge_id") == ["c1", "c3"]
    assert ids(reads.edges_by_property(g, "since", "spring"), "edge_id") == ["c2", "f1"]
    assert ids(reads.by_number(g.nodes, "tons", 300)) == [10, 30]


def test_bfs_depths(g):
    assert {r.id: r.depth for r in traverse.bfs(g, 10, "both", 3).collect()} == {10: 0, 20: 1, 30: 1, 40: 1, 50: 2}


def test_early_stop(g):
    assert ids(traverse.bfs(g, 10, stop=F.lit(True))) == [10]
    assert ids(traverse.bfs(g, 10, stop=F.col("id") == 30)) == [10, 20, 30]  # in order of discovery, 30 inclusive
    assert ids(traverse.dfs(g, 10, stop=F.lit(True))) == [10]


def test_dfs_depth(g):
    assert ids(traverse.dfs(g, 10, "both", 1)) == [10]
    assert [r.id for r in traverse.dfs(g, 10, "both", 10).orderBy("visit_order").collect()] == [10, 20, 30, 50, 40]


def test_odd_graph(spark):
    """A loop, parallel edges, dangling ends, an isolated node, nulls, odd labels and values."""
    g = Graph.of(
        spark,
        [(0, "a:b", {"k": ""}), (1, None, None), (2, "x", {"q": 'a,|"'}), (9, "alone", {})],
        [("l", 1, 0, 0, "L", None), ("p", 2, 0, 1, "L", {}), ("q", 3, 0, 1, "L", {}), ("d", 4, 0, 77, "L", {}), ("e", 5, 77, 2, "L", {}), ("n", 6, None, 1, None, None)],
    )
    nodes, edges = reads.find_neighbors(g, 0)
    assert ids(nodes) == [0, 1] and ids(edges, "edge_id") == ["d", "l", "l", "p", "q"]
    assert ids(reads.nodes_by_property(g, "k", "")) == [0] and ids(reads.nodes_by_label(g, "a:b")) == [0]
    assert ids(traverse.bfs(g, 0)) == [0, 1] and ids(traverse.bfs(g, 9)) == [9]
    with pytest.raises(NotFound):
        traverse.find_path(g, 0, 2)  # only through a node that doesn't exist
    assert [r.edge_id for r in traverse.find_path(g, 0, 1).orderBy("pos").collect()] == [None, "p"]
    assert traverse.find_path(g, 0, 9).count() == 0
    empty = Graph.of(spark, [], [])
    assert reads.nodes_by_label(empty, "x").count() == 0 and reads.label_counts(empty.edges).count() == 0
    assert {tuple(r) for r in reads.degrees(g).collect()} == {(0, 4, 1), (1, 0, 3), (77, 1, 1), (2, 0, 1)}


def python_bfs(edges, nodes, source, direction, most):
    """Discovery by queue: outgoing before incoming, each by order."""
    depth, parent, queue = {source: 0}, {}, deque([source])
    while queue:
        a = queue.popleft()
        if depth[a] == most:
            continue
        steps = [(0, e[1], e[3]) for e in edges if e[2] == a and direction != "incoming"] + [(1, e[1], e[2]) for e in edges if e[3] == a and direction != "outgoing"]
        for _, _, b in sorted(steps):
            if b not in depth and b in nodes:
                depth[b], parent[b] = depth[a] + 1, a
                queue.append(b)
    return depth, parent


@pytest.mark.parametrize("seed, direction", [(1, "both"), (2, "outgoing"), (3, "incoming")])
def test_bfs_against_python(spark, seed, direction):
    r = random.Random(seed)
    nodes = [(i, "N", {}) for i in range(30)]
    edges = [(f"e{i}", i, r.randrange(30), r.randrange(33), "E", {}) for i in range(45)]
    depth, parent = python_bfs(edges, {n[0] for n in nodes}, 0, direction, 4)
    got = traverse.bfs(Graph.of(spark, nodes, edges), 0, direction, 4).collect()
    assert {x.id: x.depth for x in got} == depth and {x.id: x.parent_id for x in got if x.depth} == parent


@pytest.mark.parametrize("seed", [4, 9])
def test_paths_against_python(spark, seed):
    """Every path is the one that a queue discovers first, from whichever end the search is cheaper."""
    r = random.Random(seed)
    edges = [(f"e{i}", i, r.randrange(40), r.randrange(40), "E", {}) for i in range(60)]
    g = Graph.of(spark, [(i, "N", {}) for i in range(40)], edges)
    depth, parent = python_bfs(edges, set(range(40)), 0, "both", 10)
    for b in r.sample(sorted(depth), 6):
        want = [b]
        while want[-1] != 0:
            want.append(parent[want[-1]])
        rows = traverse.find_path(g, 0, b, 10).orderBy("pos").collect()
        assert [x.node_id for x in rows] == want[::-1]
        ends = {e[0]: {e[2], e[3]} for e in edges}
        assert all(ends[y.edge_id] == {x.node_id, y.node_id} for x, y in zip(rows, rows[1:], strict=False))


def test_levels_too_large_for_the_driver(spark, monkeypatch):
    """The same answers when levels are tables from the start on, or from some depth on."""
    r = random.Random(12)
    edges = [(f"e{i}", i, r.randrange(30), r.randrange(30), "E", {}) for i in range(55)]
    g = Graph.of(spark, [(i, "N", {}) for i in range(28)], edges)
    depth, parent = python_bfs(edges, set(range(28)), 0, "both", 4)
    far = max(depth, key=lambda n: (depth[n], n))
    want = [tuple(x) for x in traverse.find_path(g, 0, far, 10).orderBy("pos").collect()]
    for few, named in ((6, 3),):
        monkeypatch.setattr(traverse, "FEW", few)
        monkeypatch.setattr(traverse, "NAMED", named)
        got = traverse.bfs(g, 0, "both", 4).collect()
        assert {x.id: x.depth for x in got} == depth and {x.id: x.parent_id for x in got if x.depth} == parent
        assert [tuple(x) for x in traverse.find_path(g, 0, far, 10).orderBy("pos").collect()] == want
        stopped = {x.id for x in traverse.bfs(g, 0, "both", 4, stop=F.col("id") == far).collect()}
        assert far in stopped and stopped <= set(depth)


def test_dfs_against_python(spark):
    r = random.Random(5)
    edges = [(f"e{i}", i, r.randrange(15), r.randrange(15), "E", {}) for i in range(30)]
    near = {a: sorted({e[3] for e in edges if e[2] == a} | {e[2] for e in edges if e[3] == a}) for a in range(15)}
    seen, order = set(), []

    def visit(a, d):
        if d >= 4 or a in seen:
            return
        seen.add(a)
        order.append((a, d))
        for b in near[a]:
            visit(b, d + 1)

    visit(0, 0)
    got = traverse.dfs(Graph.of(spark, [(i, "N", {}) for i in range(15)], edges), 0, "both", 4).orderBy("visit_order").collect()
    assert [(x.id, x.depth) for x in got] == order


def test_property_index(g, spark):
    p = index.property_table(g.nodes)
    assert ids(index.holding(p, "title", "Petrel"), "entity_id") == [10] and ids(index.having(p, "tons"), "entity_id") == [10, 20, 30]
    assert index.first_holding(p, "title", "Nobody").count() == 0
    assert index.contains(p, "tons").first().present and not index.contains(p, "tons", "99").first().present
    assert ids(index.having(index.without(p, "tons", "310"), "tons"), "entity_id") == [20, 30]
    assert ids(index.in_range(p, "tons", 270, 310), "entity_id") == [10, 20] and ids(index.with_token(p, "title", "quay"), "entity_id") == [40]


def test_value_types(spark):
    want = {"Petrel": "string", "30": "numeric", "98.5": "numeric", "true": "boolean", "FALSE": "boolean", " 30": "string", "30d": "string", "1e999": "string", "-Inf": "numeric", "nan": "numeric", ".5": "numeric", "5.": "numeric", "": "string", "+": "string", "1e5": "numeric"}
    df = spark.createDataFrame([(k,) for k in want], "v string")
    assert {r.v: r.t for r in df.select("v", index.value_type(F.col("v")).alias("t")).collect()} == want


def test_batch_writes(g, spark):
    gone = spark.createDataFrame([(10,)], "id bigint")
    left = writes.delete_nodes(g, gone)
    assert left.edges.count() == 6 and ids(left.nodes) == [20, 30, 40, 50]
    assert ids(writes.delete_nodes(g, gone, cascade=True).edges, "edge_id") == ["c2", "c3", "f3"]
    updates = spark.createDataFrame([(10, "tons", "311", 1), (10, "tons", "312", 2), (20, "new", "x", 1)], "id bigint, name string, value string, seq int")
    bags = {r.id: r.properties for r in writes.set_properties(g.nodes, "id", updates).collect()}
    assert bags[10] == {"title": "Petrel", "tons": "312"} and bags[20] == {"title": "Heron", "tons": "275", "new": "x"} and bags[30] == NODES[2][2]
    assert ids(writes.invalid_ends(left.edges, left.nodes)) == [10]
    more = spark.createDataFrame([("n", 9, 10, 77, "X", {})], g.edges.schema)
    with pytest.raises(Exception, match="node not found: 77"):
        writes.add_edges(g, more).edges.collect()


def test_remembered_results(g):
    s = GraphSession(graph=g, remember=2)
    for label in ("Ship", "Ship", "Harbour", "Ship", "Quay", "Harbour"):
        assert s.execute(f'FIND_NODES_BY_LABEL(label: "{label}")').nodes.count() == {"Ship": 3, "Harbour": 2, "Quay": 0}[label]
    assert s.cache_stats == {"hits": 2, "misses": 4}


def test_session_reads(g):
    s = GraphSession(graph=g)
    d = s.execute('FIND_PATH(sourceId: "10", targetId: "50", maxHops: "x")').to_dict()
    assert [x["label"] for x in d["path"]] == ["Ship", "Ship", "Harbour"]
    d = s.execute('{"type": "FIND_NEIGHBORS", "parameters": {"nodeId": "10", "direction": "outgoing"}}').to_dict()
    assert len(d["nodes"]) == 3 and len(d["edges"]) == 3
    with pytest.raises(GraphError):
        s.execute('CREATE_NODE(label: "X")')


def test_recorded_states(spark):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    nodes = spark.createDataFrame([(1, "A", {"v": "old"}, t, t), (1, "A", {"v": "new"}, t, None), (2, "A", None, t, t), (None, "A", None, t, None)], "id bigint, label string, properties map<string,string>, created_at timestamp_ntz, deleted_at timestamp_ntz")
    edges = spark.createDataFrame([("a", 2, 1, 2, "L", None), ("a", 1, 1, 2, "L", None)], "edge_id string, ord bigint, source_id bigint, target_id bigint, label string, properties map<string,string>")
    g = Graph.of_states(nodes, edges)
    assert ids(g.nodes) == [1] and [(r.edge_id, r.ord) for r in g.edges.collect()] == [("a", 1)]
