import threading
import time

import pytest

from propgraph.model import Graph, GraphError, NotFound, TransactionError
from propgraph.session import GraphSession
from propgraph.sources import files
from propgraph.sources.manifests import Conflict, Manifests
from propgraph.sources.store import GraphStore
from propgraph.txn import HIGH, LOW, TransactionManager


@pytest.fixture
def session(spark, tmp_path):
    return GraphSession.open(spark, str(tmp_path / "g"))


def run(s, text):
    return s.execute(text)


def test_verbs_end_to_end(session, spark):
    s = session
    assert [run(s, 'CREATE_NODE(label: "Person")').entity_id for _ in range(2)] == ["1", "2"]
    e = run(s, 'CREATE_EDGE(sourceId: "1", targetId: "2", label: "KNOWS")').entity_id
    run(s, 'SET_PROPERTY(target: "node", id: "1", name: "name", value: "Ann")')
    run(s, 'SET_PROPERTY(target: "node", id: "1", name: "name", value: "Alice, the \\"first\\"")')
    run(s, f'SET_PROPERTY(target: "edge", id: "{e}", name: "since", value: "2020")')
    assert run(s, 'FIND_NODES_BY_PROPERTY(propertyName: "name", propertyValue: "Alice, the \\"first\\"")').to_dict()["nodes"][0]["id"] == 1
    assert run(s, 'FIND_NODES_BY_PROPERTY(propertyName: "name", propertyValue: "Ann")').nodes.count() == 0
    assert run(s, 'FIND_EDGES_BY_PROPERTY(propertyName: "since", propertyValue: "2020")').edges.count() == 1
    run(s, f'REMOVE_PROPERTY(target: "edge", id: "{e}", name: "since")')
    run(s, f'REMOVE_PROPERTY(target: "edge", id: "{e}", name: "never there")')
    assert run(s, 'FIND_EDGES_BY_PROPERTY(propertyName: "since", propertyValue: "2020")').edges.count() == 0
    assert [r["node_id"] for r in run(s, 'FIND_PATH(sourceId: "2", targetId: "1")').to_dict()["path"]] == [2, 1]
    run(s, 'DELETE_NODE(id: "2")')
    assert run(s, 'FIND_EDGES_BY_LABEL(label: "KNOWS")').edges.count() == 1  # no cascade
    assert run(s, 'FIND_NEIGHBORS(nodeId: "1")').nodes.count() == 0
    run(s, f'DELETE_EDGE(id: "{e}")')
    assert run(s, 'FIND_EDGES_BY_LABEL(label: "KNOWS")').edges.count() == 0
    assert run(s, 'CREATE_NODE(label: "Person")').entity_id == "3"
    again = GraphSession.open(spark, s.store.path)
    assert again.has_node(1) and not again.has_node(2) and run(again, 'CREATE_NODE(label: "X")').entity_id == "4"


@pytest.mark.parametrize("text", ['DELETE_NODE(id: "9")', 'DELETE_EDGE(id: "9")', 'CREATE_EDGE(sourceId: "1", targetId: "9", label: "L")', 'SET_PROPERTY(target: "node", id: "9", name: "a", value: "b")', 'CREATE_EDGE(source: "$x", targetId: "1", label: "L")', 'COMMIT_TRANSACTION(txId: "tx-99")'])
def test_missing_things(session, text):
    run(session, 'CREATE_NODE(label: "A")')
    before = session.store.manifest().version
    with pytest.raises(NotFound):
        run(session, text)
    assert session.store.manifest().version == before and session.transactions.stats()["writer"] is None


def test_transaction_isolation_and_rollback(session):
    s = session
    run(s, 'CREATE_NODE(label: "A")')
    tx = run(s, "BEGIN_TRANSACTION()").tx_id
    run(s, f'CREATE_NODE(label: "B", ref: "b", txId: "{tx}")')
    run(s, f'CREATE_EDGE(source: "1", targetId: "$b", label: "L", txId: "{tx}")')
    run(s, f'DELETE_NODE(id: "1", txId: "{tx}")')
    assert run(s, 'FIND_NODES_BY_LABEL(label: "B")').nodes.count() == 0
    assert run(s, f'FIND_NODES_BY_LABEL(label: "B", txId: "{tx}")').nodes.count() == 1
    assert run(s, f'FIND_NODES_BY_LABEL(label: "A", txId: "{tx}")').nodes.count() == 0
    run(s, f'ROLLBACK_TRANSACTION(txId: "{tx}")')
    assert s.has_node(1) and run(s, 'FIND_EDGES_BY_LABEL(label: "L")').edges.count() == 0
    with pytest.raises(NotFound):
        run(s, f'COMMIT_TRANSACTION(txId: "{tx}")')
    tx = run(s, "BEGIN_TRANSACTION()").tx_id
    run(s, f'CREATE_NODE(label: "C", txId: "{tx}")')
    run(s, f'COMMIT_TRANSACTION(txId: "{tx}")')
    assert run(s, 'FIND_NODES_BY_LABEL(label: "C")').nodes.count() == 1
    with pytest.raises(GraphError, match="missing transaction ID"):
        run(s, "COMMIT_TRANSACTION()")


def test_queue(spark, tmp_path):
    m = TransactionManager(GraphStore(spark, str(tmp_path / "g")))
    first = m.begin()
    with pytest.raises(TransactionError):
        m.begin(timeout=0.1)
    reader = m.begin(read_only=True)
    with pytest.raises(TransactionError):
        m.create_node(reader, "A")
    order = []

    def wait(priority, name):
        tx = m.begin(priority=priority)
        order.append(name)
        m.rollback(tx)

    threads = []
    for priority, name in ((LOW, "low"), (HIGH, "high 1"), (HIGH, "high 2")):
        threads.append(threading.Thread(target=wait, args=(priority, name)))
        threads[-1].start()
        time.sleep(0.2)
    m.commit(first)
    for t in threads:
        t.join(20)
    assert order == ["high 1", "high 2", "low"] and m.stats()["timed_out"] == 1 and m.stats()["waiting"] == 0


def test_versions(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), compact_after=2)
    s = GraphSession(store)
    t = time.time()
    for label in "ABC":
        run(s, f'CREATE_NODE(label: "{label}")')
    snapshot = store.graph(1)
    assert [r.label for r in snapshot.nodes.collect()] == ["A"]
    assert len(store.manifest().folders) <= 2 and sorted(r.label for r in store.graph().nodes.collect()) == ["A", "B", "C"]
    assert store.as_of(time.time() + 99).nodes.count() == 3
    with pytest.raises(GraphError):
        store.as_of(-1)
    with pytest.raises(NotFound):
        store.as_of(t - 1000)
    stale = store.manifest(1)
    with pytest.raises(GraphError, match="another writer"):
        store._publish(stale)
    assert not store.vacuum() and len(store.versions()) > 1  # within the retention
    assert store.vacuum(keep=1, older_than=0) and store.versions() == [store.manifest().version] and store.graph().nodes.count() == 3
    store.load(Graph.of(spark, [(10, "Z", {})], [("7", 1, 10, 10, "L", {})]))
    assert run(s, 'CREATE_NODE(label: "Y")').entity_id == "11" and store.stats()["nodes"] == 2


def test_files_in_use_survive(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    s = GraphSession(store)
    run(s, 'CREATE_NODE(label: "A")')
    reader = s.transactions.begin(read_only=True)
    writer = s.transactions.begin()
    s.transactions.create_node(writer, "B")
    nodes, edges = s.transactions._delta(writer)
    folder = store._write(nodes, edges)
    store.compact()
    store.vacuum(older_than=0)
    assert [r.label for r in s.transactions.view(reader).nodes.collect()] == ["A"]
    base = store.manifest()
    store._next(base, [*base.folders, folder], [*base.rows, 1], 3, 1, 1)
    assert sorted(r.label for r in store.graph().nodes.collect()) == ["A", "B"]
    s.transactions.rollback(reader)
    s.transactions.rollback(writer)
    assert store.vacuum(older_than=0) and sorted(r.label for r in store.graph().nodes.collect()) == ["A", "B"]


def test_two_writers_of_one_store(spark, tmp_path):
    """Managers of different processes: the slower commit fails and changes nothing."""
    one, two = (TransactionManager(GraphStore(spark, str(tmp_path / "g"))) for _ in range(2))
    a, b = one.begin(), two.begin()
    one.create_node(a, "A")
    two.create_node(b, "B")
    one.commit(a)
    with pytest.raises(GraphError, match="another writer"):
        two.commit(b)
    assert [r.label for r in two.store.graph().nodes.collect()] == ["A"] and two.stats()["writer"] is None


def test_a_number_is_published_once(spark, tmp_path):
    m, won = Manifests(spark, str(tmp_path / "m")), []

    def publish(i):
        try:
            m.publish(7, {"by": i})
            won.append(i)
        except Conflict:
            pass

    for _ in range(3):
        threads = [threading.Thread(target=publish, args=(i,)) for i in range(6)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert len(won) == 1 and m.read_all() == {7: {"by": won[0]}}
        m.delete(7)
        won.clear()


def test_tiers_and_plans(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), compact_after=3)
    store.load(Graph.of(spark, [(i, "Old", {"n": str(i)}) for i in range(100)], [(str(i), i, i, i + 1, "E", {}) for i in range(99)]))
    base, s = store.manifest().folders[0], GraphSession(store)
    for i in range(8):
        run(s, f'SET_PROPERTY(target: "node", id: "{i}", name: "n", value: "new")')
    run(s, 'DELETE_NODE(id: "1")')
    m = store.manifest()
    assert m.folders[0] == base and len(m.folders) <= 3 and m.rows[0] == 199
    assert store.graph().nodes.count() == 99 and run(s, 'FIND_NODES_BY_PROPERTY(propertyName: "n", propertyValue: "new")').nodes.count() == 7
    # the label reaches the base's scan, and the base isn't shuffled
    plan = run(s, 'FIND_NODES_BY_LABEL(label: "Old")').nodes._jdf.queryExecution().executedPlan().toString()
    join = plan.index("LeftAnti")
    of_base = plan[join : plan.index("BroadcastExchange", join)]
    assert "EqualTo(label,Old)" in of_base and "hashpartitioning" not in of_base


@pytest.mark.parametrize("kind", files.FORMATS)
def test_files(spark, tmp_path, kind):
    g = Graph.of(spark, [(1, "A", {"k": 'v,"x'}), (2, "B", {})], [("e", 1, 1, 2, "L", {"q": "ü"})])
    paths = str(tmp_path / "n"), str(tmp_path / "e")
    files.save(g, *paths, kind)
    back = files.load(spark, *paths, kind)
    assert sorted((r.id, r.label, r.properties) for r in back.nodes.collect()) == [(1, "A", {"k": 'v,"x'}), (2, "B", {})]
    assert [(r.edge_id, r.source_id, r.properties) for r in back.edges.collect()] == [("e", 1, {"q": "ü"})]


def test_negative_ids_are_refused(spark, tmp_path):
    files.save(Graph.of(spark, [(-1, "A", {})], []), str(tmp_path / "n"), str(tmp_path / "e"), by_label=True)
    with pytest.raises(Exception, match="invalid id"):
        files.load(spark, str(tmp_path / "n"), str(tmp_path / "e")).nodes.collect()
