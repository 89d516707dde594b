"""``GraphSession``: queries in text or JSON against a stored graph or a given one.

``python -m propgraph.session PATH QUERY...`` runs queries and prints JSON.
"""

from __future__ import annotations

import json
import sys
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Graph, GraphError
from .operators import reads, traverse
from .plans.language import Query, normalize, parse
from .sources.store import GraphStore
from .txn import Transaction, TransactionManager


@dataclass
class Result:
    """Up to three lazy tables, or the status of a write."""

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    path: DataFrame | None = None
    status: str = "ok"
    tx_id: str | None = None
    entity_id: str | None = None

    def rows(self) -> Iterator[tuple[str, dict]]:
        """Rows one by one, without gathering them first."""
        for kind in ("nodes", "edges", "path"):
            df = getattr(self, kind)
            for row in df.toLocalIterator() if df is not None else ():
                yield kind, row.asDict(recursive=True)

    def to_dict(self) -> dict:
        out: dict = {k: v for k, v in (("status", self.status), ("txId", self.tx_id), ("id", self.entity_id)) if v is not None}
        for kind in ("nodes", "edges", "path"):
            if getattr(self, kind) is not None:
                out[kind] = []
        for kind, row in self.rows():
            out[kind].append(row)
        return out


class GraphSession:
    """``open`` for a stored graph, which can be written; ``GraphSession(graph=…)`` only reads."""

    def __init__(self, store: GraphStore | None = None, graph: Graph | None = None, most_hops: int = 10, lock_timeout: float = 5.0, remember: int = 0):
        """``remember``: results of so many reads are kept (persisted by Spark), the least recently used given up first."""
        self.store, self.fixed, self.most_hops, self.lock_timeout = store, graph, most_hops, lock_timeout
        self.remember, self.cache_stats = remember, {"hits": 0, "misses": 0}
        self._results: OrderedDict[tuple, Result] = OrderedDict()
        self.transactions = TransactionManager(store) if store else None

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> GraphSession:
        return cls(GraphStore(spark, path))

    def execute(self, query: str | Query) -> Result:
        q = normalize(parse(query) if isinstance(query, str) else query, self.most_hops)
        p = q.parameters
        if q.type.endswith("_TRANSACTION"):
            return self._transaction(q)
        if q.type.startswith("FIND_"):
            return self._remembered(q) if self.remember and "txId" not in p else self._read(q, self._graph(p.get("txId")))
        m = self._manager()
        if "txId" in p:
            return self._write(q, m.get(p["txId"]))
        tx = m.begin(timeout=self.lock_timeout)
        try:
            result = self._write(q, tx)
        except BaseException:
            m.rollback(tx)
            raise
        m.commit(tx)
        return result

    def _remembered(self, q: Query) -> Result:
        """Reads of one version never change, so a result is good for its query and version."""
        key = (self.store.manifest().version if self.store else None, str(q))
        if key in self._results:
            self._results.move_to_end(key)
            self.cache_stats["hits"] += 1
            return self._results[key]
        self.cache_stats["misses"] += 1
        found = self._read(q, self._graph(None) if self.store is None else self.store.graph(key[0]))
        kept = Result(*(df.persist() if df is not None else None for df in (found.nodes, found.edges, found.path)))
        self._results[key] = kept
        while len(self._results) > self.remember:
            _, old = self._results.popitem(last=False)
            for df in (old.nodes, old.edges, old.path):
                if df is not None:
                    df.unpersist()
        return kept

    def _manager(self) -> TransactionManager:
        if self.transactions is None:
            raise GraphError("this session only reads")
        return self.transactions

    def _graph(self, tx: str | None) -> Graph:
        if tx is not None:
            return self._manager().view(self._manager().get(tx))
        return self.fixed if self.store is None else self.store.graph()

    def _transaction(self, q: Query) -> Result:
        m = self._manager()
        if q.type == "BEGIN_TRANSACTION":
            return Result(status="transaction started", tx_id=m.begin(timeout=self.lock_timeout).id)
        if "txId" not in q.parameters:
            raise GraphError("missing transaction ID")
        tx = m.get(q.parameters["txId"])
        (m.commit if q.type == "COMMIT_TRANSACTION" else m.rollback)(tx)
        return Result(status=f"transaction {tx.state}", tx_id=tx.id)

    def _read(self, q: Query, g: Graph) -> Result:
        p = q.parameters
        if q.type == "FIND_NODES_BY_LABEL":
            return Result(nodes=reads.nodes_by_label(g, p["label"]))
        if q.type == "FIND_EDGES_BY_LABEL":
            return Result(edges=reads.edges_by_label(g, p["label"]))
        if q.type == "FIND_NODES_BY_PROPERTY":
            return Result(nodes=reads.nodes_by_property(g, p["propertyName"], p["propertyValue"]))
        if q.type == "FIND_EDGES_BY_PROPERTY":
            return Result(edges=reads.edges_by_property(g, p["propertyName"], p["propertyValue"]))
        if q.type == "FIND_NEIGHBORS":
            nodes, edges = reads.find_neighbors(g, p["nodeId"], p["direction"])
            return Result(nodes=nodes, edges=edges)
        path = traverse.find_path(g, p["sourceId"], p["targetId"], int(p["maxHops"]))
        on = path.join(g.nodes, path["node_id"] == g.nodes["id"], "left").select("pos", "node_id", "label", "properties", "edge_id")
        return Result(path=on.orderBy("pos"))

    def _write(self, q: Query, tx: Transaction) -> Result:
        m, p = self._manager(), q.parameters
        new = None
        if q.type == "CREATE_NODE":
            new = str(m.create_node(tx, p["label"], p.get("ref")))
        elif q.type == "CREATE_EDGE":
            new = m.create_edge(tx, p["sourceId"] if "sourceId" in p else p["source"], p["targetId"], p["label"], p.get("ref"))
        elif q.type == "DELETE_NODE":
            m.delete_node(tx, p["id"])
        elif q.type == "DELETE_EDGE":
            m.delete_edge(tx, p["id"])
        elif q.type == "SET_PROPERTY":
            m.set_property(tx, p["target"], p["id"], p["name"], p["value"])
        else:
            m.remove_property(tx, p["target"], p["id"], p["name"])
        return Result(tx_id=tx.id, entity_id=new)

    def has_node(self, node_id: str | int) -> bool:
        return not reads.get_node(self._graph(None), node_id).where(F.lit(True)).isEmpty()


def main(args: list[str]) -> None:
    session = GraphSession.open(SparkSession.builder.appName("propgraph").getOrCreate(), args[0])
    for text in args[1:]:
        print(json.dumps(session.execute(text).to_dict(), ensure_ascii=False, default=str))


if __name__ == "__main__":
    main(sys.argv[1:])
