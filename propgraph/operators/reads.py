"""Lookups by label, property, id and neighbourhood. All are lazy filters and semi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph, NotFound, parse_id


def nodes_by_label(graph: Graph, label: str) -> DataFrame:
    """Nodes with exactly that label; none if there are none."""
    return graph.nodes.where(F.col("label") == label)


def edges_by_label(graph: Graph, label: str) -> DataFrame:
    return graph.edges.where(F.col("label") == label)


def by_property(df: DataFrame, name: str, value: str) -> DataFrame:
    """Rows whose property ``name`` exists and equals ``value`` as text."""
    return df.where(F.col("properties")[name.strip()] == value)


def nodes_by_property(graph: Graph, name: str, value: str) -> DataFrame:
    return by_property(graph.nodes, name, value)


def edges_by_property(graph: Graph, name: str, value: str) -> DataFrame:
    return by_property(graph.edges, name, value)


def by_number(df: DataFrame, name: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows whose property is a number within the bounds (either may be open). An extension."""
    number = F.col("properties")[name].try_cast("double")
    return df.where((number >= low if low is not None else number.isNotNull()) & (number <= high if high is not None else F.lit(True)))


def get_node(graph: Graph, node_id: str | int) -> DataFrame:
    return graph.node(parse_id(node_id)).limit(1)


def get_edge(graph: Graph, edge_id: str) -> DataFrame:
    return graph.edges.where(F.col("edge_id") == edge_id).limit(1)


def require_node(graph: Graph, node_id: str | int, what: str = "node") -> int:
    """The id, if there is such a node."""
    n = parse_id(node_id)
    if graph.node(n).select("id").isEmpty():
        raise NotFound(f"{what} not found: {n}")
    return n


def incident_edges(graph: Graph, node_id: int, direction: str = "both") -> DataFrame:
    """Edges at a node: outgoing, incoming, or both as a bag, in which a loop is twice."""
    out, into = graph.edges_from(node_id), graph.edges_to(node_id)
    return {"outgoing": out, "incoming": into, "both": out.unionByName(into)}[direction]


def neighbours(graph: Graph, node_id: int, direction: str = "both") -> DataFrame:
    """The distinct existing nodes at the other ends; a node with a loop is its own neighbour."""
    ends = {
        "outgoing": graph.edges_from(node_id).select(F.col("target_id").alias("id")),
        "incoming": graph.edges_to(node_id).select(F.col("source_id").alias("id")),
    }
    ids = ends["outgoing"].unionByName(ends["incoming"]) if direction == "both" else ends[direction]
    return graph.nodes.join(ids.distinct(), "id", "left_semi")


def find_neighbors(graph: Graph, node_id: str | int, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Neighbour nodes and incident edges of a node that must exist."""
    n = require_node(graph, node_id)
    return neighbours(graph, n, direction), incident_edges(graph, n, direction)


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def degrees(graph: Graph) -> DataFrame:
    """Outgoing and incoming edges per node id that has any. An extension."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("id"), F.lit(0).alias("o")))).alias("e"))
    return ends.where(F.col("e.id").isNotNull()).groupBy(F.col("e.id").alias("id")).agg(F.sum("e.o").alias("n_out"), F.sum(1 - F.col("e.o")).alias("n_in"))
