"""Nodes, edges and graphs as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROPERTIES = T.MapType(T.StringType(), T.StringType())
NODE_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("properties", PROPERTIES)])
EDGE_SCHEMA = T.StructType(
    [
        T.StructField("edge_id", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("source_id", T.LongType()),
        T.StructField("target_id", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("properties", PROPERTIES),
    ]
)
NODE, EDGE = [f.name for f in NODE_SCHEMA], [f.name for f in EDGE_SCHEMA]
MOST_ID = (1 << 63) - 1


class GraphError(Exception):
    """A query or write that can't be carried out."""


class InvalidQuery(GraphError):
    """Text that is no query."""


class NotFound(GraphError):
    """A node, edge, transaction or key that doesn't exist."""


class TransactionError(GraphError):
    """A transaction that is over, read-only, or waited too long."""


def parse_id(text: str | int, what: str = "node") -> int:
    """An id in base 10 without sign or blanks, below 2**63."""
    s = str(text)
    if not (s.isascii() and s.isdigit()) or int(s) > MOST_ID:
        raise GraphError(f"invalid {what} ID: {text!r}")
    return int(s)


@dataclass(frozen=True)
class Graph:
    """``nodes``: id, label, properties; ``edges``: edge_id, ord, source_id, target_id, label, properties.

    ``ord`` is any unique orderable column; it gives the order in which a node's edges are followed.
    ``node_at`` and ``edges_at`` are for views that find the rows of an id without looking at all of them.
    """

    nodes: DataFrame
    edges: DataFrame
    node_at: Callable[[int], DataFrame] | None = None
    edges_at: Callable[[int, str], DataFrame] | None = None

    def node(self, node_id: int) -> DataFrame:
        return self.node_at(node_id) if self.node_at else self.nodes.where(F.col("id") == node_id)

    def edges_from(self, node_id: int) -> DataFrame:
        return self.edges_at(node_id, "source") if self.edges_at else self.edges.where(F.col("source_id") == node_id)

    def edges_to(self, node_id: int) -> DataFrame:
        return self.edges_at(node_id, "target") if self.edges_at else self.edges.where(F.col("target_id") == node_id)

    @classmethod
    def of(cls, spark: SparkSession, nodes: list[tuple], edges: list[tuple]) -> Graph:
        return cls(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(edges, EDGE_SCHEMA))

    @classmethod
    def of_states(cls, nodes: DataFrame, edges: DataFrame) -> Graph:
        """From tables of recorded states: living nodes (a state without ``deleted_at``), edges without their copies."""
        alive = nodes.where(F.col("id").isNotNull() & F.col("deleted_at").isNull()).groupBy("id").agg(F.max_by(F.struct("label", "properties"), F.struct("created_at", F.col("label"))).alias("s"))
        first = F.min_by(F.struct("ord", "source_id", "target_id", "label", "properties"), "ord").alias("s")
        return cls(alive.select("id", "s.*"), edges.where(F.col("edge_id").isNotNull()).groupBy("edge_id").agg(first).select("edge_id", "s.*"))
