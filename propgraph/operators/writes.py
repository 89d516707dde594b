"""Batch writes over whole tables, lazily: the bulk counterparts of the transactional verbs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph


def delete_nodes(graph: Graph, ids: DataFrame, cascade: bool = False) -> Graph:
    """Without the nodes of ``ids`` (id). Edges stay and dangle, unless ``cascade``."""
    nodes = graph.nodes.join(ids.select("id"), "id", "left_anti")
    if not cascade:
        return Graph(nodes, graph.edges)
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    kept = graph.edges
    for end in ("source_id", "target_id"):
        kept = kept.join(gone, F.col(end) == F.col("_gone"), "left_anti")
    return Graph(nodes, kept)


def delete_edges(graph: Graph, ids: DataFrame) -> Graph:
    """Without the edges of ``ids`` (edge_id)."""
    return Graph(graph.nodes, graph.edges.join(ids.select("edge_id"), "edge_id", "left_anti"))


def set_property(df: DataFrame, where: Column, name: str, value: Column) -> DataFrame:
    """Property ``name`` set in the rows that meet ``where``; a null value leaves the row as it is."""
    bag = F.coalesce(F.col("properties"), F.create_map().cast("map<string,string>"))
    new = F.map_concat(F.map_filter(bag, lambda k, _: k != name), F.create_map(F.lit(name), value.cast("string")))
    return df.withColumn("properties", F.when(where & value.isNotNull(), new).otherwise(F.col("properties")))


def set_properties(df: DataFrame, key: str, updates: DataFrame) -> DataFrame:
    """Upsert ``updates`` (key, name, value, seq): per entity and name the value with the highest ``seq``."""
    last = updates.groupBy(key, "name").agg(F.max(F.struct("seq", "value")).alias("u"))
    bags = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", F.col("u.value")))).alias("_new"))
    old = F.coalesce(F.col("properties"), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key("_new", k)), F.col("_new"))
    return df.join(bags, key, "left").withColumn("properties", F.when(F.col("_new").isNotNull(), merged).otherwise(F.col("properties"))).drop("_new")


def remove_property(df: DataFrame, where: Column, name: str) -> DataFrame:
    return df.withColumn("properties", F.when(where, F.map_filter("properties", lambda k, _: k != name)).otherwise(F.col("properties")))


def invalid_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that isn't among the nodes: what a batch of new edges must not have."""
    known = nodes.select(F.col("id").alias("_known")).distinct()
    bad = lambda end: edges.where(F.col(end).isNotNull()).join(known, F.col(end) == F.col("_known"), "left_anti").select(F.col(end).alias("id"))
    return bad("source_id").unionByName(bad("target_id")).distinct()


def add_edges(graph: Graph, new: DataFrame) -> Graph:
    """With new edges, whose ends must exist: a missing one fails the job that meets it."""
    known = graph.nodes.select(F.col("id").alias("_known")).distinct().withColumn("_there", F.lit(True))
    for end in ("source_id", "target_id"):
        new = new.join(known, F.col(end) == F.col("_known"), "left").drop("_known")
        new = new.where(F.coalesce(F.col("_there"), F.raise_error(F.concat(F.lit("node not found: "), F.coalesce(F.col(end).cast("string"), F.lit("null")))).cast("boolean"))).drop("_there")
    return Graph(graph.nodes, graph.edges.unionByName(new.select(*graph.edges.columns)))
