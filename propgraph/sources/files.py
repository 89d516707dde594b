"""Loading graphs from files and writing them. An extension: everything Spark reads with a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGE, EDGE_SCHEMA, MOST_ID, NODE, NODE_SCHEMA, Graph

FORMATS = ("parquet", "orc", "json", "csv")


def _read(spark: SparkSession, kind: str, path: str, schema) -> DataFrame:
    if kind not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if kind == "csv":  # CSV has no maps: properties are JSON text
        flat = spark.read.schema(", ".join(f"`{f.name}` {'string' if f.name == 'properties' else f.dataType.simpleString()}" for f in schema)).csv(path, header=True, escape='"')
        return flat.withColumn("properties", F.from_json("properties", "map<string,string>"))
    return spark.read.schema(schema).format(kind).load(path)


def _checked(df: DataFrame, columns: list[str]) -> DataFrame:
    """Ids beyond what a signed 64-bit integer holds, or negative ones, fail the job that meets them."""
    for c in columns:
        df = df.where(F.when(F.col(c).cast("decimal(20,0)").between(0, MOST_ID) | F.col(c).isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"invalid {c}: "), F.col(c).cast("string")))))
    return df


def load(spark: SparkSession, nodes: str, edges: str, kind: str = "parquet") -> Graph:
    return Graph(_checked(_read(spark, kind, nodes, NODE_SCHEMA), ["id"]), _checked(_read(spark, kind, edges, EDGE_SCHEMA), ["source_id", "target_id"]))


def save(graph: Graph, nodes: str, edges: str, kind: str = "parquet", by_label: bool = False) -> None:
    """``by_label``: one folder per label, so that label lookups read no other (Parquet and ORC)."""
    for df, columns, path in ((graph.nodes, NODE, nodes), (graph.edges, EDGE, edges)):
        out = df.select(*columns)
        if kind == "csv":
            out = out.withColumn("properties", F.to_json("properties"))
        writer = out.write.format(kind)
        if kind == "csv":
            writer = writer.options(header=True, escape='"')
        (writer.partitionBy("label") if by_label else writer).save(path)
