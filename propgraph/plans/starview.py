"""A property graph over the star-schema tables, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph
from ..runtime import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
#: Ids are a table's number times ten to the tenth plus the key, so that labels never share ids.
BASE = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "orders": 6}


def _id(t: str, column: str) -> str:
    return f"{BASE[t]}0000000000 + {column}"


_KEYS = {"region": ("Region", "r_regionkey"), "nation": ("Nation", "n_nationkey"), "customer": ("Customer", "c_custkey"), "supplier": ("Supplier", "s_suppkey"), "part": ("Part", "p_partkey"), "orders": ("Order", "o_orderkey")}
_NAMED = {
    "region": {"name": "r_name"},
    "nation": {"name": "n_name"},
    "customer": {"name": "c_name", "segment": "c_mktsegment"},
    "supplier": {"name": "s_name"},
    "part": {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "cast(p_size as varchar(11))"},
    "orders": {"status": "o_orderstatus", "priority": "o_orderpriority"},
}
NODES = " union all ".join(f"select {_id(t, k)} as id, '{label}' as label from {{{t}}}" for t, (label, k) in _KEYS.items())
PROPS = " union all ".join(f"select {_id(t, _KEYS[t][1])} as id, '{name}' as name, {c} as value from {{{t}}}" for t, names in _NAMED.items() for name, c in names.items())
#: Label, table, source table and column, target table and column, quantity, grouping.
_EDGES = (
    ("IN_REGION", "nation", "nation", "n_nationkey", "region", "n_regionkey", "cast(null as varchar(20))", False),
    ("LOCATED_IN", "customer", "customer", "c_custkey", "nation", "c_nationkey", "cast(null as varchar(20))", False),
    ("LOCATED_IN", "supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "cast(null as varchar(20))", False),
    ("PLACED", "orders", "customer", "o_custkey", "orders", "o_orderkey", "cast(null as varchar(20))", False),
    ("CONTAINS", "lineitem", "orders", "l_orderkey", "part", "l_partkey", "cast(cast(sum(l_quantity) as bigint) as varchar(20))", True),
    ("SUPPLIES", "lineitem", "supplier", "l_suppkey", "part", "l_partkey", "cast(count(*) as varchar(20))", True),
)


def _edge(label: str, t: str, source: str, a: str, target: str, b: str, qty: str, grouped: bool, where: str = "") -> str:
    return f"select '{label}' as label, {_id(source, a)} as source_id, {_id(target, b)} as target_id, {qty} as qty from {{{t}}}{where}" + (f" group by {a}, {b}" if grouped else "")


EDGES = " union all ".join(_edge(*e) for e in _EDGES)


LABELS = ["CONTAINS", "IN_REGION", "LOCATED_IN", "PLACED", "SUPPLIES"]


def sql(text: str) -> str:
    """With the tables under their own names."""
    return text.format(**{t: t for t in TABLES})


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text})


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PROPS)


def edges(spark: SparkSession, sf_dir: str, text: str = EDGES) -> DataFrame:
    """Edges with an id and an order made of label and ends, which together are unique."""
    e = view(spark, sf_dir, text)
    bag = F.when(F.col("qty").isNotNull(), F.create_map(F.lit("qty"), F.col("qty"))).otherwise(F.create_map().cast("map<string,string>"))
    number = F.array_position(F.lit(LABELS), F.col("label")).cast("int").alias("label_no")  # in the labels' order, but narrower
    return e.select(
        F.concat_ws(":", "label", "source_id", "target_id").alias("edge_id"), F.struct(number, "source_id", "target_id").alias("ord"), "source_id", "target_id", "label", bag.alias("properties")
    )


def _place(node_id: int) -> tuple[str | None, int]:
    """The table an id belongs to, and its key there."""
    number, key = divmod(node_id, 10**10)
    return next((t for t, n in BASE.items() if n == number), None), key


def edges_at(spark: SparkSession, sf_dir: str, node_id: int, end: str) -> DataFrame:
    """The edges with that source (or target): only tables that have some are read, with the key in the scan's filter."""
    t, key = _place(node_id)
    own = [(e, e[3] if end == "source" else e[5]) for e in _EDGES if (e[2] if end == "source" else e[4]) == t]
    text = " union all ".join(_edge(*e, where=f" where {column} = {key}") for e, column in own) or _edge(*_EDGES[0], where=" where false")
    return edges(spark, sf_dir, text)


def _bag(columns: dict[str, str]) -> str:
    return "map(" + ", ".join(f"'{n}', {c}" for n, c in columns.items()) + ")"


def _node(t: str, where: str = "") -> str:
    label, k = _KEYS[t]
    return f"select {_id(t, k)} as id, '{label}' as label, {_bag(_NAMED[t])} as properties from {{{t}}}{where}"


def node_at(spark: SparkSession, sf_dir: str, node_id: int) -> DataFrame:
    t, key = _place(node_id)
    return view(spark, sf_dir, _node(t, f" where {_KEYS[t][1]} = {key}") if t else _node("region", " where false"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nodes carry their properties from the tables' columns, without a join; an id is looked up by its table's key."""
    nodes = view(spark, sf_dir, " union all ".join(_node(t) for t in _KEYS))
    return Graph(nodes, edges(spark, sf_dir), lambda n: node_at(spark, sf_dir, n), lambda n, end: edges_at(spark, sf_dir, n, end))
