"""Queries for the graph, index, key-value and log operators, and the SQL that gives the same rows.

The graph is the view over the star-schema tables of ``plans.starview``, or ``nodes`` and ``edges``
themselves; the log is made of ``events``, or is ``wal_records``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import index, kv, oplog, reads, traverse, writes
from .operators.changes import EqualityDeleteTable
from .plans import starview
from .queries import _P2, QUERIES, query  # noqa: F401
from .model import Graph, GraphError, TransactionError
from .plans import language
from .runtime import scratch_path, table
from .session import GraphSession
from .sources import files
from .sources.log import LogStore
from .streaming import changes as stream
from .txn import HIGH, LOW

_N = f"N as ({starview.sql(starview.NODES)})"
_P = f"P as ({starview.sql(starview.PROPS)})"
_E = f"E as ({starview.sql(starview.EDGES)})"
_U = _E + ", U as (select source_id as a, target_id as b from E union all select target_id, source_id from E)"
CUSTOMER, NATION, SUPPLIER, OTHER, PART = 30000000007, 20000000003, 40000000001, 40000000002, 50000000011


def _g(spark: SparkSession, sf_dir: str) -> Graph:
    return starview.graph(spark, sf_dir)


def _recorded(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of_states(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges"))


def _find(spark: SparkSession, sf_dir: str, text: str):
    return GraphSession(graph=_g(spark, sf_dir)).execute(text)


def _row(spark: SparkSession, **values) -> DataFrame:
    """One row of counts and flags that an operator answered on the driver."""
    kinds = {bool: "boolean", int: "bigint", str: "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


# ---------------------------------------------------------------- reads


@query(f"with {_N} select id, label from N where label = 'Customer'")
def r1_nodes_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _find(spark, sf_dir, 'FIND_NODES_BY_LABEL(label: "Customer")').nodes.select("id", "label")


@query("""select id, max(label) as label from nodes where deleted_at is null and id is not null group by id having max(label) = 'Port'""")
def r1_recorded_nodes_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on the table of recorded states."""
    return reads.nodes_by_label(_recorded(spark, sf_dir), "Port").select("id", "label")


@query(f"with {_E} select source_id, target_id, label from E where label = 'LOCATED_IN'")
def r2_edges_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _find(spark, sf_dir, '{"type": "FIND_EDGES_BY_LABEL", "parameters": {"label": "LOCATED_IN"}}').edges.select("source_id", "target_id", "label")


@query(f"with {_N}, {_P} select id, label from N where id in (select id from P where name = 'segment' and value = 'BUILDING')")
def r3_nodes_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _find(spark, sf_dir, 'FIND_NODES_BY_PROPERTY(propertyName: " segment ", propertyValue: "BUILDING")').nodes.select("id", "label")


@query(f"with {_E} select source_id, target_id, label from E where qty = '30'")
def r4_edges_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _find(spark, sf_dir, 'FIND_EDGES_BY_PROPERTY(propertyName: "qty", propertyValue: "30")').edges.select("source_id", "target_id", "label")


def _ends(node: int, direction: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _find(spark, sf_dir, f'FIND_NEIGHBORS(nodeId: "{node}", direction: "{direction}")').edges.select("source_id", "target_id", "label")

    return run


for _name, _node, _direction, _where in (("r5_out", SUPPLIER, "outgoing", "source_id"), ("r5_in", PART, "incoming", "target_id")):
    _f = _ends(_node, _direction)
    _f.__name__ = _name
    query(f"with {_E} select source_id, target_id, label from E where {_where} = {_node}")(_f)


@query(f"with {_E} select source_id, target_id, label from E where source_id = {CUSTOMER} union all select source_id, target_id, label from E where target_id = {CUSTOMER}")
def r5_both_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _find(spark, sf_dir, f'find_neighbors(nodeId: "{CUSTOMER}")').edges.select("source_id", "target_id", "label")


@query(f"with {_N}, {_U} select id, label from N where id in (select b from U where a = {CUSTOMER})")
def r5_both_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _find(spark, sf_dir, f'FIND_NEIGHBORS(nodeId: "{CUSTOMER}")').nodes.select("id", "label")


@query(f"with {_N}, {_U} select distinct b as id from U where a = {NATION} and b in (select id from N)")
def v5_neighbours_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.neighbours(_g(spark, sf_dir), NATION, "both").select("id")


@query(f"with {_N} select id, label from N where id = {PART}")
def w8_get_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.get_node(_g(spark, sf_dir), PART).select("id", "label")


@query("select edge_id, max(source_id) as source_id, max(target_id) as target_id, max(label) as label from edges where edge_id = '500000000000004' group by edge_id")
def w8_get_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.get_edge(_recorded(spark, sf_dir), "500000000000004").select("edge_id", "source_id", "target_id", "label")


# ---------------------------------------------------------------- paths and traversals

_REACH = "with recursive {tables}, D(id, d) as (select {start}::bigint, 0 union select b, d + 1 from D join {steps} on a = id where d < {depth})"


def _reach(start: int, depth: int, steps: str = "U") -> str:
    return _REACH.format(tables=_U + ", O as (select source_id as a, target_id as b from E), I as (select target_id as a, source_id as b from E)", start=start, depth=depth, steps=steps)


def _length(path: DataFrame, a: int, b: int) -> DataFrame:
    return path.agg(F.max("pos").alias("hops")).where(F.col("hops").isNotNull()).select(F.lit(a).cast("bigint").alias("source_id"), F.lit(b).cast("bigint").alias("target_id"), F.col("hops").cast("bigint"))


@query(_reach(NATION, 4) + f"select {NATION} as source_id, {PART} as target_id, min(d)::bigint as hops from D where id = {PART} having min(d) is not null")
def r6_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _length(traverse.find_path(_g(spark, sf_dir), NATION, PART, 4), NATION, PART)


@query(f"select {NATION} as source_id, {PART} as target_id, 1::bigint as hops where false")
def r6_no_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _length(traverse.find_path(_g(spark, sf_dir), NATION, PART, 1), NATION, PART)


@query(f"select {NATION} as source_id, {NATION} as target_id, 0::bigint as hops")
def r6_same_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _length(traverse.find_path(_g(spark, sf_dir), NATION, NATION), NATION, NATION)


# every way of two steps, in order of discovery: that of the first step, then that of the second
@query(f"""with {_E}, S as (select source_id as a, target_id as b, 0 as way, label, source_id, target_id from E union all select target_id, source_id, 1, label, source_id, target_id from E),
w as (select x.b as middle, concat_ws(':', x.label, x.source_id, x.target_id) as e1, concat_ws(':', y.label, y.source_id, y.target_id) as e2 from S x join S y on x.b = y.a where x.a = {SUPPLIER} and y.b = {OTHER}
      order by x.way, x.label, x.source_id, x.target_id, y.way, y.label, y.source_id, y.target_id limit 1)
select 0 as pos, {SUPPLIER}::bigint as node_id, null as edge_id where exists (from w) union all select 1, middle, e1 from w union all select 2, {OTHER}::bigint, e2 from w""")
def r6_path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of two hops between two suppliers that discovery order decides, if there is one."""
    return traverse.find_path(_g(spark, sf_dir), SUPPLIER, OTHER, 2).select("pos", "node_id", "edge_id")


@query(_reach(CUSTOMER, 3) + "select id, min(d) as depth from D group by id")
def v2_bfs_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.bfs(_g(spark, sf_dir), CUSTOMER, "both", 3).select("id", "depth")


@query(_reach(CUSTOMER, 3, "O") + "select id, min(d) as depth from D group by id")
def v2_bfs_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.bfs(_g(spark, sf_dir), CUSTOMER, "outgoing", 3).select("id", "depth")


@query(_reach(PART, 2, "I") + "select id, min(d) as depth from D group by id")
def v2_bfs_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.bfs(_g(spark, sf_dir), PART, "incoming", 2).select("id", "depth")


@query(_reach(CUSTOMER, 3) + "select d as depth, count(*) as n from (select id, min(d) as d from D group by id) group by d")
def v7_depth_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.depth_counts(traverse.bfs(_g(spark, sf_dir), CUSTOMER, "both", 3))


# edges lead from customers to nations to regions and from customers to orders to parts, so a node has the same depth on all ways to it
# and pre-order is the order of its first way
@query(f"""with recursive {_N}, {_E}, D(id, parent_id, d, way) as (select {CUSTOMER}::bigint, null::bigint, 0, [{CUSTOMER}::bigint]
  union all select e.target_id, D.id, D.d + 1, list_append(D.way, e.target_id) from D join E e on e.source_id = D.id where D.d < 3 and e.target_id in (select id from N)),
F as (select * from D qualify row_number() over (partition by id order by way) = 1)
select row_number() over (order by way) - 1 as visit_order, id, d as depth, parent_id from F""")
def v3_dfs_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.dfs(_g(spark, sf_dir), CUSTOMER, "outgoing", 4)


# a part is at best two steps away, so two levels are enough: each in order of discovery, the second up to its first part
@query(f"""with {_N}, {_E}, S as (select source_id as a, target_id as b, 0 as way, label, source_id, target_id from E union all select target_id, source_id, 1, label, source_id, target_id from E),
L1 as (select b as id, row_number() over (order by m) as place from (select b, min((way, label, source_id, target_id)) as m from S where a = {CUSTOMER} and b <> {CUSTOMER} and b in (select id from N) group by b)),
L2 as (select b as id, row_number() over (order by m) as place from (select b, min((place, way, label, source_id, target_id)) as m from S join L1 on a = L1.id
       where b <> {CUSTOMER} and b not in (select id from L1) and b in (select id from N) group by b)),
P as (select min(place) as p from L2 where id in (select id from N where label = 'Part'))
select {CUSTOMER}::bigint as id, 0 as depth union all select id, 1 from L1 union all select id, 2 from L2, P where place <= p""")
def v4_bfs_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visited until the first part is met."""
    return traverse.bfs(_g(spark, sf_dir), CUSTOMER, "both", 5, stop=F.col("label") == "Part").select("id", "depth")


@query(f"select '{{}}' as text, 5::bigint as default_hops, 10::bigint as most_hops, 5::bigint as odd_hops, 'both' as direction, 'brand' as name".format('FIND_NEIGHBORS(direction: "both", nodeId: "7")'))
def q_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsing, validation, defaults and bounds of the query language."""
    near = language.normalize(language.parse('find_neighbors(nodeId: "7")'))
    path = lambda hops: int(language.normalize(language.parse(f'FIND_PATH(sourceId: "1", targetId: "2"{hops})')).parameters["maxHops"])
    named = language.normalize(language.parse('FIND_NODES_BY_PROPERTY(propertyName: " brand ", propertyValue: "x")'))
    return _row(spark, text=str(near), default_hops=path(""), most_hops=path(', maxHops: "4711"'), odd_hops=path(', maxHops: "many"'), direction=near.parameters["direction"], name=named.parameters["propertyName"])


@query("""with recursive N as (select id from nodes where deleted_at is null and id is not null group by id),
X as (select edge_id, max(source_id) as s, max(target_id) as t from edges where edge_id is not null group by edge_id),
U as (select s as a, t as b from X where s is not null and t is not null union all select t, s from X where s is not null and t is not null),
D(id, d) as (select 101::bigint, 0 union select b, d + 1 from D join U on a = id where d < 3 and b in (select id from N)) select id, min(d) as depth from D group by id""")
def v2_bfs_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps over the recorded edges from the busiest node, through living nodes."""
    return traverse.bfs(_recorded(spark, sf_dir), 101, "both", 3).select("id", "depth")


# ---------------------------------------------------------------- indexes


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.property_table(_g(spark, sf_dir).nodes)


@query(f"with {_N} select label, count(*) as n from N group by label")
def i3_label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.label_index(_g(spark, sf_dir).nodes).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_N} select id as entity_id from N where label = 'Supplier'")
def i4_label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.labels_with(index.label_index(_g(spark, sf_dir).nodes), "Supplier")


@query("select label, count(distinct edge_id) as n from edges where label is not null and edge_id is not null group by label")
def i5_edge_label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.label_index(table(spark, sf_dir, "edges").where(F.col("edge_id").isNotNull()), "edge_id").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_P} select name, value, id as entity_id from P")
def i6_property_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).select("name", "value", "entity_id")


@query(f"with {_P} select min(id) as entity_id from P where name = 'segment' and value = 'MACHINERY' having count(*) > 0")
def i7_first_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.first_holding(_index(spark, sf_dir), "segment", "MACHINERY")


@query(f"with {_P} select distinct id as entity_id from P where name = 'brand'")
def i8_has_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.having(_index(spark, sf_dir), "brand")


@query(f"with {_P} select distinct id as entity_id from P where name = 'size' and value = '7'")
def i9_all_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.holding(_index(spark, sf_dir), "size", "7")


@query(f"with {_P} select count(*) > 0 as present from P where name = 'segment' and value = 'BUILDING'")
def i10_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.contains(_index(spark, sf_dir), "segment", "BUILDING")


@query(f"with {_P} select name, count(*) as n from P where not (name = 'segment' and value = 'BUILDING') group by name")
def i11_without_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.without(_index(spark, sf_dir), "segment", "BUILDING").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("""with v as (select prop_value as v from property_rows where prop_value is not null)
select case when regexp_full_match(v, '(?i)[+-]?(inf(inity)?)|nan') then 'numeric'
  when regexp_full_match(v, '(?i)[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?') and isfinite(try_cast(ltrim(v, '+') as double)) then 'numeric'
  when lower(v) in ('true', 'false') then 'boolean' else 'string' end as value_type, count(*) as n from v group by 1""")
def i12_value_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "property_rows").where(F.col("prop_value").isNotNull())
    return values.groupBy(index.value_type(F.col("prop_value")).alias("value_type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_P} select id as entity_id from P where name = 'size' and value::int between 10 and 12")
def i15_number_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension."""
    return index.in_range(_index(spark, sf_dir), "size", 10, 12)


@query(f"with {_P} select distinct id as entity_id from P where name = 'type' and list_contains(regexp_split_to_array(lower(value), '\\W+'), 'economy')")
def i13_token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension."""
    return index.with_token(_index(spark, sf_dir), "type", "Economy")


@query(f"with {_N} select (select count(*) from N where label = 'Nation') as n_nodes, 2::bigint as n_hits, 3::bigint as n_misses")
def i14_result_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads repeated in one session, with room for one result."""
    session = GraphSession(graph=_g(spark, sf_dir), remember=1)
    nations = [session.execute('FIND_NODES_BY_LABEL(label: "Nation")').nodes.count() for _ in range(3)]
    session.execute('FIND_NODES_BY_LABEL(label: "Region")').nodes.count()
    nations.append(session.execute('FIND_NODES_BY_LABEL(label: "Nation")').nodes.count())
    return _row(spark, n_nodes=max(nations), n_hits=session.cache_stats["hits"], n_misses=session.cache_stats["misses"])


# ---------------------------------------------------------------- key-value reads

_EVENTS = "select user_id as k, event_id, ts, event_type, value from events"


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations on users: a signup deletes, everything else puts its type."""
    return table(spark, sf_dir, "events").select(
        F.format_string("user/%08d", "user_id").alias("key"),
        F.col("event_type").alias("value"),
        F.col("event_id").alias("version"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") == "signup").alias("is_deleted"),
    )


_KV = "O as (select printf('user/%08d', user_id) as key, event_type as value, event_id as version, ts, event_type = 'signup' as is_deleted from events)"
_LAST = _KV + ", L as (select * from O qualify row_number() over (partition by key order by version desc) = 1)"
_AS_OF = _KV + ", L as (select * from O where ts <= '2024-01-15 00:00:00'::timestamp qualify row_number() over (partition by key order by ts desc, version desc) = 1)"


@query(f"with {_LAST} select key, value, version from L where not is_deleted")
def k2_current_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.newest(_operations(spark, sf_dir)).select("key", "value", "version")


@query(f"with {_LAST} select key from L where is_deleted")
def k3_deleted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.newest(_operations(spark, sf_dir), tombstones=True).where("is_deleted").select("key")


@query(f"with {_LAST} select key from L where not is_deleted and starts_with(key, 'user/0000001')")
def k5_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan(_operations(spark, sf_dir), "user/0000001").select("key")


@query(f"with {_LAST} select key from L where not is_deleted order by key limit 5")
def k5_first_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's limit is its feature."""
    return kv.scan(_operations(spark, sf_dir), "user/", 5).select("key")


@query(f"with {_LAST} select key, value from L where not is_deleted and key >= 'user/00000050' order by key limit 1")
def k8_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.seek(_operations(spark, sf_dir), "user/00000050").select("key", "value")


@query(f"with {_LAST} select min(key) as min_key, max(key) as max_key, count(*) as n_keys from L where not is_deleted")
def k9_key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.key_range(_operations(spark, sf_dir))


@query(f"with {_AS_OF} select key, value, version from L where not is_deleted")
def k11_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.as_of(_operations(spark, sf_dir), "2024-01-15 00:00:00").select("key", "value", "version")


@query(f"with {_AS_OF} select key, value, version from L where not is_deleted and key between 'user/00000010' and 'user/00000020'")
def k12_scan_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan_as_of(_operations(spark, sf_dir), "user/00000010", "user/00000020", "2024-01-15 00:00:00").select("key", "value", "version")


@query(f"with {_LAST} select key, value, version, is_deleted from L")
def k15_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _operations(spark, sf_dir)
    new = F.col("ts") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return kv.compact(log.where(new), log.where(~new)).select("key", "value", "version", "is_deleted")


@query(f"with {_LAST} select (select count(*) from O) as n_operations, (select count(*) from O where is_deleted) as n_deletions, (select sum(length(key) + length(value))::bigint from O) as n_chars, count(*) as n_keys, count(*) filter (not is_deleted) as n_living from L")
def k17_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.stats(_operations(spark, sf_dir))


@query("""with k as (select user_id, bool_or(event_type = 'purchase') as member from events group by user_id)
select count(*) filter (member) as n_members, 0::bigint as n_members_missed, true as rate_kept from k""")
def k10_bloom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter of the keys that ever held a purchase, sized by their number: it must miss none, and let through few others."""
    keys = _operations(spark, sf_dir).groupBy("key").agg(F.bool_or(F.col("value") == "purchase").alias("member"))
    members = keys.where("member")
    bits, hashes = kv.bloom_size(members.count(), 0.01)
    maybe = kv.bloom_contains(keys, "key", kv.bloom_filter(members, "key", bits, hashes), bits, hashes)
    of = maybe.agg(F.count_if("member").alias("hit"), F.count_if(~F.col("member")).alias("wrong"))
    all_of = keys.agg(F.count_if("member").alias("n_members"), F.count_if(~F.col("member")).alias("others"))
    # the rate is that of the filter; with few others chance may double it
    kept = F.col("wrong") <= F.lit(5) + F.col("others") * 0.02
    return all_of.join(F.broadcast(of), F.lit(True)).select("n_members", (F.col("n_members") - F.col("hit")).alias("n_members_missed"), kept.alias("rate_kept"))  # one row each


@query(f"with {_LAST} select key, is_deleted, row_number() over (order by key) as place from L")
def k7_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys in order, deleted ones among them; Spark's increasing numbers of the sorted rows tell the order."""
    ordered = kv.listing(_operations(spark, sf_dir), tombstones=True).select("key", "is_deleted").withColumn("id", F.monotonically_increasing_id())
    counts = ordered.groupBy(F.shiftright("id", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.alias("x").join(counts.alias("y"), F.col("y.part") < F.col("x.part"), "left").groupBy("x.part").agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("before"))  # a row per partition
    place = F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before") + 1
    return ordered.join(F.broadcast(before), F.shiftright("id", 33) == F.col("part")).select("key", "is_deleted", place.alias("place"))


@query(f"with {_LAST} select key, value from L where not is_deleted and key <> 'user/00000042' union all select 'user/00000042', 'second' union all select 'zone/1', 'new'")
def k1_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts on top of the log, two of one key; a deleted key stays deleted."""
    log = kv.put(_operations(spark, sf_dir), [("user/00000042", "first"), ("user/00000042", "second"), ("zone/1", "new"), ("zone/2", "gone")], 1 << 60)
    return kv.newest(kv.delete(log, ["zone/2"], (1 << 60) + 1)).select("key", "value")


@query(f"with {_LAST} select exists (from L where not is_deleted and key = 'user/00000042') as there, exists (from L where not is_deleted and key = 'user/none') as nowhere")
def k4_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _operations(spark, sf_dir)
    return _row(spark, there=kv.contains(log, "user/00000042"), nowhere=kv.contains(log, "user/none"))


@query(f"with {_LAST} select key, value from L where not is_deleted order by key desc limit 1")
def k8_seek_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.seek(_operations(spark, sf_dir), last=True).select("key", "value")


@query(f"with {_AS_OF} select key, value, version from L where not is_deleted")
def k13_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state at a time, written as a table of its own and read."""
    path = scratch_path(spark)
    kv.recover_to(_operations(spark, sf_dir), "2024-01-15 00:00:00", path)
    return spark.read.parquet(path).select("key", "value", "version")


# ---------------------------------------------------------------- log replay


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "wal_records").select(
        "seq", F.col("record_type").alias("type"), F.col("record_key").alias("key"), F.col("record_value").alias("value"), F.col("record_ts").alias("ts"), "tx_id", F.col("record_version").alias("version")
    )


_STATES = """B as (select *, record_type is null or record_type not in (1, 2, 3, 4, 5) or (record_type in (1, 2) and record_key is null) as bad from wal_records),
S as (select tx_id, case when bool_or(bad) then 'corrupted' when coalesce(bool_or(record_type = 5), false) then 'rolled_back' when coalesce(bool_or(record_type = 4), false) then 'committed' else 'active' end as state
      from B where tx_id <> 0 group by tx_id)"""
_REPLAY = """, R as (select * from B where record_type in (1, 2) and record_key is not null and (tx_id = 0 or {}) qualify row_number() over (partition by record_key order by record_version desc, seq desc) = 1)
select record_key as key, record_value as value from R where record_type = 1"""


@query(f"with {_STATES} select state, count(*) as n from S group by state")
def g3_transaction_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.classify(_log(spark, sf_dir)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_STATES} select record_type as type, count(*) as n from B where record_type in (1, 2) and record_key is not null and tx_id = 0 group by record_type")
def g4_standalone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.effective(_log(spark, sf_dir).where(F.col("tx_id") == 0)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_STATES}" + _REPLAY.format("tx_id in (select tx_id from S where state = 'committed')"))
def g5_replay_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.replay(_log(spark, sf_dir))


@query(f"with {_STATES}" + _REPLAY.format("tx_id not in (select tx_id from S where state = 'rolled_back')"))
def g6_replay_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.replay(_log(spark, sf_dir), atomic=False)


@query(f"""with {_STATES} select count(*) as n_records, count(*) filter (bad) as n_corrupted, count(*) filter (record_type = 1) as n_puts, count(*) filter (record_type = 2) as n_deletes,
count(*) filter (record_type = 3) as n_begins, count(*) filter (record_type = 4) as n_commits, count(*) filter (record_type = 5) as n_rollbacks, count(*) filter (record_type in (1, 2) and tx_id = 0) as n_standalone,
(select count(*) from S) as n_transactions, (select count(*) from S where state = 'committed') as n_tx_committed, (select count(*) from S where state = 'rolled_back') as n_tx_rolled_back,
(select count(*) from S where state = 'active') as n_tx_active, (select count(*) from S where state = 'corrupted') as n_tx_corrupted,
count(*) filter (record_type in (1, 2) and record_key is not null and (tx_id = 0 or tx_id in (select tx_id from S where state = 'committed'))) as n_applied from B""")
def g8_replay_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.replay_stats(_log(spark, sf_dir))


def _stored_log(spark: SparkSession, sf_dir: str) -> LogStore:
    stored = LogStore(spark, scratch_path(spark))
    stored.extend(_log(spark, sf_dir))
    return stored


@query(f"with {_STATES} select count(*) as n_records, count(*) filter (bad) as n_corrupted, 1::bigint as n_changed from B")
def g1_sealed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a stored log: those corrupted as they came, and one whose value is changed after sealing."""
    log = _stored_log(spark, sf_dir).read()
    first = log.where(F.col("type") == 1).agg(F.min("seq")).first()[0]
    changed = log.withColumn("value", F.when(F.col("seq") == first, F.lit("other")).otherwise(F.col("value")))
    counted = changed.agg(F.count(F.lit(1)).alias("n_records")).join(F.broadcast(oplog.corrupted(changed).agg(F.count(F.lit(1)).alias("c"))), F.lit(True))  # one row each
    before = F.broadcast(oplog.corrupted(log).agg(F.count(F.lit(1)).alias("n_corrupted")))
    return counted.join(before, F.lit(True)).select("n_records", "n_corrupted", (F.col("c") - F.col("n_corrupted")).alias("n_changed"))


@query("select 'key2' as key, 'b' as value union all select 'key3', 'c'")
def g2_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begin, commit and rollback markers in a log written record by record."""
    stored = LogStore(spark, scratch_path(spark))
    stored.append([(3, None, None, 1, None), (1, "key1", "a", 1, 1), (5, None, None, 1, None)])
    stored.append([(3, None, None, 2, None), (1, "key2", "b", 2, 2), (4, None, None, 2, None), (1, "key3", "c", 0, 3), (1, "key4", "d", 7, 4)])
    return oplog.replay(stored.read(), strict=True)


@query(f"with {_STATES} select bool_or(bad) as refused, true as passed from B")
def g7_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict replay of the stored log fails on its corrupted records, and passes without them."""
    log = _stored_log(spark, sf_dir).read()

    def refused(part: DataFrame) -> bool:
        try:
            oplog.replay(part, strict=True)
        except oplog.CorruptedLog:
            return True
        return False

    good = log.join(oplog.corrupted(log).select("seq"), "seq", "left_anti")
    return _row(spark, refused=refused(log), passed=not refused(good))


@query("select max(seq) + 1 as next_seq, 'late' as key, 'x' as value, 1::bigint as n_records from wal_records")
def g9_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After truncation a stored log holds only what came later, and its numbers go on."""
    stored = _stored_log(spark, sf_dir)
    stored.truncate()
    first = stored.append([(1, "late", "x", 0, 1)])
    stored.vacuum()
    return oplog.replay(stored.read()).select(F.lit(first).cast("bigint").alias("next_seq"), "key", "value", F.lit(stored.read().count()).cast("bigint").alias("n_records"))


# ---------------------------------------------------------------- streams


def _log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.log_stream(spark, f"{sf_dir}/wal_record[s].parquet")  # a pattern may name a file or a folder


@query(_P2 + "select record_key, record_version, v as record_value from l where t = 1")
def s2_stream_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream, transactions included, applied to an equality-delete table."""
    stored = EqualityDeleteTable(spark, scratch_path(spark))
    stream.apply_stream(_log_stream(spark, sf_dir), stored, scratch_path(spark)).awaitTermination()
    return stored.read()


@query("select epoch_us(date_trunc('hour', record_ts)) as start_us, record_type, count(*) as n from wal_records where record_ts is not null group by all")
def s2_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per type and hour, with so long a watermark that none is late."""
    counts, path = stream.windowed_counts(_log_stream(spark, sf_dir), "1 hour", "10000 days"), scratch_path(spark)
    writer = counts.writeStream.outputMode("complete").option("checkpointLocation", scratch_path(spark)).trigger(availableNow=True)
    writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return spark.read.parquet(path).select(F.unix_micros("start").alias("start_us"), "record_type", "n")


# ---------------------------------------------------------------- writes


@query(f"with {_N}, {_E} select id from N where label <> 'Supplier' and id in (select target_id from E where source_id in (select id from N where label <> 'Supplier'))")
def w3_delete_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers deleted with their edges: what the rest still refers to."""
    g = _g(spark, sf_dir)
    rest = writes.delete_nodes(g, reads.nodes_by_label(g, "Supplier").select("id"), cascade=True)
    return rest.nodes.join(rest.edges.select(F.col("target_id").alias("id")).distinct(), "id", "left_semi").select("id")


@query(f"with {_E} select label, count(*) as n from E where label <> 'SUPPLIES' group by label")
def w4_delete_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _g(spark, sf_dir)
    return reads.label_counts(writes.delete_edges(g, reads.edges_by_label(g, "SUPPLIES").select("edge_id")).edges)


@query(f"with {_P} select id, name, case when name = 'segment' and value = 'BUILDING' then 'HOUSES' else value end as value from P")
def w5_set_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = writes.set_property(_g(spark, sf_dir).nodes, F.col("properties")["segment"] == "BUILDING", "segment", F.lit("HOUSES"))
    return nodes.select("id", F.explode("properties").alias("name", "value"))


@query(f"with {_P} select id, name, value from P where name <> 'size'")
def w6_remove_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = writes.remove_property(_g(spark, sf_dir).nodes, F.lit(True), "size")
    return nodes.select("id", F.explode("properties").alias("name", "value"))


@query("""with n as (select id from nodes where deleted_at is null) select distinct x as id from (select source_id as x from edges union all select target_id from edges) where x is not null and x not in (select id from n where id is not null)""")
def w2_invalid_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.invalid_ends(table(spark, sf_dir, "edges"), _recorded(spark, sf_dir).nodes)


@query("""with e as (select edge_id, max(source_id) as s, max(target_id) as t from edges where edge_id is not null group by edge_id), x as (select s as id, 1 as o from e union all select t, 0 from e)
select id, sum(o)::bigint as n_out, sum(1 - o)::bigint as n_in from x where id is not null group by id""")
def x_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension."""
    return reads.degrees(_recorded(spark, sf_dir))



# ---------------------------------------------------------------- transactions over a stored copy of the graph


def _stored(spark: SparkSession, sf_dir: str) -> GraphSession:
    session = GraphSession.open(spark, scratch_path(spark))
    session.store.load(_g(spark, sf_dir))
    return session


def _depot(session: GraphSession, end: str) -> None:
    """A new node with a property and an edge to a nation, in one transaction."""
    tx = session.execute("BEGIN_TRANSACTION()").tx_id
    for text in (
        f'CREATE_NODE(label: "Depot", ref: "d", txId: "{tx}")',
        f'SET_PROPERTY(target: "node", id: "$d", name: "name", value: "first, \\"old\\"", txId: "{tx}")',
        f'SET_PROPERTY(target: "node", id: "$d", name: "name", value: "North", txId: "{tx}")',
        f'CREATE_EDGE(source: "$d", targetId: "{NATION}", label: "LOCATED_IN", ref: "e", txId: "{tx}")',
        f'SET_PROPERTY(target: "edge", id: "$e", name: "qty", value: "1", txId: "{tx}")',
        f'REMOVE_PROPERTY(target: "edge", id: "$e", name: "qty", txId: "{tx}")',
        f'DELETE_NODE(id: "{CUSTOMER}", txId: "{tx}")',
        f'{end}_TRANSACTION(txId: "{tx}")',
    ):
        session.execute(text)


_NEAR = f"select label, count(*) as n from (select distinct id, label from N where id in (select b from U where a = {NATION}){{}}) group by label"


@query(f"with {_N}, {_U} " + _NEAR.format(f" and id <> {CUSTOMER} union all select -1, 'Depot'"))
def t2_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of a nation by label after a committed transaction."""
    session = _stored(spark, sf_dir)
    _depot(session, "COMMIT")
    return reads.label_counts(session.execute(f'FIND_NEIGHBORS(nodeId: "{NATION}")').nodes)


@query(f"with {_N}, {_U} " + _NEAR.format(""))
def t3_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after a rolled back one."""
    session = _stored(spark, sf_dir)
    _depot(session, "ROLLBACK")
    return reads.label_counts(session.execute(f'FIND_NEIGHBORS(nodeId: "{NATION}")').nodes)


@query(f"with {_N} select label, count(*) as n from N group by label")
def t9_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in the version before a commit."""
    session = _stored(spark, sf_dir)
    before = session.store.graph()
    _depot(session, "COMMIT")
    return reads.label_counts(before.nodes)


@query(f"with {_N} select label, count(*) as n from (select label, id from N where id <> {CUSTOMER} union all select 'Depot', 0) group by label")
def k18_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels after a commit, compaction, removal of old versions and reopening."""
    session = _stored(spark, sf_dir)
    _depot(session, "COMMIT")
    session.store.compact()
    session.store.vacuum(older_than=0)
    return reads.label_counts(GraphSession.open(spark, session.store.path).store.graph().nodes)


@query(f"with {_N} select true as refused, (select count(*) from N) as n_seen, (select count(*) from N) + 1 as n_now")
def t4_read_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read-only transaction can't write and keeps its version while another commits."""
    session = _stored(spark, sf_dir)
    m = session.transactions
    reader = m.begin(read_only=True)
    try:
        m.create_node(reader, "Depot")
        refused = False
    except TransactionError:
        refused = True
    session.execute('CREATE_NODE(label: "Depot")')
    seen = m.view(reader).nodes.count()
    m.commit(reader)
    return _row(spark, refused=refused, n_seen=seen, n_now=session.store.graph().nodes.count())


@query("select 'high,low' as turns, 1::bigint as n_timed_out, 3::bigint as n_begun")
def t5_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writers wait by priority; one that waits too long gives up."""
    import threading
    import time

    m = GraphSession.open(spark, scratch_path(spark)).transactions
    first, turns = m.begin(), []

    def wait(priority: int, name: str) -> None:
        tx = m.begin(priority=priority)
        turns.append(name)
        m.rollback(tx)

    waiting = [threading.Thread(target=wait, args=x) for x in ((LOW, "low"), (HIGH, "high"))]
    for n, t in enumerate(waiting, 1):
        t.start()
        while m.stats()["waiting"] < n:
            time.sleep(0.01)
    try:
        m.begin(timeout=0.05)
    except TransactionError:
        pass
    m.rollback(first)
    for t in waiting:
        t.join()
    return _row(spark, turns=",".join(turns), n_timed_out=m.stats()["timed_out"], n_begun=m.stats()["begun"])


@query("select 3::bigint as n_begun, 1::bigint as n_committed, 1::bigint as n_rolled_back, 1::bigint as n_open")
def t10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = GraphSession.open(spark, scratch_path(spark)).transactions
    for end in (m.commit, m.rollback):
        tx = m.begin()
        m.create_node(tx, "A")
        end(tx)
    m.begin()
    stats = m.stats()
    return _row(spark, n_begun=stats["begun"], n_committed=stats["committed"], n_rolled_back=stats["rolled_back"], n_open=stats["open"])


@query(f"with {_N} select label, count(*) as n from N group by label")
def t11_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A writer that ended before it published leaves files that no reader of the reopened store sees."""
    session = _stored(spark, sf_dir)
    m = session.transactions
    tx = m.begin()
    m.create_node(tx, "Depot")
    session.store._write(*m._delta(tx))  # and then nothing more
    return reads.label_counts(GraphSession.open(spark, session.store.path).store.graph().nodes)


@query(f"with {_N} select label, count(*) as n from (select label from N union all select 'Depot') group by label")
def k16_vacuum_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a commit under way, and of a version that a reader has pinned, survive the removal of old files."""
    session = _stored(spark, sf_dir)
    store, m = session.store, session.transactions
    reader = m.begin(read_only=True)
    tx = m.begin()
    m.create_node(tx, "Depot")
    folder = store._write(*m._delta(tx))
    store.compact()
    store.vacuum(older_than=0)
    base = store.manifest()
    store._next(base, [*base.folders, folder], [*base.rows, 1], tx.next_node, tx.next_edge, 1)
    if m.view(reader).nodes.isEmpty():
        raise GraphError("the pinned version is gone")
    return reads.label_counts(store.graph().nodes)


@query(f"with {_N} select label, count(*) as n from (select label from N union all select 'Depot' from range(12)) group by label")
def k14_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small commits: their deltas are folded in tiers, the base is left alone."""
    session = _stored(spark, sf_dir)
    base = session.store.manifest().folders[0]
    for _ in range(12):
        session.execute('CREATE_NODE(label: "Depot")')
    now = session.store.manifest()
    if now.folders[0] != base or len(now.folders) > session.store.compact_after:
        raise GraphError("the base was rewritten, or the deltas weren't folded")
    return reads.label_counts(session.store.graph().nodes)


@query(f"with {_N}, {_E} select (select count(*) from N) as n_nodes, (select count(*) from E) as n_edges")
def s5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph saved as JSON lines and loaded again."""
    nodes, edges = scratch_path(spark), scratch_path(spark)
    g = _g(spark, sf_dir)
    files.save(Graph(g.nodes, g.edges.orderBy("ord").withColumn("ord", F.monotonically_increasing_id())), nodes, edges, "json")
    back = files.load(spark, nodes, edges, "json")
    return back.nodes.agg(F.count(F.lit(1)).alias("n_nodes")).join(F.broadcast(back.edges.agg(F.count(F.lit(1)).alias("n_edges"))), F.lit(True))  # one row each


@query(f"with {_N} select 'nodes' as kind, id, label from N where label = 'Nation'")
def s7_streamed_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result's rows fetched one by one."""
    rows = [(kind, r["id"], r["label"]) for kind, r in _find(spark, sf_dir, 'FIND_NODES_BY_LABEL(label: "Nation")').rows()]
    return spark.createDataFrame(rows, "kind string, id bigint, label string")
