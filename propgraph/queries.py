"""Queries over the test tables for the general operators, and the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import TYPES
from .operators import changes, history, orphans, skew, wide
from .runtime import scratch_path, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- problem 1: wide tables

_D = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)"
_SAME = r"lower(regexp_replace({}, '[\s_-]+', '', 'g'))"
_P1 = rf"""
with n as (select id, max(label) as label from nodes where id is not null group by id),
g as (select n.id, n.label, t.attr_name, t.value_type, {_SAME.format("t.attr_name")} as same from n left join attribute_types t on n.label = t.label),
r as (select entity_id, {_SAME.format("prop_name")} as same, prop_value from property_rows where entity_id is not null and prop_name is not null
      qualify row_number() over (partition by entity_id, {_SAME.format("prop_name")} order by written_at desc nulls last, row_no desc) = 1),
c as (select g.id, g.label, g.attr_name, g.value_type, regexp_replace(r.prop_value, '^\s+|\s+$', '', 'g') as v from g left join r on g.id = r.entity_id and g.same = r.same),
d as (select *, replace(v, ',', '') as bare, case when regexp_full_match(v, '[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{4}}') then v[7:10] || '-' || v[4:5] || '-' || v[1:2] when regexp_full_match(v, '[0-9]{{4}}([/-])[0-9]{{2}}[/-][0-9]{{2}}') and v[5] = v[8] then replace(v, '/', '-') end as iso from c),
x as (select id, label, attr_name, value_type, v,
  case when value_type = 'bigint' and regexp_full_match(v, '[+-]?{_D}') then try_cast(ltrim(bare, '+') as bigint) end as as_bigint,
  case when value_type = 'double' and regexp_full_match(v, '[+-]?(?:{_D}(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?') and isfinite(try_cast(ltrim(bare, '+') as double)) then try_cast(ltrim(bare, '+') as double) end as as_double,
  case when value_type = 'boolean' then case when lower(v) in ('true', 'yes', 'y', 't', '1') then true when lower(v) in ('false', 'no', 'n', 'f', '0') then false end end as as_boolean,
  case when value_type = 'date' and iso not like '0000%' then try_cast(iso as date) end as as_date,
  case when value_type = 'timestamp' and regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[ T](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z?') then try_cast(v[1:10] || ' ' || v[12:19] as timestamp) end as as_timestamp
  from d)
"""


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.widen(table(spark, sf_dir, "property_rows"), table(spark, sf_dir, "nodes"), table(spark, sf_dir, "attribute_types"))


@query(_P1 + """select id as entity_id, attr_name from x where v is not null and v <> '' and value_type <> 'string'
and as_bigint is null and as_double is null and as_boolean is null and as_date is null and as_timestamp is null""")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.unreadable_values(_wide(spark, sf_dir))


#: The wide table's columns for the declarations of the test data, for the SQL only.
_COLUMNS = {
    "string": "hull_name port_name goods rank_title route_code",
    "bigint": "crew_size berth_count pieces trips days_at_sea",
    "double": "tonnage latitude longitude mass_kg wage fuel_tons",
    "boolean": "in_service ice_free insured certified delayed",
    "date": "built_on declared_on joined_on",
    "timestamp": "departed_at",
}


@query(_P1 + "select id as entity_id, label, " + ", ".join(
    f"max(case when attr_name = '{c}' then {"nullif(v, '')" if kind == 'string' else 'as_' + kind} end) as {c}" for kind, names in _COLUMNS.items() for c in names.split()
) + " from x group by id, label")
def p1_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir).drop("unreadable")


@query(_P1 + """select label, attr_name, count(*) as n_entities, count(nullif(v, '')) as n_filled,
count(*) filter (where v <> '' and value_type <> 'string' and as_bigint is null and as_double is null and as_boolean is null and as_date is null and as_timestamp is null) as n_unreadable
from x where attr_name is not null group by label, attr_name""")
def p1_fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per declared attribute: entities, values in force that aren't blank, and unreadable ones."""
    w = _wide(spark, sf_dir)
    declared = wide.declared_attributes(table(spark, sf_dir, "attribute_types"))
    cells = F.array(
        *(
            F.when(
                F.col("label") == a.label,
                F.struct(F.lit(a.name).alias("attr_name"), F.col(a.column).isNotNull().alias("read"), F.array_contains("unreadable", a.name).alias("wrong")),
            )
            for a in declared
        )
    )
    long = w.select("label", F.explode(F.array_compact(cells)).alias("c")).select("label", "c.*")
    return long.groupBy("label", "attr_name").agg(
        F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("read") | F.col("wrong")).alias("n_filled"), F.count_if("wrong").alias("n_unreadable")
    )


# ---------------------------------------------------------------- problem 2: current state of a change log

_COUNTED = """
with k as (select * from wal_records where record_type in (1, 2) and record_key is not null and record_version is not null
  and (tx_id = 0 or tx_id in (select tx_id from wal_records where record_type = 4 and tx_id is not null)))"""
_P2 = _COUNTED + """, l as (select record_key, record_version, max(record_type) as t, max(record_value) as v from k group by record_key, record_version
  qualify row_number() over (partition by record_key order by record_version desc) = 1)
"""


@query(_P2 + "select record_key, record_version from l where t = 1")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By files: the log is appended to a stored table in batches, which is read."""
    return changes.stored_changes(table(spark, sf_dir, "wal_records")).read().select("record_key", "record_version")


@query(_P2 + "select record_key, record_version, v as record_value from l where t = 1")
def p2_current_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.apply_changes(table(spark, sf_dir, "wal_records"))


# ---------------------------------------------------------------- problem 3: history


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored history of all but the last tenth of the arrivals, brought up to date with that tenth."""
    log = table(spark, sf_dir, "wal_records")
    last = log.agg(F.max("seq")).first()[0] or 0
    stored = history.HistoryStore(spark, scratch_path(spark), contents=False, buckets=max(1, math.ceil(last / history.BUCKET_ROWS)))
    stored.add(log.where(F.col("seq") <= last * 9 // 10))
    stored.add(log.where(~F.coalesce(F.col("seq") <= last * 9 // 10, F.lit(False))))
    return stored.read()


# contents are compared as lists of their sorted members; a record is an object of scalars and one object of scalars, properties
_P3 = _COUNTED + """, v as (select record_key, record_version, min(record_ts) as ts, max(record_type) as t, max(record_value) as j from k group by record_key, record_version),
s as (select *, case when t = 1 then list_transform(list_sort(json_keys(j)), lambda k: k || '=' || coalesce(case when k = 'properties' then
  array_to_string(list_transform(list_sort(json_keys(j, '$.properties')), lambda p: p || '=' || coalesce(j -> 'properties' ->> p, 'null')), chr(1)) else j ->> k end, 'null')) end as c from v),
w as (select *, lag(c) over (partition by record_key order by record_version) as was from s),
e as (select *, lead(ts) over (partition by record_key order by record_version) as until, lead(record_version) over (partition by record_key order by record_version) as next from w where c is distinct from was)
"""


@query(_P3 + """select record_key, record_version, epoch_us(ts) as valid_from_us, case when next is null then -1 else epoch_us(until) end as valid_to_us from e where c is not null""")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return _history(spark, sf_dir).select(
        "record_key", "record_version", us("valid_from").alias("valid_from_us"), F.when(F.col("open"), F.lit(-1)).otherwise(us("valid_to")).alias("valid_to_us")
    )


@query(_P3 + """, o as (select record_key, count(*) as n_periods, max(case when next is null then 1 else 0 end) as is_open from e where c is not null group by record_key)
select n_periods, is_open, count(*) as n_keys from o group by n_periods, is_open""")
def p3_chain_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys have had how many periods, and whether the last is still open."""
    per_key = _history(spark, sf_dir).groupBy("record_key").agg(F.count(F.lit(1)).alias("n_periods"), F.max(F.col("open").cast("int")).alias("is_open"))
    return per_key.groupBy("n_periods", "is_open").agg(F.count(F.lit(1)).alias("n_keys"))


# ---------------------------------------------------------------- problem 4: heavy keys


def _pairs(spark: SparkSession, sf_dir: str, measures: dict[str, str]) -> DataFrame:
    return skew.balanced_distinct(table(spark, sf_dir, "edges"), ["source_id", "label"], measures)


@query("""select source_id, label from edges group by source_id, label having source_id is not null and label is not null
and count(distinct edge_id) >= 0.005 * (select count(distinct edge_id) from edges)""")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.heavy_pairs(_pairs(spark, sf_dir, {"n_edges": "edge_id"}), "n_edges", 0.005).where(F.col("source_id").isNotNull() & F.col("label").isNotNull()).select("source_id", "label")


@query("select source_id, label, count(*) as n_rows, count(distinct edge_id) as n_edges, count(distinct target_id) as n_targets from edges group by source_id, label")
def p4_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, {"n_edges": "edge_id", "n_targets": "target_id"})


# ---------------------------------------------------------------- problem 5: orphan references

_P5 = """
with n as (select id, bool_and(deleted_at is not null) as gone, min(created_at) as ts from nodes where id is not null group by id),
e as (select edge_id, 'source' as side, source_id as id, min(created_at) as ts from edges where source_id is not null group by all
      union all select edge_id, 'target', target_id, min(created_at) from edges where target_id is not null group by all),
f as (select e.edge_id, e.side, e.ts, case when n.id is null then 'missing' when n.gone then 'deleted' when n.ts > e.ts then 'late' end as kind from e left join n using (id))
"""


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges")
    known = orphans.parents(nodes, "nodes", "id", "created_at", "deleted_at")
    refs = orphans.references(edges, "edges", "edge_id", "nodes", {"source": "source_id", "target": "target_id"}, "created_at")
    return orphans.orphan_references(known, refs, total=2 * edges.count())  # from the files' footers


@query(_P5 + "select edge_id, side, kind from f where kind is not null")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select(F.col("child_id").alias("edge_id"), "side", "kind")


@query(_P5 + "select 'edges' as child_table, side, kind, strftime(ts, '%Y-%m') as month, count(*) as n_references from f where kind is not null group by all")
def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_totals(_orphans(spark, sf_dir))


assert set(_COLUMNS) == set(TYPES)
