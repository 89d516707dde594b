"""Attribute-value rows into wide tables.

Method: the entity-by-attribute grid is completed from the declared attributes, the values in force
are left joined to it, each entity's cells are collected into one array sorted by attribute position,
and the array's fixed indices are projected through type-specific try casts.

Scale: values are reduced to one row per entity and attribute with map-side combine before any join,
so an entity rewritten very often costs one row per map task; an entity's array is never longer than
the number of attributes declared for its label. Only the declarations (bounded by ``MAX_DECLARED``,
checked) reach the driver, where they become the schema.

Defined results: rows without entity or name are ignored; entities without rows get a row of nulls;
entities with a null or undeclared label get a row of nulls; rows of entities that aren't in
``entities`` and undeclared names are ignored; repeated rows change nothing; of rows equal in every
order column the greatest value wins; blank values are null; extra columns of the inputs are ignored,
whatever their names; an empty declaration table gives only key and label.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import TYPES, is_blank, read_as, same_name

MAX_DECLARED = 10_000


@dataclass(frozen=True)
class Attribute:
    label: str
    name: str
    type: str
    position: int
    column: str


def declared_attributes(types: DataFrame) -> list[Attribute]:
    """The declarations with their position within the label and the column they become.

    Names that agree without case, white space, hyphens and underscores share one column if they are
    declared with one type only; it has the first of their spellings. Otherwise, or if the name would
    clash with the key columns, the column is ``label__name``. Columns never differ in case alone.
    """
    w = Window.partitionBy("label").orderBy("same")
    rows = (
        types.where(F.col("label").isNotNull() & F.col("attr_name").isNotNull())
        .groupBy("label", same_name(F.col("attr_name")).alias("same"))
        .agg(F.min(F.struct("attr_name", "value_type")).alias("a"))
        .select("label", "same", "a.*", (F.row_number().over(w) - 1).alias("position"))
        .limit(MAX_DECLARED + 1)
        .collect()
    )
    if len(rows) > MAX_DECLARED:
        raise ValueError(f"more than {MAX_DECLARED} declared attributes")
    kinds: dict[str, set[str]] = {}
    spelt: dict[str, str] = {}
    for r in rows:
        if r.value_type not in TYPES:
            raise ValueError(f"unknown value type {r.value_type!r} of {r.label}.{r.attr_name}")
        kinds.setdefault(r.same, set()).add(r.value_type)
        spelt[r.same] = min(spelt.get(r.same, r.attr_name), r.attr_name)
    taken = {"entity_id", "label", "unreadable"}
    out: list[Attribute] = []
    owner: dict[str, str] = {}  # of each column, in lower case, what it is for
    for r in sorted(rows, key=lambda r: (r.label, r.position)):
        shared = len(kinds[r.same]) == 1 and spelt[r.same].lower() not in taken
        column, mine = (spelt[r.same], r.same) if shared else (f"{r.label}__{r.attr_name}", f"{r.label}\0{r.same}")
        while owner.setdefault(column.lower(), mine) != mine or column.lower() in taken:
            column += "_"
        out.append(Attribute(r.label, r.attr_name, r.value_type, r.position, column))
    return out


def values_in_force(rows: DataFrame) -> DataFrame:
    """One row per entity and attribute name: the value with the latest ``written_at``, then the highest ``row_no``.

    A missing ``written_at`` is older than any other.
    """
    return (
        rows.where(F.col("entity_id").isNotNull() & F.col("prop_name").isNotNull())
        .groupBy("entity_id", same_name(F.col("prop_name")).alias("same"))
        .agg(F.max(F.struct("written_at", "row_no", "prop_value")).alias("last"))
        .select("entity_id", "same", F.col("last.prop_value").alias("prop_value"))
    )


def widen(rows: DataFrame, entities: DataFrame, types: DataFrame) -> DataFrame:
    """``entity_id, label``, a typed column per declared attribute, and ``unreadable array<string>``.

    ``unreadable`` names the entity's attributes whose value in force is neither blank nor readable as
    its type. ``rows`` has entity_id, prop_name, prop_value, written_at, row_no; ``entities`` id and
    label (an id may recur); ``types`` label, attr_name, value_type.
    """
    attributes = declared_attributes(types)
    spark = rows.sparkSession
    catalog = spark.createDataFrame([(a.label, a.position, a.name) for a in attributes], "label string, position int, attr_name string").select(
        F.col("label").alias("of_label"), "position", same_name(F.col("attr_name")).alias("same")
    )
    known = entities.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("entity_id")).agg(F.max("label").alias("label"))
    grid = known.join(catalog, F.col("label") == F.col("of_label"), "left")
    names = catalog.select("same").distinct()
    cells = grid.join(values_in_force(rows.join(names, same_name(F.col("prop_name")) == F.col("same"), "left_semi")), ["entity_id", "same"], "left")
    arrays = (
        cells.groupBy("entity_id", "label")
        .agg(F.sort_array(F.collect_list(F.when(F.col("position").isNotNull(), F.struct("position", "prop_value")))).alias("cells"))
    )
    by_column: dict[str, list[int]] = {}
    for i, a in enumerate(attributes):
        by_column.setdefault(a.column, []).append(i)

    # the raw cell and its reading are columns of their own, so that neither is worked out twice
    raw = arrays.select(
        "entity_id", "label", *(F.when(F.col("label") == a.label, F.col("cells")[a.position]["prop_value"]).alias(f"_raw{i}") for i, a in enumerate(attributes))
    )
    read = raw.select(
        "entity_id",
        "label",
        *(read_as(F.col(f"_raw{i}"), a.type).alias(f"_read{i}") for i, a in enumerate(attributes)),
        *((~is_blank(F.col(f"_raw{i}"))).alias(f"_filled{i}") for i, a in enumerate(attributes)),
    )
    typed = [F.coalesce(*(F.col(f"_read{i}") for i in group)).cast(TYPES[attributes[group[0]].type]).alias(column) for column, group in by_column.items()]
    wrong = [F.when(F.col(f"_filled{i}") & F.col(f"_read{i}").isNull(), F.lit(a.name)) for i, a in enumerate(attributes)]
    unreadable = F.array_compact(F.array(*wrong)) if wrong else F.array()
    return read.select("entity_id", "label", *typed, unreadable.cast("array<string>").alias("unreadable"))


def unreadable_values(wide: DataFrame) -> DataFrame:
    """``entity_id, attr_name``: the cells of ``widen`` that hold an unreadable value."""
    return wide.select("entity_id", F.explode("unreadable").alias("attr_name"))
