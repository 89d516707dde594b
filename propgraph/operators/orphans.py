"""References to records that do not exist.

Method: parents and child references are united in long form, each row tagged with what it is, and
grouped by parent table and key; groups that lack the parent flag (or whose parent is deleted or later)
are kept and their references summed by period.

Scale: the group-by only combines flags, times and counts, on the map side first, so a key that a third
of all rows refer to costs one row per map task. The references behind the kept groups are then looked
up: groups of more than one ``BLOCKS``-th of all references (fewer than ``BLOCKS`` of them) by
broadcast, all other groups by a shuffle join in which no key is heavy. The groups carry the count of
their references, so it takes no other pass to tell.

Defined results: null references are ignored; a repeated child (equal id) counts once; a reference is
``missing`` if no parent row has the key, else ``deleted`` if all parent rows have a deletion time, else
``late`` if the earliest parent time is after the child's; null times don't count, so a parent without
any time or a child without time is never late; with no parents at all every reference is missing;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

BLOCKS = 256


def parents(df: DataFrame, table: str, key: str, created: str | None, deleted: str | None) -> DataFrame:
    """Parent rows in long form."""
    return df.where(F.col(key).isNotNull()).select(
        F.lit(table).alias("parent_table"),
        F.col(key).cast("string").alias("key"),
        F.lit(True).alias("is_parent"),
        (F.col(deleted).isNull() if deleted else F.lit(True)).alias("lives"),
        (F.col(created) if created else F.lit(None).cast("timestamp_ntz")).alias("parent_at"),
        F.lit(None).cast("timestamp_ntz").alias("child_at"),
    )


def references(df: DataFrame, child_table: str, child_id: str, table: str, columns: dict[str, str], created: str | None) -> DataFrame:
    """References in long form: a row per child row and non-null reference; ``columns`` is ``side: column``."""
    sides = F.array(*(F.struct(F.lit(side).alias("side"), F.col(c).cast("string").alias("key")) for side, c in columns.items()))
    at = F.col(created) if created else F.lit(None).cast("timestamp_ntz")
    return (
        df.select(F.col(child_id).cast("string").alias("child_id"), at.alias("child_at"), F.explode(sides).alias("r"))
        .where(F.col("r.key").isNotNull())
        .select(F.lit(child_table).alias("child_table"), F.lit(table).alias("parent_table"), "child_id", "child_at", "r.side", "r.key")
    )


def verdicts(parent_rows: DataFrame, refs: DataFrame, heavy: int) -> DataFrame:
    """Groups with at least one bad reference, and those of more than ``heavy`` references.

    ``parent_table, key, kind, parent_at, is_bad, is_heavy``; ``kind`` of a bad group null: perhaps late.
    """
    tagged = parent_rows.unionByName(
        refs.select("parent_table", "key", F.lit(False).alias("is_parent"), F.lit(False).alias("lives"), F.lit(None).cast("timestamp_ntz").alias("parent_at"), "child_at")
    )
    grouped = tagged.groupBy("parent_table", "key").agg(
        F.max("is_parent").alias("has_parent"),
        F.min("is_parent").alias("only_parent"),
        F.max("lives").alias("lives"),
        F.min("parent_at").alias("parent_at"),
        F.min("child_at").alias("first_child_at"),
        F.count_if(~F.col("is_parent")).alias("n_references"),
    )
    kind = F.when(~F.col("has_parent"), F.lit("missing")).when(~F.col("lives"), F.lit("deleted"))
    bad = ~F.col("only_parent") & (kind.isNotNull() | (F.col("parent_at") > F.col("first_child_at")))
    told = grouped.select("parent_table", "key", kind.alias("kind"), "parent_at", F.coalesce(bad, F.lit(False)).alias("is_bad"), (F.col("n_references") > heavy).alias("is_heavy"))
    return told.where(F.col("is_bad") | F.col("is_heavy"))


def orphan_references(parent_rows: DataFrame, refs: DataFrame, blocks: int = BLOCKS, total: int | None = None) -> DataFrame:
    """One row per bad reference: ``child_table, parent_table, child_id, child_at, side, kind``.

    ``total``: references, or a number somewhat above, if that is known; they are counted otherwise.
    """
    total = refs.count() if total is None else total
    groups = materialize(verdicts(parent_rows, refs, total // blocks))
    on = ["parent_table", "key"]
    heavy = groups.where("is_heavy")  # fewer than ``blocks``
    by_broadcast = refs.join(F.broadcast(heavy.where("is_bad")), on)
    by_shuffle = refs.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(groups.where("is_bad and not is_heavy"), on)
    found = by_broadcast.unionByName(by_shuffle)
    kind = F.coalesce(F.col("kind"), F.when(F.col("parent_at") > F.col("child_at"), F.lit("late")))
    rows = found.select("child_table", "parent_table", "child_id", "child_at", "side", kind.alias("kind")).where(F.col("kind").isNotNull())
    # copies of a child are equal, so one row per child, side and kind remains; of differing copies the earliest time
    return rows.groupBy("child_table", "parent_table", "child_id", "side", "kind").agg(F.min("child_at").alias("child_at"))


def orphan_totals(orphans: DataFrame) -> DataFrame:
    """Bad references per child table, side, kind and month of the child's time (null: no time)."""
    month = F.date_format("child_at", "yyyy-MM")
    return orphans.groupBy("child_table", "side", "kind", month.alias("month")).agg(F.count(F.lit(1)).alias("n_references"))
