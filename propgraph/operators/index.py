"""Property and label indexes: long tables derived from the current properties, and lookups in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the shape of texts that count as numbers.
NUMBER = r"(?i)^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|[+-]?inf(inity)?|nan)$"


def value_type(value: Column) -> Column:
    """``numeric``, ``boolean`` (true or false in any case) or ``string``; a finite text beyond the range of doubles is a string."""
    spelled = value.rlike(r"(?i)^([+-]?inf(inity)?|nan)$")
    number = F.when(value.rlike(NUMBER) & ~spelled, value.try_cast("double"))
    return F.when(spelled | (F.abs(number) < F.lit(float("inf"))), F.lit("numeric")).when(F.lower(value).isin("true", "false"), F.lit("boolean")).otherwise(F.lit("string"))


def property_table(entities: DataFrame, key: str = "id") -> DataFrame:
    """``name, value_type, value, entity_id``: a row per property of each entity."""
    long = entities.select(F.col(key).alias("entity_id"), F.explode("properties").alias("name", "value"))
    return long.select("name", value_type(F.col("value")).alias("value_type"), "value", "entity_id")


def having(index: DataFrame, name: str) -> DataFrame:
    """Ids of entities that have the property."""
    return index.where(F.col("name") == name).select("entity_id").distinct()


def holding(index: DataFrame, name: str, value: str) -> DataFrame:
    """Ids of all entities whose property has that value."""
    return index.where((F.col("name") == name) & (F.col("value") == value)).select("entity_id").distinct()


def first_holding(index: DataFrame, name: str, value: str) -> DataFrame:
    """The smallest such id, or no row."""
    return holding(index, name, value).agg(F.min("entity_id").alias("entity_id")).where(F.col("entity_id").isNotNull())


def contains(index: DataFrame, name: str, value: str | None = None) -> DataFrame:
    """One row, ``present``."""
    hit = F.col("name") == name if value is None else (F.col("name") == name) & (F.col("value") == value)
    return index.where(hit).limit(1).agg((F.count(F.lit(1)) > 0).alias("present"))


def without(index: DataFrame, name: str, value: str | None = None, entity_id=None) -> DataFrame:
    """The index after deleting a name, a name's value, or one entity's value."""
    hit = F.col("name") == name
    if value is not None:
        hit &= F.col("value") == value
    if entity_id is not None:
        hit &= F.col("entity_id") == entity_id
    return index.where(~F.coalesce(hit, F.lit(False)))


def in_range(index: DataFrame, name: str, low: float, high: float) -> DataFrame:
    """Ids whose property is numeric and within the bounds. An extension."""
    number = F.col("value").try_cast("double")
    return index.where((F.col("name") == name) & (F.col("value_type") == "numeric") & number.between(low, high)).select("entity_id").distinct()


def with_token(index: DataFrame, name: str, token: str) -> DataFrame:
    """Ids whose property holds the word, in any case. An extension."""
    words = F.split(F.lower("value"), r"(?U)\W+")
    return index.where((F.col("name") == name) & F.array_contains(words, token.lower())).select("entity_id").distinct()


def label_index(entities: DataFrame, key: str = "id") -> DataFrame:
    """``label, entity_id``, each pair once: the index as one row per entry, which has no longest list."""
    return entities.where(F.col("label").isNotNull()).select("label", F.col(key).alias("entity_id")).distinct()


def labels_with(index: DataFrame, label: str) -> DataFrame:
    return index.where(F.col("label") == label).select("entity_id")
