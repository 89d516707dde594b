"""Queries over the test tables for the text operators, and SQL where it can give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, table
from . import abuse, leakage, mixing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---------------------------------------------------------------- problem 6: leaked evaluation texts


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where(F.col("n_words") >= leakage.MIN_WORDS).select("doc_id", "item_id")


@query
def p6_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item's template, but with other numbers, names or units, each value refilled alike wherever it recurs."""
    return _leaks(spark, sf_dir).where((F.col("n_words") < leakage.MIN_WORDS) & F.col("consistent")).drop("consistent")


@query
def p6_inconsistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a value that is refilled in several ways: another text of the same build."""
    return _leaks(spark, sf_dir).where((F.col("n_words") < leakage.MIN_WORDS) & ~F.col("consistent")).drop("consistent")


@query
def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: documents it leaked into and the longest run."""
    return _leaks(spark, sf_dir).where(F.col("n_words") >= leakage.MIN_WORDS).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("longest"))


# ---------------------------------------------------------------- problem 7: mixing sources


def _mix(spark: SparkSession, sf_dir: str, how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counted documents, the mix that ``how`` plans from the sources' totals, and the listed sources."""
    listed = table(spark, sf_dir, "source_weights")
    counts = materialize(mixing.count_tokens(table(spark, sf_dir, "documents")))
    return counts, mixing.realise(counts, how(mixing.listed_totals(counts, listed))), listed


def _tempered(totals: list) -> list:
    """Own shares raised to the exponent that gives the entropy of the target shares."""
    targets = [t[2] for t in totals if t[1] > 0 and t[2] and t[2] > 0]
    return mixing.temper(totals, target_entropy=mixing.entropy([t / sum(targets) for t in targets]))


def _evened(totals: list) -> list:
    """Own shares raised to the lowest exponent that the repetition limits allow at the size of the listed sources."""
    return mixing.temper(totals, size=sum(t[1] for t in totals))


@query
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir, mixing.plan)[1]


@query
def p7_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same mix as an order: a row per copy, ``place`` sorts each pass."""
    return mixing.permuted(_mix(spark, sf_dir, mixing.plan)[1])


@query
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and shares reached, all targets met."""
    return mixing.shares_reached(*_mix(spark, sf_dir, mixing.plan))


@query
def p7_shares_full_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with as many tokens as the listed sources have, which takes a higher exponent."""
    return mixing.shares_reached(*_mix(spark, sf_dir, lambda totals: mixing.plan(totals, sum(t[1] for t in totals))))


@query
def p7_tempered_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature mixing over the sources' own shares, bisected to the entropy of the target shares."""
    return _mix(spark, sf_dir, _tempered)[1]


@query
def p7_tempered_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its shares beside the targets."""
    return mixing.shares_reached(*_mix(spark, sf_dir, _tempered))


@query
def p7_evened_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature mixing over the own shares, bisected to the repetition limits at full size."""
    return mixing.shares_reached(*_mix(spark, sf_dir, _evened))


# ---------------------------------------------------------------- problem 8: abusive content


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return abuse.score_documents(documents, abuse.fit(documents, table(spark, sf_dir, "review_labels")))


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("flagged").select("doc_id")


@query
def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"), "flagged")


@query
def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(_scored(spark, sf_dir))
