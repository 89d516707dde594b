"""Per-key results where a few keys hold most records.

Method: rows are range partitioned on the composite key and a secondary order, along quantiles that
Spark samples, so a heavy key is split over as many partitions as its share asks for. Each sorted
partition is scanned once into a partial state per key; the states of a key that lie on both sides of a
partition boundary are stitched. Every partition gets about the same number of rows whatever the keys.

The scan counts distinct values. A value's copies are neighbours; a value that straddles a boundary is
the last of one state and the first of the next, and counts once. Keys that begin and end within a
partition are finished there; only the first and the last key of each partition leave partial states
to be stitched, so no key is shuffled again.

Defined results: null key columns form keys of their own (null equals null); null values aren't
counted but their rows are; repeated rows count as rows and once as values; empty input gives an empty
result; extra columns are ignored. Values are compared as strings, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize, shuffle_partitions

#: Values of the number that breaks ties between a value's copies, so that these can be split as well.
TIES = 1024


def _changes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Whether each row but the first differs from the row before; null equals null."""
    a, b = column[:-1], column[1:]
    differ = pc.fill_null(pc.not_equal(a, b), True)
    if column.null_count:
        differ = pc.and_not(differ, pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.asarray(differ.to_numpy(zero_copy_only=False), dtype=bool)


def _scanner(keys: list[str], n_measures: int):
    """Sorted rows to finished keys, and states of the first and the last key of the partition.

    Every row occurs once per measure, so a key is ``n_measures`` runs in a row. Only the runs of the
    key a batch ends in are held; all others leave as arrays.
    """
    names = [*keys, "_measure"] if n_measures > 1 else keys

    def states(held: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([h["key"][i] for h in held], schema.field(c).type) for i, c in enumerate(keys)]
        columns += [pa.array([h[k] for h in held], t) for k, t in (("measure", pa.int32()), ("rows", pa.int64()), ("first", pa.string()), ("last", pa.string()))]
        columns += [pa.array([h["distinct"] if i == 0 else None for h in held], pa.int64()) for i in range(n_measures)]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "_measure", "_rows", "_first", "_last", *(f"_n{i}" for i in range(n_measures))])

    def merge(held: list[dict], more: list[dict]) -> None:
        for now in more:
            if held and held[-1]["measure"] == now["measure"]:
                run = held[-1]
                run["distinct"] += now["distinct"] - (now["first"] is not None and now["first"] == run["last"])
                run["rows"] += now["rows"]
                run["last"] = now["last"]
                if run["first"] is None:
                    run["first"] = now["first"]
            else:
                held.append(now)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        opening, schema = True, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            schema = batch.schema
            new, fresh = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
            new_key = np.ones(n, dtype=bool)
            value = batch.column("_value")
            if n > 1:
                new_key[1:] = np.logical_or.reduce([_changes(batch.column(c)) for c in keys])
                new[1:] = new_key[1:] | _changes(batch.column("_measure")) if n_measures > 1 else new_key[1:]
                fresh[1:] = new[1:] | _changes(value)
            if value.null_count:
                fresh &= np.asarray(pc.is_valid(value).to_numpy(zero_copy_only=False), dtype=bool)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], n)
            distinct, rows = np.add.reduceat(fresh.astype(np.int64), starts), ends - starts
            of_key = np.cumsum(new_key[starts]) - 1  # the key, within the batch, of each run

            def some(low: int, high: int) -> list[dict]:
                at, to = pa.array(starts[low:high]), pa.array(ends[low:high] - 1)
                heads = [batch.column(c).take(at).to_pylist() for c in keys]
                measures = batch.column("_measure").take(at).to_pylist() if n_measures > 1 else [0] * (high - low)
                first, last = value.take(at).to_pylist(), value.take(to).to_pylist()
                return [
                    {"key": tuple(h[i] for h in heads), "measure": measures[i], "rows": int(rows[low + i]), "distinct": int(distinct[low + i]), "first": first[i], "last": last[i]}
                    for i in range(high - low)
                ]

            n_keys = int(of_key[-1]) + 1
            low, high = int(np.searchsorted(of_key, 1)), int(np.searchsorted(of_key, n_keys - 1))
            head = some(0, low)
            if held and held[0]["key"] == head[0]["key"]:
                merge(held, head)
                if n_keys == 1:
                    continue
            elif held:
                # the held key is over; it is unfinished only if the partition began with it
                yield states(held, schema) if opening else _finished(held, schema)
                opening, held = False, head
            else:
                held = head
            if n_keys > 1:
                yield states(held, schema) if opening else _finished(held, schema)
                opening = False
                if high > low:
                    at = pa.array(starts[low:high:n_measures])
                    columns = [batch.column(c).take(at) for c in keys]
                    nothing = [pa.nulls(len(at), t) for t in (pa.int32(), pa.string(), pa.string())]
                    counts = distinct[low:high].reshape(-1, n_measures)
                    columns += [nothing[0], pa.array(rows[low:high:n_measures]), nothing[1], nothing[2], *(pa.array(np.ascontiguousarray(counts[:, i])) for i in range(n_measures))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keys, "_measure", "_rows", "_first", "_last", *(f"_n{i}" for i in range(n_measures))])
                held = some(high, len(starts))
        if held:
            yield states(held, schema)

    def _finished(held: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        row = held[0]
        columns = [pa.array([row["key"][i]], schema.field(c).type) for i, c in enumerate(keys)]
        columns += [pa.nulls(1, pa.int32()), pa.array([row["rows"]], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string())]
        columns += [pa.array([h["distinct"]], pa.int64()) for h in held]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "_measure", "_rows", "_first", "_last", *(f"_n{i}" for i in range(n_measures))])

    return scan


def balanced_distinct(df: DataFrame, keys: list[str], measures: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Per key: ``n_rows``, and for each ``name: column`` of ``measures`` the number of distinct values ``name``.

    ``partitions``: how many ranges the rows are cut into, ``spark.sql.shuffle.partitions`` by default.
    The scan's result, a row per key and a few states per partition, is written.
    """
    n = partitions or shuffle_partitions(df.sparkSession)
    tie = F.pmod(F.monotonically_increasing_id(), F.lit(TIES)).cast("smallint").alias("_tie")
    if len(measures) == 1:
        long = df.select(*keys, F.col(*measures.values()).cast("string").alias("_value"), tie)
        order = [*keys, "_value"]
    else:
        cells = F.array(*(F.struct(F.lit(i).alias("m"), F.col(c).cast("string").alias("v")) for i, c in enumerate(measures.values())))
        exploded = df.select(*keys, tie, F.explode(cells).alias("_cell"))
        long = exploded.select(*keys, F.col("_cell.m").alias("_measure"), F.col("_cell.v").alias("_value"), "_tie")
        order = [*keys, "_measure", "_value"]
    ordered = long.repartitionByRange(n, *order, "_tie").sortWithinPartitions(*order).drop("_tie")
    schema = T.StructType([df.schema[k] for k in keys])
    for name, kind in (("_measure", T.IntegerType()), ("_rows", T.LongType()), ("_first", T.StringType()), ("_last", T.StringType()), *((f"_n{i}", T.LongType()) for i in range(len(measures)))):
        schema.add(name, kind)
    scanned = materialize(ordered.mapInArrow(_scanner(keys, len(measures)), schema))
    finished = scanned.where(F.col("_measure").isNull()).select(*keys, F.col("_rows").alias("n_rows"), *(F.col(f"_n{i}").alias(name) for i, name in enumerate(measures)))
    return finished.unionByName(stitch(scanned.where(F.col("_measure").isNotNull()), keys, list(measures)))


def stitch(states: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Sum the partial states of each key; a value that is the last of a state and the first of the next counts once.

    A partition leaves at most two states per measure. States of a key and measure follow each other as
    their first values do; a state of nulls only comes first.
    """
    along = Window.partitionBy(*keys, "_measure").orderBy(F.col("_first").asc_nulls_first(), F.col("_last").asc_nulls_first())
    # nulls come first in a partition, so a state's first value that isn't null may follow nulls
    twice = F.col("_first").isNotNull() & F.coalesce(F.lag("_last").over(along) == F.col("_first"), F.lit(False))
    parts = states.withColumn("_new", F.col("_n0") - twice.cast("bigint"))
    sums = [F.sum(F.when(F.col("_measure") == i, F.col("_new"))).alias(name) for i, name in enumerate(names)]
    return parts.groupBy(*keys).agg(F.sum(F.when(F.col("_measure") == 0, F.col("_rows"))).alias("n_rows"), *sums)


def heavy_pairs(pairs: DataFrame, count: str, share: float) -> DataFrame:
    """Keys of a ``balanced_distinct`` result whose ``count`` is at least ``share`` of the column's sum."""
    total = pairs.agg(F.sum(count)).scalar()
    return pairs.where(F.col(count) >= F.lit(share) * total)
