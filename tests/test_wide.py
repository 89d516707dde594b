import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from propgraph.functions.values import read_as
from propgraph.operators import wide

ROWS = "row_no bigint, entity_id bigint, prop_name string, prop_value string, written_at timestamp_ntz, label string"
NODES = "id bigint, label string, entity_id string"
TYPES = "label string, attr_name string, value_type string"
DAY = dt.datetime(2025, 1, 1)


@pytest.fixture
def types(spark):
    return spark.createDataFrame(
        [("Ship", "crew_size", "bigint"), ("Ship", "built_on", "date"), ("Ship", "name", "string"), ("Port", "name", "string"), ("Port", "open", "boolean"), ("Port", "size", "double"), ("Ship", "size", "bigint")], TYPES
    )


def widen(spark, types, rows, nodes):
    return wide.widen(spark.createDataFrame(rows, ROWS), spark.createDataFrame(nodes, NODES), types)


def test_values_in_force_and_types(spark, types, rows):
    data = [
        (1, 7, "Crew-Size ", "12", DAY, "x"),
        (2, 7, "crewSize", "1,013", DAY, "x"),  # same time, higher row
        (3, 7, "crew_size", "9", None, "x"),  # no time is oldest
        (4, 7, "built_on", " 31.12.1999\t", DAY, "x"),
        (4, 7, "built_on", " 31.12.1999\t", DAY, "x"),
        (5, 8, "open", "Y", DAY, "x"),
        (6, 8, "SIZE", "-.5e3", DAY, "x"),
        (7, 8, "crew_size", "5", DAY, "x"),  # not of this label
        (8, 99, "name", "nobody", DAY, "x"),
        (9, None, "name", "nobody", DAY, "x"),
        (10, 8, None, "nobody", DAY, "x"),
        (11, 9, "name", "labelless", DAY, "x"),
    ]
    w = widen(spark, types, data, [(7, "Ship", "a"), (7, "Ship", "b"), (8, "Port", None), (9, None, None), (10, "Ghost", None), (None, "Ship", None)])
    got = {r.entity_id: r.asDict() for r in w.collect()}
    assert set(got) == {7, 8, 9, 10}
    assert got[7]["crew_size"] == 1013 and got[7]["built_on"] == dt.date(1999, 12, 31) and got[7]["Ship__size"] is None
    assert got[8]["open"] is True and got[8]["Port__size"] == -500.0 and got[8]["crew_size"] is None
    assert all(v is None for k, v in got[9].items() if k not in ("entity_id", "unreadable")) and got[9]["unreadable"] == []
    assert got[10]["label"] == "Ghost"


def test_unreadable(spark, types, rows):
    data = [(1, 7, "crew_size", "l2", DAY, ""), (2, 7, "built_on", "30.02.2020", DAY, ""), (3, 7, "name", "x", DAY, ""), (4, 8, "open", " \t", DAY, ""), (5, 8, "size", "inf", DAY, ""), (6, 8, "size", "inf", DAY, "")]
    w = widen(spark, types, data, [(7, "Ship", ""), (8, "Port", "")])
    assert rows(wide.unreadable_values(w)) == [(7, "built_on"), (7, "crew_size"), (8, "size")]


def test_blank_in_force_hides_older_garbage(spark, types, rows):
    data = [(1, 7, "crew_size", "garbage", DAY, ""), (2, 7, "crew_size", None, DAY + dt.timedelta(1), "")]
    assert rows(wide.unreadable_values(widen(spark, types, data, [(7, "Ship", "")]))) == []


def test_empty_tables(spark, types):
    assert widen(spark, types, [], []).count() == 0
    assert widen(spark, types.limit(0), [(1, 7, "a", "b", DAY, "")], [(7, "Ship", "")]).collect()[0].asDict() == {"entity_id": 7, "label": "Ship", "unreadable": []}
    assert widen(spark, types, [], [(7, "Ship", "")]).count() == 1


def test_very_long_value(spark, types):
    w = widen(spark, types, [(1, 7, "crew_size", "9" * 1_000_000, DAY, ""), (2, 7, "name", "n" * 1_000_000, DAY, "")], [(7, "Ship", "")]).collect()[0]
    assert w.unreadable == ["crew_size"] and len(w.name) == 1_000_000


CASES = {
    "bigint": {"1": 1, "+5": 5, "-1,234,567": -1234567, "9223372036854775807": 2**63 - 1, "9223372036854775808": None, "1,23": None, "1.0": None, "--1": None, "٣": None, "1_0": None, "": None, "\xa07　": 7, "0012": 12},
    "double": {"1.": 1.0, ".5": 0.5, "1,000.25": 1000.25, "1e3": 1000.0, "1e999": None, "NaN": None, "inf": None, ".": None, "1e": None, "1d": None, "250,50": None, "-1E-2": -0.01},
    "boolean": {"YES": True, "n": False, " t ": True, "0": False, "on": None, "truth": None},
    "date": {"2024-02-29": dt.date(2024, 2, 29), "2023-02-29": None, "2020/01/31": dt.date(2020, 1, 31), "31.01.2020": dt.date(2020, 1, 31), "2020-01/31": None, "2020-1-1": None, "0000-01-01": None, "1990": None},
    "timestamp": {"2024-02-29T23:59:59Z": dt.datetime(2024, 2, 29, 23, 59, 59), "2024-02-30 00:00:00": None, "2024-01-01 24:00:00": None, "2024-01-01 10:00": None, "2024-01-01 10:00:00": dt.datetime(2024, 1, 1, 10), "2024-01-01  10:00:00": None},
    "string": {" a ": "a", "\t": None},
}


@pytest.mark.parametrize("kind", CASES)
def test_readers(spark, kind):
    df = spark.createDataFrame([(k,) for k in CASES[kind]], "v string")
    assert {r.v: r.x for r in df.select("v", read_as(F.col("v"), kind).alias("x")).collect()} == CASES[kind]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="0123456789+-.,eE ", max_size=8), min_size=1, max_size=60))
def test_double_reader_against_python(texts):
    import re

    from pyspark.sql import SparkSession

    s = SparkSession.getActiveSession()
    if s is None:
        pytest.skip("no session")
    shape = re.compile(r"[+-]?((\d{1,3}(,\d{3})+|\d+)(\.\d*)?|\.\d+)([eE][+-]?\d+)?", re.A)

    def read(t):
        t = t.strip()
        return float(t.replace(",", "")) if shape.fullmatch(t) and math.isfinite(float(t.replace(",", ""))) else None

    df = s.createDataFrame([(t,) for t in texts], "v string")
    assert [r.x for r in df.select(read_as(F.col("v"), "double").alias("x")).collect()] == [read(t) for t in texts]


def test_names_that_differ_in_case_share_a_column(spark, tmp_path):
    types = spark.createDataFrame([("A", "Name", "string"), ("B", "name", "string"), ("A", "x y", "bigint"), ("B", "X_Y", "double"), ("B", "a__x y", "string"), ("A", "Label", "string"), ("B", "label", "bigint")], TYPES)
    w = widen(spark, types, [(1, 1, "NAME", "n", DAY, ""), (2, 2, "na me", "m", DAY, ""), (3, 1, "XY", "4", DAY, ""), (4, 2, "xy", ".5", DAY, "")], [(1, "A", ""), (2, "B", "")])
    low = [c.lower() for c in w.columns]
    assert len(set(low)) == len(low)
    w.write.parquet(str(tmp_path / "w"))
    got = {r.entity_id: r for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    assert got[1]["Name"] == "n" and got[2]["Name"] == "m" and 4 in tuple(got[1])[2:] and 0.5 in tuple(got[2])[2:]
