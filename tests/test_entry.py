import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_names_match():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert {f"p{n}_found" for n in range(1, 6)} <= names


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_pair_counts", "p5_found", "r5_both_nodes", "g5_replay_atomic", "k11_as_of"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    df = entry.queries()[name](spark, SMALL)
    cur = con.execute(entry.oracle_sql()[name])
    names = sorted(c[0] for c in cur.description)
    assert names == sorted(df.columns)
    place = {c[0]: i for i, c in enumerate(cur.description)}
    want = sorted(str([r[place[n]] for n in names]) for r in cur.fetchall())
    assert sorted(str(list(r)) for r in df.select(*names).collect()) == want
