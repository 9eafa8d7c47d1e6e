"""Lists of ranked places where several share a rank."""

import duckdb
import pytest

from freshet.operators import lists
from freshet.plans import registry


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_places_of_one_rank_come_by_key(spark, parts):
    rows = [(k, None if k % 6 == 0 else k % 3) for k in range(60)]
    want = sorted((r, k) for k, r in rows if r is not None)
    df = spark.createDataFrame(rows[::-1], "id long, priority_rank long").repartition(parts)
    assert [(x.priority_rank, x.id) for x in lists.by_rank(df).collect()] == want
    assert [(x.priority_rank, x.id) for x in lists.chosen(df, None).collect()] == want[:5]
    named = df.withColumnsRenamed({"id": "place", "priority_rank": "nth"})
    assert [(x.nth, x.place) for x in lists.chosen(named, None, 13, "place", "nth").collect()] == want[:13]


@pytest.mark.parametrize("backwards", [False, True])
def test_first_places_do_not_depend_on_how_rows_lie(spark, tmp_path, backwards):
    """Six copies of the suppliers with shifted keys: four places have rank 0, five rank 1. The SQL fixes the ranks, not which place of rank 1 is shown."""
    d, src = tmp_path / "data", "/root/testdata/sf0.1/supplier.parquet"
    (d / "supplier.parquet").mkdir(parents=True)
    for i in range(6):
        duckdb.sql(f"COPY (SELECT * REPLACE (s_suppkey + {i} * 1000 AS s_suppkey) FROM '{src}' ORDER BY s_suppkey {'DESC' if backwards else ''}) TO '{d}/supplier.parquet/part-{5 - i if backwards else i}.parquet'")
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{d}/supplier.parquet/*.parquet'")
    ranks = sorted(r for _, r in con.execute(registry.ORACLE["first_places"]).fetchall())
    want = sorted(con.execute(registry.ORACLE["priority_list"]).fetchall(), key=lambda x: (x[1], x[0]))[:5]
    got = [tuple(x) for x in registry.QUERIES["first_places"](spark, str(d)).collect()]
    assert got == want and [r for _, r in got] == ranks == [0, 0, 0, 0, 1]
