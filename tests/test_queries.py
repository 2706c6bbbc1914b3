"""Registered queries of the library proper against their DuckDB twins on the smallest driver tables."""

import os

import duckdb
import pytest

from quarrylight.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "is_integer") or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    got = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect())
    assert got == want


def test_quota_fixed_point(spark):
    from quarrylight.operators.analytics import enforce_quotas

    df = spark.createDataFrame([(i, "a" if i < 90 else "b") for i in range(120)], "id int, c string")
    kept = {r["c"]: r["count"] for r in enforce_quotas(df, "c", "id", {"a": 0.5, "b": 0.5}, 1.0).groupBy("c").count().collect()}
    assert kept["b"] <= 30 and kept["a"] <= sum(kept.values()) * 0.5
