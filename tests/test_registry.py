"""Every registered query of the engine and its functions against its SQL."""

import math
import os

import duckdb
import pytest

from quern.plans import registry

DIR = os.environ.get("REGISTRY_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def plain(rows):
    return sorted((tuple(repr(v) if not isinstance(v, float) else f"{v:.9g}" for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    order = sorted(df.columns)
    got = plain(df.select(*[f"`{c}`" for c in order]).collect())
    if name not in registry.ORACLES:
        assert got and all(v not in ("nan", "None") for r in got for v in r)
        return
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == order
    want = plain(rel.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall())
    assert got == want
    assert not math.isnan(len(want))


@pytest.mark.parametrize("name", ["boss_query", "agg_sum", "agg_avg", "agg_whole_column", "agg_empty", "join_hash_m1", "join_many_many"])
def test_nothing_selected(spark, tmp_path, name):
    """Sums and averages of no rows are null in SQL, unless it says 0 itself."""
    own = duckdb.connect()
    for t in ("lineitem", "part", "customer", "supplier"):
        spark.read.parquet(f"{DIR}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        own.sql(f"CREATE TABLE {t} AS SELECT * FROM '{DIR}/{t}.parquet' LIMIT 0")
    df = registry.QUERIES[name](spark, str(tmp_path))
    want = own.sql(registry.ORACLES[name])
    assert plain(df.select(*want.columns).collect()) == plain(want.fetchall())
