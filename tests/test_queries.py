"""Every query with SQL gives DuckDB's rows."""

from collections import Counter

import pytest

from duskveil.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "customer orders events documents".split()


def plain(v):
    return None if v is None or v != v else str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: Counter(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
    assert len(got)


def test_limited_audit(spark):
    from duskveil.operators.ratelimit import RateLimiter, limited_events

    events = spark.createDataFrame([("json_masked", k, k) for k in range(10)] + [("user.email", 5, 20)], "path string, s long, seq long")
    got = Counter(r["path"] for r in limited_events(events, RateLimiter(3, 60), "s", "seq").collect())
    assert got == {"json_masked": 3, "rate_limit_exceeded": 1, "user.email": 1}


def test_limiter_without_keys_and_with_clashing_names(spark):
    from duskveil.functions.errors import ConfigurationError
    from duskveil.operators.ratelimit import RateLimiter

    rows = spark.createDataFrame([(None, 1, 1, "x"), (None, 1, 2, "y"), ("a", 1, 4, "w")], "key string, second long, nth long, ok string")
    got = {r["nth"]: (r["ok"], r["allowed"]) for r in RateLimiter(1, 10).allowed(rows, "key", "second", "nth").collect()}
    assert got == {1: ("x", True), 2: ("y", False), 4: ("w", True)}
    with pytest.raises(ConfigurationError):
        RateLimiter(1, 10).allowed(rows.withColumnRenamed("ok", "allowed"), "key", "second", "nth")


@pytest.mark.parametrize("gone", ["duskveil.llm", "corpus_pipeline", "xxhash"])
def test_entry_without_llm(monkeypatch, gone):
    import sys

    import __spark_entry__ as e

    for name in [n for n in sys.modules if n.startswith("duskveil.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, gone, None)
    assert set(e.queries()) == set(registry.queries()) and set(e.oracle_sql()) == set(registry.oracle_sql())
