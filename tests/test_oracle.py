"""Every core query against its SQL on DuckDB, and the results of the rounds of joins against plain Python."""

import math
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from veritrail import queries as core


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in core.TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 3) + 0.0
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_as_sql(spark, sf, duck, name):
    got = core.QUERIES[name](spark, sf)
    want = duck.sql(core.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    assert a == b, [(x, y) for x, y in zip(a, b, strict=True) if x != y][:3]
    kinds = dict(got.dtypes)
    for column, kind in zip(want.columns, want.types, strict=True):
        assert kinds[column] == {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "INTEGER": "int"}.get(str(kind), kinds[column]), (column, kind)


def test_components_and_paths(spark):
    from veritrail.operators.components import components, shortest_paths

    edges = [(1, 2), (2, 3), (5, 6), (7, 7), (3, 9), (9, 1), (10, 6)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, 10: 5, 7: 7}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    paths = shortest_paths(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(1,)], "origin long"), 3).collect()
    found = {r["node"]: (r["distance"], tuple(r["path"])) for r in paths}
    assert found == {1: (0, (1,)), 2: (1, (1, 2)), 9: (1, (1, 9)), 3: (2, (1, 2, 3))}


def test_components_of_all_lines(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for order, part in lines:
        x, y = root(order * 2), root(part * 2 + 1)
        parent[max(x, y)] = min(x, y)
    got = core.QUERIES["l14_components"](spark, sf).collect()
    assert len(got) == len(parent)
    assert all(r["component"] == root(r["node"]) for r in got)
