"""The library's own queries and their SQL; the llm subpackage adds its own in __spark_entry__.py.

A plan is a function of a dialect that gives SQL: Spark runs it over temporary views of
the tables, DuckDB runs its own form of it as the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritrail.functions.dialect import DUCK, SPARK
from veritrail.plans import audit, fusion, graph, more, retrieval, rounds, selectors, shapes, texts
from veritrail.plans.rounds import TABLES



def tables(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Temporary views of the tables that a text names."""
    for name in TABLES:
        if name in text:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def planned(plan) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = plan(SPARK)
        tables(spark, sf_dir, text)
        return spark.sql(text)

    run.__name__, run.__doc__ = plan.__name__, plan.__doc__
    return run


PLANS = {p.__name__: p for module in (audit, texts, graph, fusion, more, shapes, selectors, retrieval) for p in module.QUERIES}
QUERIES = {name: planned(p) for name, p in PLANS.items()} | {f.__name__: f for f in rounds.QUERIES}
SQL = {name: p(DUCK) for name, p in PLANS.items()} | rounds.SQL
