"""Queries that take rounds of joins, blocks of vectors or a reader, with their SQL where DuckDB can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.functions.dialect import DUCK, SPARK
from veritrail.operators.components import components, distances, shortest_paths
from veritrail.operators.nearest import nearest
from veritrail.operators.reader import read
from veritrail.operators.staged import ABLATIONS, MODES, run
from veritrail.plans import graph, retrieval
from veritrail.plans import views as v

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

def l14_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the whole graph of orders and parts; recursive SQL is too slow for it, so tests hold it against plain Python."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return components(lines.select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")))


def f9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions linked to the three nearest entities by cosine, over 0.75 only: every hundredth vector, blurred by the next one, stands for a mention."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    # The second filter follows from the join; it keeps all but a hundredth from moving.
    first, second = vectors.where("vec_id % 100 = 0").alias("a"), vectors.where("pmod(vec_id, 100) = 1").alias("b")
    mentions = first.join(second, F.expr("b.vec_id = a.vec_id + 1")).selectExpr("a.vec_id AS qid", f"{graph.BLURRED} AS embedding")
    return nearest(mentions, vectors, 3, 0.75)


def reached(plan, hops: int):
    """A plan over the view reached: nodes within hops edges of each region in the graph of all triples, found in rounds of joins.

    A round reads only the triples that an edge of its front can be: regions have nations for neighbours, these customers and suppliers, and so on.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text, fronts = plan(SPARK), [("region",)]
        for _ in range(hops - 1):
            fronts.append(v.neighbours(*fronts[-1]))
        steps = [f"WITH {v.sides(kinds)} SELECT x, y FROM sides" for kinds in fronts]
        for name in TABLES:
            if name in text + " ".join(steps):
                spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        distances([spark.sql(step) for step in steps], spark.sql(graph._REGIONS).select("origin"), hops).createOrReplaceTempView("reached")
        return spark.sql(text)

    run.__name__, run.__doc__ = plan.__name__, plan.__doc__
    return run


def l15_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from each region over nations to customers and suppliers, with the least path."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    up = nation.selectExpr("concat('region:', r_name) AS a", "concat('nation:', n_name) AS b")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("concat('nation:', n_name) AS a", "concat('customer:', cast(c_custkey AS string)) AS b")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("concat('nation:', n_name) AS a", "concat('supplier:', cast(s_suppkey AS string)) AS b")
    found = shortest_paths(up.unionByName(customer).unionByName(supplier), nation.selectExpr("concat('region:', r_name) AS origin").distinct(), 2)
    return found.select("origin", "node", F.col("distance").cast("bigint").alias("distance"), F.array_join("path", " > ").alias("path"))


L15 = """WITH n AS (SELECT concat('region:', r_name) AS r, concat('nation:', n_name) AS n, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT DISTINCT r AS origin, r AS node, cast(0 AS bigint) AS distance, r AS path FROM n UNION ALL SELECT r, n, 1, concat(r, ' > ', n) FROM n
  UNION ALL SELECT r, concat('customer:', cast(c_custkey AS string)), 2, concat(r, ' > ', n, ' > ', 'customer:', cast(c_custkey AS string)) FROM n JOIN customer ON c_nationkey = n_nationkey
  UNION ALL SELECT r, concat('supplier:', cast(s_suppkey AS string)), 2, concat(r, ' > ', n, ' > ', 'supplier:', cast(s_suppkey AS string)) FROM n JOIN supplier ON s_nationkey = n_nationkey"""


def q1_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns answered from the assistant turn that follows, by the extractive reader."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("evidence"))
    return read(asked.join(told, ["conv_id", "turn"], "left").select("conv_id", "turn", "question", "evidence")).select("conv_id", "turn", "answer", "confidence")


def staged(mode: str, ablation: str):
    """The staged program over all user turns: triples are those that the extractor reads from all documents, passages the assistant turns of a conversation."""

    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("documents")
        triples = spark.sql(f"WITH {retrieval._extracted(SPARK)} SELECT DISTINCT h, r, t FROM extracted WHERE h <> t")
        turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("qid", F.concat_ws("-", "conv_id", "turn"))
        told = turns.where("role = 'assistant'").select("conv_id", F.col("text").alias("passage"))
        asked = turns.where("role = 'user'").select("qid", "conv_id", F.col("text").alias("question"))
        return run(asked.select("qid", "question"), triples, asked.join(told, "conv_id").select("qid", "passage"), mode, ablation)

    plan.__name__, plan.__doc__ = f"q4_{mode if ablation == 'none' else ablation}", staged.__doc__
    return plan


_REACHED = graph.REACHED | retrieval.REACHED
QUERIES = (f9_embeddings, l14_components, l15_paths, q1_reader, *(reached(plan, hops) for plan, hops in _REACHED.items()), *(staged(m, "none") for m in MODES), *(staged("full", a) for a in ABLATIONS[1:]))
SQL = {"f9_embeddings": graph.f9_embeddings(DUCK), "l15_paths": L15, "q1_reader": retrieval.q1_reader(DUCK)} | {plan.__name__: plan(DUCK) for plan in _REACHED}
