"""The driver's tables as alignments, triples, vectors and job rows. All rows of each table take part.

The DataFrame views and the SQL texts in CTE say the same; a query and its SQL build on the same view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = "source string, target string, relation string, confidence double, type string"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pick(key: Column, *values: str) -> Column:
    """values[key % n]."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _part(key: Column) -> Column:
    return F.concat(F.lit("http://a#/"), pick(key, "class", "property", "resource"), F.lit("/"), key.cast("string"))


def _supplier(key: Column) -> Column:
    return F.concat(F.lit("http://b#/x/"), key.cast("string"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Line items as cells of part and supplier, every seventh order's turned round."""
    a, b = _part(F.col("l_partkey")), _supplier(F.col("l_suppkey"))
    turned = F.col("l_orderkey") % 7 == 0
    relation = F.when(F.col("l_returnflag") == "A", "=").when(F.col("l_returnflag") == "N", "<").when(F.col("l_linestatus") == "F", ">").otherwise("?")
    return table(spark, d, "lineitem").select(
        F.when(turned, b).otherwise(a).alias("source"), F.when(turned, a).otherwise(b).alias("target"), relation.alias("relation"), (F.col("l_discount") * 10).alias("confidence"), pick(F.col("l_linenumber"), "CLS", "OPROP", "DPROP", "INST").alias("type"),
        "l_quantity", F.col("l_orderkey").alias("_pos"), "l_extendedprice",
    )


def system(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).where("l_quantity >= 20")


def reference(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).where("l_quantity <= 30")


def partial_reference(spark: SparkSession, d: str) -> DataFrame:
    """A partial gold standard: the reference rows of suppliers whose number ends in 3."""
    return reference(spark, d).where("target LIKE '%3'")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Events as predictions of part and supplier pairs."""
    state = F.when(F.col("event_type").isin("purchase", "signup"), "true").when(F.col("event_type").isin("click", "view"), "false").otherwise("error")
    return table(spark, d, "events").select(_part(F.col("user_id")).alias("source"), _supplier(F.col("event_id") % 100).alias("target"), F.when(state != "error", state == "true").alias("verdict"), state.alias("state"), F.col("value").alias("oracle_confidence"), "event_id", pick(F.col("event_id"), "CLS", "OPROP", "DPROP", "INST").alias("type"))


def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """(child, parent): customers and suppliers below nations below regions."""
    def edge(t: str, child: Column, parent: Column) -> DataFrame:
        return table(spark, d, t).select(child.alias("child"), parent.alias("parent"))

    name = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    return edge("nation", name("n", "n_nationkey"), name("r", "n_regionkey")).unionByName(edge("customer", name("c", "c_custkey"), name("n", "c_nationkey"))).unionByName(edge("supplier", name("s", "s_suppkey"), name("n", "s_nationkey")))


def triples(spark: SparkSession, d: str) -> DataFrame:
    """Parts as subjects of brand, type and size."""
    p = table(spark, d, "part")
    rows = p.select(F.concat(F.lit("http://p/"), F.col("p_partkey").cast("string")).alias("s"), F.col("p_brand").alias("http://v#brand"), F.col("p_type").alias("http://v#type"), F.col("p_size").cast("string").alias("http://v#size"))
    return rows.unpivot("s", ["http://v#brand", "http://v#type", "http://v#size"], "p", "o").withColumn("o_is_literal", F.lit(True)).withColumn("lang", F.lit(None).cast("string")).withColumn("datatype", F.lit(None).cast("string"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as finished jobs with counts."""
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "degraded").otherwise("not_run")
    n = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        n.cast("string").alias("id"), F.col("o_orderpriority").alias("task"), pick(F.col("o_custkey"), "m0", "m1", "m2").alias("model"), pick(n, "c0", "c1").alias("condition"), status.alias("status"), (n % 13).alias("tp"), (n % 5).alias("fp"), F.when(n % 11 != 0, n % 7).alias("fn"), (n % 3).alias("tn"), F.round("o_totalprice", 2).alias("score"), n.alias("_pos"),
    )


CTE = {
    "cells": """cells AS (
  SELECT CASE WHEN k % 7 = 0 THEN b ELSE a END AS source, CASE WHEN k % 7 = 0 THEN a ELSE b END AS target, relation, confidence, type, l_quantity, k AS _pos, l_extendedprice
  FROM (SELECT l_orderkey AS k, 'http://a#/' || ['class', 'property', 'resource'][l_partkey % 3 + 1] || '/' || l_partkey AS a, 'http://b#/x/' || l_suppkey AS b,
    CASE WHEN l_returnflag = 'A' THEN '=' WHEN l_returnflag = 'N' THEN '<' WHEN l_linestatus = 'F' THEN '>' ELSE '?' END AS relation,
    l_discount * 10 AS confidence, ['CLS', 'OPROP', 'DPROP', 'INST'][l_linenumber % 4 + 1] AS type, l_quantity, l_extendedprice FROM lineitem)),
sys AS (SELECT * FROM cells WHERE l_quantity >= 20), ref AS (SELECT * FROM cells WHERE l_quantity <= 30),
s AS (SELECT DISTINCT source, target FROM sys), r AS (SELECT DISTINCT source, target FROM ref)""",
    "answers": """answers AS (
  SELECT 'http://a#/' || ['class', 'property', 'resource'][user_id % 3 + 1] || '/' || user_id AS source, 'http://b#/x/' || (event_id % 100) AS target,
    CASE WHEN event_type IN ('purchase', 'signup') THEN true WHEN event_type IN ('click', 'view') THEN false END AS verdict,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'true' WHEN event_type IN ('click', 'view') THEN 'false' ELSE 'error' END AS state, value AS oracle_confidence, event_id,
    ['CLS', 'OPROP', 'DPROP', 'INST'][event_id % 4 + 1] AS type FROM events)""",
    "hierarchy": """hierarchy AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)""",
    "triples": """triples AS (SELECT 'http://p/' || p_partkey AS s, 'http://v#brand' AS p, p_brand AS o FROM part UNION ALL SELECT 'http://p/' || p_partkey, 'http://v#type', p_type FROM part UNION ALL SELECT 'http://p/' || p_partkey, 'http://v#size', CAST(p_size AS VARCHAR) FROM part)""",
    "jobs": """jobs AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS task, ['m0', 'm1', 'm2'][o_custkey % 3 + 1] AS model, ['c0', 'c1'][o_orderkey % 2 + 1] AS condition,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'P' THEN 'degraded' ELSE 'not_run' END AS status, o_orderkey % 13 AS tp, o_orderkey % 5 AS fp, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 7 END AS fn, o_orderkey % 3 AS tn, round(o_totalprice, 2) AS score, o_orderkey AS _pos FROM orders)""",
}
