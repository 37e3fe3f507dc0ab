"""The corpus' tables, bound to whatever star schema is at hand.

A report is a document that carries an ordered chain of transmitters: id, slug (its collection), chapter, grade,
to_apex (the chain runs into the apex), names_apex (the text names it), chain (array of transmitter ids, nearest the
apex first) and gaps (places i where somebody between chain[i] and chain[i+1] is not known). The binding derives
chains from order lines, as the tests and the SQL oracles do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

APEX = "prophet"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collector(slug):
    return F.concat(F.lit("collector:"), slug)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order; one shuffle of the lines, then array functions. Orders without lines have an empty chain."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    kept = F.filter("lines", lambda x, i: (i == 0) | (x["l_suppkey"] != F.get(F.col("lines"), i - 1)["l_suppkey"]))
    flagged = F.transform("kept", lambda x, i: F.when((x["l_returnflag"] == "R") & (i < F.size("kept") - 1), i))
    chains = lines.select("l_orderkey", kept.alias("kept")).select("l_orderkey", F.transform("kept", lambda x: F.concat(F.lit("r"), x["l_suppkey"].cast("string"))).alias("chain"), F.array_compact(flagged).alias("gaps"))
    o = read(spark, sf_dir, "orders")
    grades = F.get(F.array(*[F.lit(g) for g in ("Sahih", "Hasan Sahih", "Hasan", "Da'if", "Da'if Munkar", None)]), (F.col("o_custkey") % 6).cast("int"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return o.join(chains, o.o_orderkey == chains.l_orderkey, "left").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("slug"),
        F.year("o_orderdate").alias("chapter"),
        grades.alias("grade"),
        (F.col("o_orderstatus") == "F").alias("to_apex"),
        (F.col("o_orderstatus") == "P").alias("names_apex"),
        F.coalesce("chain", none("string")).alias("chain"),
        F.coalesce("gaps", none("int")).alias("gaps"),
    )


def transmitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, tabaqa (class), died, woman for each supplier."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("r"), k.cast("string")).alias("id"),
        F.col("s_name").alias("name"),
        F.when(k % 3 != 0, F.col("s_nationkey") % 12 + 1).cast("int").alias("tabaqa"),
        F.when(k % 5 != 0, 11 + k * 7 % 290).cast("int").alias("died"),
        (k % 9 == 0).alias("woman"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slug, text of documents; a source is a collection."""
    return read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("slug"), "text")


#: The same binding in SQL: k holds the kept links of each chain, r the reports, s the transmitters.
SQL = """l AS (
  SELECT l_orderkey AS id, 'r' || l_suppkey AS nar, l_suppkey AS sk, l_returnflag AS f, row_number() OVER w AS rn, lag(l_suppkey) OVER w AS prev
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
k AS (SELECT id, nar, f, row_number() OVER (PARTITION BY id ORDER BY rn) - 1 AS pos, count(*) OVER (PARTITION BY id) AS n FROM l WHERE prev IS NULL OR prev <> sk),
r AS (SELECT o_orderkey AS id, o_orderpriority AS slug, year(o_orderdate) AS chapter, o_orderstatus = 'F' AS to_apex, o_orderstatus = 'P' AS names_apex,
  CASE o_custkey % 6 WHEN 0 THEN 'Sahih' WHEN 1 THEN 'Hasan Sahih' WHEN 2 THEN 'Hasan' WHEN 3 THEN 'Da''if' WHEN 4 THEN 'Da''if Munkar' END AS grade FROM orders),
s AS (SELECT 'r' || s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey % 12 + 1 END AS tabaqa,
  CASE WHEN s_suppkey % 5 <> 0 THEN 11 + s_suppkey * 7 % 290 END AS died, s_suppkey % 9 = 0 AS woman FROM supplier),
steps AS (
  SELECT k.id, 0 AS at, 'prophet' AS src, nar AS dst, NOT to_apex AS gap FROM k JOIN r USING (id) WHERE pos = 0 AND (to_apex OR names_apex)
  UNION ALL SELECT a.id, a.pos + 1, a.nar, b.nar, a.f = 'R' FROM k a JOIN k b ON a.id = b.id AND b.pos = a.pos + 1
  UNION ALL SELECT k.id, n, nar, 'collector:' || slug, false FROM k JOIN r USING (id) WHERE pos = n - 1)"""
