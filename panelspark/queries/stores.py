"""Tables written to the shared folder and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.text import zone_label
from panelspark.queries.base import query, table
from panelspark.session import stage_folder
from panelspark.sources import scans, sinks


@query("partition_round_trip", """SELECT c_custkey AS pixel_id, c_mktsegment AS lulc,
    c_acctbal AS value FROM customer""")
def partition_round_trip(spark, sf):
    """Written by segment, sorted inside the files; each partition read on its own."""
    path = stage_folder(spark, "by_segment")
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("pixel_id"), F.col("c_mktsegment").alias("lulc"),
        F.col("c_acctbal").alias("value"))
    sinks.write_sorted(c, path, ["pixel_id"], ["lulc"])
    kinds = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    return reduce(DataFrame.unionByName, [
        scans.read_partition(spark, path, "lulc", k) for k in kinds])


@query("consolidated", "SELECT p_partkey, p_brand, p_retailprice FROM part")
def consolidated(spark, sf):
    """Many part files rewritten as few, one range of keys each."""
    path = stage_folder(spark, "consolidated")
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    sinks.consolidate(p.repartition(24), path, "p_brand", "p_partkey", 4)
    return scans.read_columns(spark, path, ["p_partkey", "p_brand", "p_retailprice"])


@query("lookup_round_trip", """SELECT n_nationkey, CASE n_regionkey WHEN 3 THEN NULL ELSE n_name
    END AS n_name FROM nation""")
def lookup_round_trip(spark, sf):
    """A lookup as compressed CSV, read with its declared schema; nulls stay null."""
    path = stage_folder(spark, "lookup")
    n = table(spark, sf, "nation").select(
        "n_nationkey", F.when(F.col("n_regionkey") != 3, F.col("n_name")).alias("n_name"))
    sinks.write_csv(n, path, gzip=True)
    return scans.read_lookup(spark, path, "n_nationkey INT, n_name STRING")


@query("merged_store", """SELECT o_custkey AS pixel_id, max(o_totalprice) AS value FROM orders
    GROUP BY 1 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN
    (SELECT o_custkey FROM orders)""")
def merged_store(spark, sf):
    """Stored rows replaced by key with what comes in, written again."""
    old, new = stage_folder(spark, "store"), stage_folder(spark, "store")
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("pixel_id"), F.col("c_acctbal").alias("value"))
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("pixel_id")).agg(
        F.max("o_totalprice").alias("value"))
    sinks.write_sorted(c, old, ["pixel_id"])
    merged = sinks.merge_by_key(spark.read.parquet(old), o, ["pixel_id"])
    sinks.write_sorted(merged, new, ["pixel_id"])
    return spark.read.parquet(new)


@query("zone_labels", """SELECT CASE WHEN z = '' THEN 'Statewide' WHEN z = '01' THEN 'Coast'
    WHEN z = '08' THEN 'Inland' END AS label, count(*) AS n FROM (SELECT CASE WHEN c_nationkey < 3
    THEN '' WHEN c_nationkey < 5 THEN '' ELSE lpad(CAST(c_nationkey % 9 AS VARCHAR), 2, '0') END
    AS z FROM customer) GROUP BY 1""")
def zone_labels(spark, sf):
    """Empty and missing codes are the whole area; codes without a label are not shown."""
    k = F.col("c_nationkey")
    z = F.when(k < 3, F.lit("")).when(k >= 5, F.lpad((k % 9).cast("string"), 2, "0"))
    label = zone_label(z, {"01": "Coast", "08": "Inland"})
    return table(spark, sf, "customer").groupBy(label.alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
