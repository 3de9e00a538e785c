"""Whole loads of layers and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators.core import registry
from panelspark.queries.base import layer_values, query, table, with_
from panelspark.queries.joins import _xwalk
from panelspark.sources import loads as D

LOADED = with_("layer_values", ld="""SELECT layer, year, pixel_id, CASE WHEN layer = 'LA' THEN
    CASE WHEN value <> 25 THEN value * 0.5 END WHEN layer = 'LN' THEN CASE WHEN value <> 10 THEN
    value * 2.0 END ELSE value END AS value FROM layer_values""")


def loaded(spark, sf):
    """LA takes its source's no-data code and its own scale, LN the reverse, LR neither."""
    one = F.lit(None).cast("double")
    lay = registry(spark, ["layer", "source"], [("LA", "s1"), ("LN", "s2"), ("LR", "s3")]).withColumns({
        "nodata": F.when(F.col("layer") == "LN", F.lit(10.0)).otherwise(one),
        "scale": F.when(F.col("layer") == "LA", F.lit(0.5)).otherwise(one)})
    src = registry(spark, ["source", "nodata", "scale"], [("s1", 25.0, 9.0), ("s2", 25.0, 2.0)])
    return D.load_layers(layer_values(spark, sf), lay, src)


@query("load_layers", LOADED + "SELECT layer, year, pixel_id, round(value, 8) AS value FROM ld")
def load_layers(spark, sf):
    return loaded(spark, sf).select("layer", "year", "pixel_id",
                                    F.round("value", 8).alias("value"))


@query("null_gate", LOADED + """SELECT layer, year, count(*) AS n, count(value) AS n_valid,
    count(value) > 0 AS ok FROM ld GROUP BY ALL""")
def null_gate(spark, sf):
    return D.null_gate(loaded(spark, sf))


@query("load_static", """SELECT k AS pixel_id, round(avg(v), 6) AS value FROM (SELECT p_partkey
    AS k, p_retailprice AS v FROM part UNION ALL SELECT l_partkey, avg(l_extendedprice) FROM
    lineitem GROUP BY l_partkey) GROUP BY k""")
def load_static(spark, sf):
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("pixel_id"),
                                        F.col("p_retailprice").alias("value"))
    b = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("pixel_id")).agg(
        F.avg("l_extendedprice").alias("value"))
    return D.load_static([a, b]).select("pixel_id", F.round("value", 6).alias("value"))


@query("load_records", """WITH x(k, intensity, record_class, xwalk_origin) AS (VALUES
    ('1-URGENT', 'Low', 'treatment_LMH', 'published'), ('2-HIGH', 'High', 'treatment_LMH',
    'published'), ('3-MEDIUM', 'Medium', 'treatment_LMH', 'alias_assigned')) SELECT o_custkey
    AS pixel_id, CAST(o_orderkey AS VARCHAR) AS poly_uid, CAST(CASE WHEN year(o_orderdate) = 1995
    THEN 1800 + o_custkey % 100 ELSE year(o_orderdate) END AS INTEGER) AS event_year,
    o_orderpriority AS key_value, intensity, record_class, xwalk_origin FROM orders
    LEFT JOIN x ON k = o_orderpriority WHERE o_orderstatus IN ('F', 'O')""")
def load_records(spark, sf):
    o = table(spark, sf, "orders")
    cols = [F.col("o_custkey").alias("pixel_id"), F.col("o_orderkey").alias("OBJECTID"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("COMPLETED"),
            (1800 + F.col("o_custkey") % 100).alias("plan_year"),
            F.col("o_orderpriority").alias("ACTIVITY"),
            F.when(F.col("o_orderstatus") == "P", "Open").otherwise(" Completed ").alias("state")]
    a = o.where("o_orderstatus = 'F'").select(*cols, F.lit(1).alias("only_here"))
    b = o.where("o_orderstatus <> 'F'").select(*cols)
    return D.load_records([a, b], "activity", "A", _xwalk(spark), "STATE", "Completed",
                          "completed", "1995", "PLAN_YEAR", uid_candidates=["SUID", "objectid"]
                          ).drop("key_value_2", "method_value")
