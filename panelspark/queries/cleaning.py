"""Scans, cleaning rules, scalar surface, completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import profile as P
from panelspark.functions import numeric as N
from panelspark.functions import text as X
from panelspark.operators import cleaning as C
from panelspark.operators import ledger as L
from panelspark.queries.base import (isum, layer_values, n_if, query, table, units, with_)
from panelspark.sources import scans as S
from panelspark.sources import sinks as W

# the given layers carry these rules in the queries: name -> (factor, carbon, unit)
UNITS = {"LA": (100.0, True, "a"), "LN": (0.1, True, "b"), "LR": (1.0, False, "c")}
SENT = {"LR": 25.0, "LN": 10.0}
RULES = [("LR", "clip_upper", 45.0), ("LR", "clip_lower", 5.0), ("LA", "clip_lower", 300.0),
         ("LN", "mask_by_reference", None)]
SENT_SQL = """(CASE layer WHEN 'LR' THEN abs(value - 25) <= 25e-6 + 1e-9
    WHEN 'LN' THEN abs(value - 10) <= 10e-6 + 1e-9 ELSE false END)"""
UNIT_SQL = "CASE layer WHEN 'LA' THEN 100.0::DOUBLE * 0.47 WHEN 'LN' THEN 0.1::DOUBLE * 0.47 ELSE 1.0 END"


def reference(spark, sf):
    """Layer LA stands for the reference the masking rule looks at."""
    return layer_values(spark, sf).where(F.col("layer") == "LA").select(
        "pixel_id", "year", F.col("value").alias("ref_value"))


@query("unit_convert", with_("layer_values") + f"""SELECT layer, pixel_id, year,
    round(value * ({UNIT_SQL}), 6) AS value FROM layer_values""")
def unit_convert(spark, sf):
    return layer_values(spark, sf).withColumn("value", F.round(C.convert_units(
        F.col("value"), F.col("layer"), UNITS, P.CARBON_FRACTION), 6))


@query("sentinel_mask", with_("layer_values") + f"""SELECT layer, count(*) AS n,
    {n_if(SENT_SQL)} AS n_sentinel FROM layer_values GROUP BY layer""")
def sentinel_mask(spark, sf):
    hit = C.sentinel_hit(F.col("value"), F.col("layer"), SENT)
    return layer_values(spark, sf).groupBy("layer").agg(
        F.count(F.lit(1)).alias("n"), F.sum(hit.cast("long")).alias("n_sentinel"))


CLEAN = with_("layer_values", conv=f"""SELECT layer, pixel_id, year, {SENT_SQL} AS s,
      CASE WHEN {SENT_SQL} THEN NULL ELSE value * ({UNIT_SQL}) END AS v,
      EXISTS (SELECT 1 FROM layer_values r WHERE r.layer = 'LA'
        AND r.pixel_id = l.pixel_id AND r.year = l.year) AS has_ref FROM layer_values l""")


@query("clean_layer", CLEAN + """SELECT layer, pixel_id, year, round(CASE
    WHEN layer = 'LR' THEN greatest(least(v, CASE WHEN v IS NOT NULL THEN 45.0::DOUBLE END),
      CASE WHEN v IS NOT NULL THEN 5.0::DOUBLE END)
    WHEN layer = 'LA' AND v < 300 THEN 300
    WHEN layer = 'LN' AND NOT has_ref THEN NULL ELSE v END, 6) AS value FROM conv""")
def clean_layer(spark, sf):
    return C.clean_layer(layer_values(spark, sf), UNITS, P.CARBON_FRACTION, SENT, RULES,
                         reference(spark, sf)).select(
        "layer", "pixel_id", "year", F.round("value", 6).alias("value"))


@query("rule_effects", CLEAN + ", c AS (SELECT layer, year, count(*) AS n, "
    + ", ".join(f"{n_if(c)} AS \"{k}\"" for k, c in {
        "sentinel": "s", "LR:clip_upper": "layer = 'LR' AND v > 45",
        "LR:clip_lower": "layer = 'LR' AND v < 5",
        "LA:clip_lower": "layer = 'LA' AND v < 300",
        "LN:mask_by_reference": "layer = 'LN' AND v IS NOT NULL AND NOT has_ref"}.items())
    + """ FROM conv GROUP BY ALL) UNPIVOT c ON COLUMNS(* EXCLUDE (layer, year, n))
    INTO NAME rule VALUE n_affected""")
def rule_effects(spark, sf):
    return C.rule_effects(layer_values(spark, sf), UNITS, P.CARBON_FRACTION, SENT, RULES,
                          reference(spark, sf))


@query("category_read", with_("layer_values") + """SELECT layer,
    CAST(round(value / 10) AS INTEGER) AS class, count(*) AS n FROM layer_values GROUP BY ALL""")
def category_read(spark, sf):
    return layer_values(spark, sf).groupBy("layer", C.read_category(
        F.col("value") / 10).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("bearing", """SELECT p_partkey,
    CASE WHEN a = -1 THEN 0 ELSE round(cos(radians(a)), 9) END AS northness,
    CASE WHEN a = -1 THEN 0 ELSE round(sin(radians(a)), 9) END AS eastness
    FROM (SELECT p_partkey, CASE WHEN p_size = 1 THEN -1.0::DOUBLE
      ELSE p_size * 7.0::DOUBLE END AS a FROM part)""")
def bearing(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(
        F.col("p_size") == 1, -1.0).otherwise(F.col("p_size") * 7.0).alias("aspect"))
    return C.add_bearing(p).select("p_partkey", F.round("northness", 9).alias("northness"),
                                   F.round("eastness", 9).alias("eastness"))


@query("normalise_key", r"""SELECT p_partkey, trim(regexp_replace(upper(p_name || ' -- '
    || p_type || '/'), '[^A-Z0-9]+', ' ', 'g')) AS key,
    CASE WHEN p_size % 7 = 0 THEN '<MISSING>' ELSE upper(p_brand[1:5]) END AS key_or_missing
    FROM part""")
def normalise_key(spark, sf):
    p = table(spark, sf, "part")
    raw = F.concat(F.col("p_name"), F.lit(" -- "), F.col("p_type"), F.lit("/"))
    blank = F.when(F.col("p_size") % 7 == 0, F.when(F.col("p_size") % 2 == 0, "  "))
    return p.select("p_partkey", X.normalise_key(raw).alias("key"), X.normalise_or_missing(
        F.when(F.col("p_size") % 7 == 0, blank).otherwise(F.substring("p_brand", 1, 5)))
        .alias("key_or_missing"))


@query("status_filter", """SELECT o_orderpriority, count(*) AS n FROM orders
    WHERE o_orderstatus = 'F' GROUP BY ALL""")
def status_filter(spark, sf):
    st = F.trim(F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")))
    return table(spark, sf, "orders").where(st == "F").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"))


@query("event_year_resolution", """SELECT y AS event_year, count(*) AS n FROM (SELECT
    CAST(CASE WHEN o_orderstatus <> 'F' AND year(o_orderdate) <> 1995 THEN year(o_orderdate)
      WHEN o_orderstatus = 'P' THEN NULL ELSE 1790 + o_custkey % 400 END AS INTEGER) AS y0,
    CASE WHEN o_orderstatus <> 'F' AND year(o_orderdate) <> 1995 THEN y0
      WHEN y0 BETWEEN 1800 AND 2100 THEN y0 END AS y FROM orders) GROUP BY y""")
def event_year_resolution(spark, sf):
    o = table(spark, sf, "orders")
    date = F.when(F.col("o_orderstatus") == "F", "not a date").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd"))
    plan = F.when(F.col("o_orderstatus") != "P",
                  (1790 + F.col("o_custkey") % 400).cast("string"))
    y = X.resolve_event_year(date, plan, placeholder="1995")
    return o.groupBy(y.alias("event_year")).agg(F.count(F.lit(1)).alias("n"))


@query("digits_year", """SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n
    FROM orders GROUP BY ALL""")
def digits_year(spark, sf):
    raw = F.date_format("o_orderdate", "yyyy/MM-dd'T'")
    return table(spark, sf, "orders").groupBy(X.digits_year(raw).alias("y")).agg(
        F.count(F.lit(1)).alias("n"))


@query("outcome_transform", """SELECT c_custkey, round(CASE WHEN c_acctbal >= 0
    THEN ln(1 + c_acctbal) ELSE c_acctbal END, 6) AS y,
    round(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, 4) AS back FROM customer""")
def outcome_transform(spark, sf):
    c = table(spark, sf, "customer")
    tf = F.when(F.col("c_acctbal") >= 0, "log1p").otherwise("none")
    y = N.outcome_transform(F.col("c_acctbal"), tf)
    return c.select("c_custkey", F.round(y, 6).alias("y"),
                    F.round(N.back_transform(y, tf), 4).alias("back"))


@query("run_ids", r"""SELECT DISTINCT 'P-gpp-log1p-' || trim(regexp_replace(o_orderpriority,
    '[^A-Za-z0-9]+', '_', 'g'), '_') || '-' || CASE WHEN o_orderstatus = 'F' THEN 'statewide'
    ELSE 'eco' || o_orderstatus END AS run_id FROM orders""")
def run_ids(spark, sf):
    o = table(spark, sf, "orders")
    zone = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))
    return o.select(X.run_id(F.lit("P"), F.lit("gpp"), F.lit("log1p"),
                             F.col("o_orderpriority"), zone).alias("run_id")).distinct()


@query("zone_codes_derived", """SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS code_2,
    left('1802000' || c_nationkey || 'X', 8) AS code_8, count(*) AS n FROM customer GROUP BY ALL""")
def zone_codes_derived(spark, sf):
    k = F.col("c_nationkey")
    long = F.concat(F.lit(" 1802000"), k.cast("string"), F.lit("X"))
    return table(spark, sf, "customer").groupBy(
        X.pad_code(k.cast("double"), 2).alias("code_2"),
        X.code_prefix(long, 8).alias("code_8")).agg(F.count(F.lit(1)).alias("n"))


@query("complete_cases", """SELECT p_brand, count(*) AS n_rows,
    CAST(sum(CASE WHEN p_size > 5 AND p_retailprice > 950 THEN 1 ELSE 0 END) AS BIGINT)
      AS n_complete,
    CAST(sum(CASE WHEN p_size <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS missing_size,
    CAST(sum(CASE WHEN p_retailprice <= 950 THEN 1 ELSE 0 END) AS BIGINT) AS missing_price
    FROM part GROUP BY p_brand""")
def complete_cases(spark, sf):
    p = table(spark, sf, "part").select(
        "p_brand", F.when(F.col("p_size") > 5, F.col("p_size")).alias("size"),
        F.when(F.col("p_retailprice") > 950, F.col("p_retailprice")).alias("price"))
    return C.complete_case_loss(p, ["size", "price"], ["p_brand"])


@query("covariate_table", """SELECT c_custkey AS pixel_id, c_mktsegment AS lulc,
    n.cnt AS n_orders, round(n.mx, 4) AS max_price, round(c_acctbal, 4) AS balance,
    lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS zone FROM customer
    LEFT JOIN (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS cnt, max(o_totalprice) AS mx
      FROM orders GROUP BY o_custkey) n ON o_custkey = c_custkey""")
def covariate_table(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("pixel_id")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("mx"))
    u = units(spark, sf)
    t = C.covariate_table(
        u.select("pixel_id", "lulc"),
        {"n_orders": o.select("pixel_id", F.col("n").alias("value")),
         "max_price": o.select("pixel_id", F.col("mx").alias("value")),
         "balance": u.select("pixel_id", F.col("x1").alias("value"))},
        {"zone": u.select("pixel_id", F.col("zone").alias("value"))}, {"zone": 2},
        {"n_orders": (1, 1e9), "balance": (-1e5, 1e5)})
    return t.select("pixel_id", "lulc", "n_orders", F.round("max_price", 4).alias("max_price"),
                    F.round("balance", 4).alias("balance"), "zone")


# -- scans ------------------------------------------------------------------------

@query("column_scan", "SELECT p_partkey, p_size FROM part")
def column_scan(spark, sf):
    return S.read_columns(spark, f"{sf}/part.parquet", ["p_partkey", "p_size"])


@query("id_scan", """SELECT l_partkey, count(*) AS n, round(sum(l_quantity), 2) AS q
    FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')
    GROUP BY l_partkey""")
def id_scan(spark, sf):
    ids = table(spark, sf, "part").where(F.col("p_type") == "PROMO").select(
        F.col("p_partkey").alias("l_partkey"))
    d = S.read_for_ids(table(spark, sf, "lineitem"), ids, "l_partkey", ["l_quantity"])
    return d.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"),
                                      F.round(F.sum("l_quantity"), 2).alias("q"))


@query("stacked_files", """SELECT kind, count(*) AS n, count(size) AS n_size,
    count(balance) AS n_balance FROM (SELECT 'part' AS kind, p_size AS size, NULL AS balance
    FROM part UNION ALL SELECT 'supplier', NULL, s_acctbal FROM supplier) GROUP BY kind""")
def stacked_files(spark, sf):
    a = table(spark, sf, "part").select(F.lit("part").alias("kind"),
                                        F.col("p_size").alias("size"))
    b = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"),
                                            F.col("s_acctbal").alias("balance"))
    d = S.stack_files([a, b], "kind STRING, size INT, balance DOUBLE, absent STRING")
    return d.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("size").alias("n_size"),
                                 F.count("balance").alias("n_balance"))


@query("stacked_common", """SELECT key, sum(nationkey) AS nk FROM (SELECT 'c' AS key,
    CAST(c_nationkey AS BIGINT) AS nationkey FROM customer UNION ALL
    SELECT 's', CAST(s_nationkey AS BIGINT) FROM supplier) GROUP BY key"""
    .replace("sum(nationkey)", isum("nationkey")))
def stacked_common(spark, sf):
    a = table(spark, sf, "customer").select(F.lit("c").alias("key"), F.col(
        "c_nationkey").alias("nationkey"), "c_mktsegment")
    b = table(spark, sf, "supplier").select(F.lit("s").alias("key"), F.col(
        "s_nationkey").alias("nationkey"), "s_name")
    return S.stack_common([a, b]).groupBy("key").agg(F.sum("nationkey").alias("nk"))


@query("layer_completeness", with_("layer_values", e="""SELECT layer, y AS year FROM
    (SELECT unnest(['LA', 'LN', 'LR', 'LX']) AS layer) a, (SELECT unnest(range(1994, 2003))
    AS y) b""") + """SELECT layer, CAST(year AS INTEGER) AS year, EXISTS (SELECT 1 FROM
    layer_values v WHERE v.layer = e.layer AND v.year = e.year) AS present FROM e""")
def layer_completeness(spark, sf):
    from panelspark.operators.core import registry

    reg = registry(spark, ["layer", "store", "first_year", "last_year", "active"], [
        (n, "s", 1994, 2002, True) for n in ("LA", "LN", "LR", "LX")]).withColumns({
            "first_year": F.col("first_year").cast("int"),
            "last_year": F.col("last_year").cast("int")})
    exp = S.layer_years(reg).drop("store")
    return S.completeness(exp, layer_values(spark, sf), ["layer", "year"])


@query("layer_class_grid", """SELECT l AS layer, CAST(y AS INTEGER) AS year, c_mktsegment
    AS lulc FROM (SELECT unnest(['LA', 'LN']) AS l) a, (SELECT unnest(range(1995, 2002)) AS y) b,
    (SELECT DISTINCT c_mktsegment FROM customer) c""")
def layer_class_grid(spark, sf):
    from panelspark.operators.core import registry

    reg = registry(spark, ["layer", "store", "first_year", "last_year", "active"], [
        (n, "s", 1995, 2001, True) for n in ("LA", "LN")]).withColumns({
            "first_year": F.col("first_year").cast("int"),
            "last_year": F.col("last_year").cast("int")})
    classes = units(spark, sf).select("lulc")
    return S.expected_keys(S.layer_years(reg).drop("store"), classes)


@query("registry_check", """SELECT 'L' || l_returnflag AS layer, count(DISTINCT l_linestatus)
    AS n_entries FROM lineitem GROUP BY ALL""")
def registry_check(spark, sf):
    li = table(spark, sf, "lineitem")
    parts = {s: li.where(F.col("l_linestatus") == s).select(
        F.concat(F.lit("L"), "l_returnflag").alias("layer")).distinct() for s in ("F", "O")}
    return S.layer_name_counts(parts).select("layer", "n_entries").distinct()


@query("layer_registry", """SELECT DISTINCT 'L' || l_returnflag || l_linestatus AS layer,
    l_linestatus AS store FROM lineitem""")
def layer_registry(spark, sf):
    """Names made unique by their store pass the gate."""
    li = table(spark, sf, "lineitem")
    parts = {s: li.where(F.col("l_linestatus") == s).select(F.concat(
        F.lit("L"), "l_returnflag", "l_linestatus").alias("layer")).distinct() for s in ("F", "O")}
    return S.layer_registry(parts).select("layer", "store")


@query("year_index", """SELECT CAST(y AS INTEGER) AS year, count(o_orderkey) AS n_files,
    CASE WHEN count(o_orderkey) = 0 THEN 'gap' WHEN count(o_orderkey) > 1 THEN 'duplicate'
    ELSE 'ok' END AS state FROM (SELECT unnest(range(1993, 2004)) AS y) LEFT JOIN orders
    ON year(o_orderdate) = y GROUP BY y""")
def year_index(spark, sf):
    path = F.concat(F.lit("/layers/agb_7_"), F.year("o_orderdate").cast("string"),
                    F.lit("_v0030.tif"))
    files = table(spark, sf, "orders").select(path.alias("path")).withColumn(
        "year", X.year_from_path(F.col("path"), 1993, 2003))
    return S.layer_index(files, 1993, 2003).drop("path")


@query("keyed_merge", """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size + 100 ELSE p_size
    END AS size FROM part UNION ALL SELECT p_partkey + 1000000, p_size + 100 FROM part
    WHERE p_size > 45""")
def keyed_merge(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("size"))
    up = p.where(F.col("size") > 25).withColumn("size", F.col("size") + 100)
    new = p.where(F.col("size") > 45).select(
        (F.col("p_partkey") + 1000000).alias("p_partkey"), F.col("size") + 100)
    return W.merge_by_key(p, up.union(new), ["p_partkey"])


@query("keep_last", """SELECT o_custkey, o_orderpriority, max(o_orderkey) AS o_orderkey,
    arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY ALL""")
def keep_last(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey",
                                          "o_totalprice")
    o = o.withColumn("seq", F.col("o_orderkey"))
    return W.keep_last(o, ["o_custkey", "o_orderpriority"], "seq").drop("seq")


@query("top_k", """SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number()
    OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3""")
def top_k(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return W.top_k(c, ["c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3)


@query("ordinal_sort", """SELECT o_orderpriority, o_orderstatus, count(*) AS n, row_number()
    OVER (ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 END
      NULLS LAST, o_orderpriority, o_orderstatus DESC) AS pos FROM orders GROUP BY 1, 2"""
    .replace("AS pos", "AS pos"))
def ordinal_sort(spark, sf):
    from pyspark.sql import Window

    n = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"))
    rank = N.lookup(F.col("o_orderpriority"), {"3-MEDIUM": 1, "1-URGENT": 2})
    w = Window.orderBy(rank.asc_nulls_last(), "o_orderpriority",
                       F.col("o_orderstatus").desc())  # 15 rows
    return n.withColumn("pos", F.row_number().over(w).cast("long"))


@query("crosstab_nulls", """SELECT CASE WHEN p_size > 10 THEN p_brand END AS brand, p_type,
    count(*) AS n FROM part GROUP BY ALL""")
def crosstab_nulls(spark, sf):
    p = table(spark, sf, "part").withColumn("brand", F.when(F.col("p_size") > 10,
                                                            F.col("p_brand")))
    return L.crosstab(p, ["brand", "p_type"])


@query("read_estimates", """SELECT estimator, time_type, count(*) AS n, count(time) AS n_time,
    round(CAST(sum(time) AS DOUBLE), 4) AS sum_time, round(sum(estimate), 2) AS sum_est FROM (
    SELECT 'attgt' AS estimator, CASE WHEN o_orderstatus = 'P' THEN 'overall'
      WHEN o_orderpriority = '1-URGENT' THEN 'cohort' WHEN o_orderpriority = '2-HIGH'
      THEN 'event' WHEN o_orderpriority = '3-MEDIUM' THEN 'calendar' END AS time_type,
      CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS time, o_totalprice AS estimate
    FROM orders UNION ALL SELECT 'etwfe', CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN
      'event' WHEN '5-LOW' THEN 'overall' WHEN '3-MEDIUM' THEN 'calendar' END,
      CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN o_custkey WHEN '3-MEDIUM' THEN
      year(o_orderdate) END, o_totalprice FROM orders) GROUP BY ALL""")
def read_estimates(spark, sf):
    o = table(spark, sf, "orders")
    agg = N.lookup(F.col("o_orderpriority"), {
        "1-URGENT": "group", "2-HIGH": "dynamic", "3-MEDIUM": "calendar",
        "4-NOT SPECIFIED": "event", "5-LOW": "simple"})
    common = [agg.alias("aggregation"), F.col("o_totalprice").cast("string").alias("estimate")]
    a = o.select(*common, F.when(F.col("o_orderstatus") == "P", "overall").otherwise("x")
                 .alias("term"), F.col("o_custkey").cast("string").alias("egt"))
    b = o.select(*common, F.year("o_orderdate").cast("string").alias("year"),
                 F.col("o_custkey").cast("string").alias("event"))
    d = S.read_estimates(a, "attgt").unionByName(S.read_estimates(b, "etwfe"))
    return d.groupBy("estimator", "time_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("time").alias("n_time"),
        F.round(F.sum("time"), 4).alias("sum_time"),
        F.round(F.sum("estimate"), 2).alias("sum_est"))


@query("edited_windows", """SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS ecoregion,
    n_regionkey AS cap_use, 'edited' AS copy FROM nation UNION ALL
    SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), n_nationkey, 'auto' FROM nation""")
def edited_windows(spark, sf):
    code = F.col("n_nationkey").cast("string").alias("ecoregion")
    n = table(spark, sf, "nation")
    auto = n.select(code, F.col("n_nationkey").alias("cap_use"), F.lit("auto").alias("copy"))
    edited = n.select(code, F.col("n_regionkey").alias("cap_use"), F.lit("edited").alias("copy"))
    return S.read_windows(auto, edited).unionByName(S.read_windows(auto, None))


@query("named_threshold", """SELECT max(c_acctbal) AS value FROM customer
    WHERE c_mktsegment = 'MACHINERY'""")
def named_threshold(spark, sf):
    t = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(
        F.max("c_acctbal").alias("value"))
    return S.named_value(t, "MACHINERY")
