"""Registration, and the views that stand in for the study's tables.

Each view exists twice, as a DataFrame and as a SQL common table expression,
so an oracle never goes through the code it checks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.numeric import lookup
from panelspark.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def n_if(cond: str) -> str:
    """SQL count of rows meeting a condition, as BIGINT."""
    return f"CAST(coalesce(sum(CASE WHEN {cond} THEN 1 ELSE 0 END), 0) AS BIGINT)"


def isum(expr: str) -> str:
    return f"CAST(sum({expr}) AS BIGINT)"


TOKEN = {"1-URGENT": "F4", "2-HIGH": "F3", "3-MEDIUM": "T2",
         "4-NOT SPECIFIED": "Td", "5-LOW": "Fu"}
RECORD_PRICE = 400_000.0   # orders up to it are records that disturb nothing
FIRST, LAST = 1996, 2000   # treatment years inside the order years 1995-2001


def units(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("pixel_id"), F.col("c_mktsegment").alias("lulc"),
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("zone"),
        F.col("c_acctbal").alias("x1"), "c_nationkey")


def event_log(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("pixel_id"),
        F.year("o_orderdate").alias("event_year"),
        lookup(F.col("o_orderpriority"), TOKEN).alias("token"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("layer"))


def cohorts(spark, sf):
    hit = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
    g = table(spark, sf, "orders").where(hit).groupBy("o_custkey").agg(
        F.min(F.year("o_orderdate")).alias("g"))
    c = table(spark, sf, "customer")
    return c.join(g, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("pixel_id"), F.col("c_mktsegment").alias("lulc"),
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("zone"),
        F.col("c_acctbal").alias("x1"), F.coalesce("g", F.lit(0)).alias("gvar"))


def yearly_value(spark, sf):
    """(pixel_id, year, value): yearly revenue of a customer."""
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("pixel_id"),
        F.year("o_orderdate").alias("year"))
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(rev).alias("r"))
    return o.join(li, o.o_orderkey == li.l_orderkey).groupBy("pixel_id", "year").agg(
        F.sum("r").alias("value"))


def matched_units(spark, sf):
    """Cohort units rank-matched to never units of their segment, long."""
    from panelspark.operators.matching import rank_match

    c = cohorts(spark, sf).withColumn("treat", (F.col("gvar") > 0).cast("int"))
    p = rank_match(c, ["lulc"]).select(
        F.col("treated_id").alias("pair_id"), F.explode(F.array(
            "treated_id", "control_id")).alias("pixel_id"))
    return c.join(p, "pixel_id").withColumn("unit_id", F.col("pixel_id"))


def unit_panel(spark, sf):
    from panelspark.operators.units import build_panel

    # the panel is a stage boundary: written once, then read by its users
    return cut_lineage(build_panel(matched_units(spark, sf), yearly_value(spark, sf),
                                   1995, 2001))


def layer_values(spark, sf):
    """(layer, pixel_id, year, value): mean quantity per part and ship year."""
    return table(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("L"), "l_returnflag").alias("layer"),
        F.col("l_partkey").alias("pixel_id"), F.year("l_shipdate").alias("year")
    ).agg(F.round(F.avg("l_quantity"), 6).alias("value"))


def detections(spark, sf):
    """Returned lines of large quantity: (pixel_id, year, treefrac_loss, agb_loss)."""
    li = table(spark, sf, "lineitem").where(
        (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)).select(
        "l_orderkey", F.year("l_shipdate").alias("year"), "l_discount", "l_tax")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("pixel_id"))
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy("pixel_id", "year").agg(
        F.max("l_discount").alias("treefrac_loss"),
        F.max(F.when(F.col("l_tax") > 0.02, F.col("l_tax"))).alias("agb_loss"))


def part_grid(spark, sf):
    """Parts on a grid 50 cells wide, one group per type."""
    return table(spark, sf, "part").select(
        (F.col("p_partkey") + 1).alias("pixel_id"), F.col("p_type").alias("analysis_group"),
        F.col("p_brand").alias("brand"), F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"))


N_COL = 50


def event_frame(spark, sf):
    """Six arms in the common frame, from orders and customers."""
    from panelspark.operators.events import stack_events
    from panelspark.sources.scans import fit_columns
    from panelspark.sources.schemas import EVENTS

    o = table(spark, sf, "orders")
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    large = F.col("o_totalprice") > RECORD_PRICE
    fire = large & pr.isin("1-URGENT", "2-HIGH")
    dated = F.when(~(large & (st == "O") & (pr == "3-MEDIUM")), F.year("o_orderdate"))
    rec = fit_columns(o.select(
        F.col("o_custkey").alias("pixel_id"),
        F.when(fire, "fire").otherwise("thin").alias("arm"),
        F.concat(F.lit("src_"), st).alias("source_layer"),
        F.col("o_orderkey").cast("string").alias("poly_uid"),
        dated.alias("event_year"),
        F.when(~large, None).when(pr == "1-URGENT", "4").when(pr == "2-HIGH", "3")
        .when(pr == "3-MEDIUM", "Medium").alias("class_value"),
        F.when(~large, "non_disturbing").when(pr == "3-MEDIUM", "treatment_LMH").when(
            pr == "4-NOT SPECIFIED", "disturbance_only").when(
            pr == "5-LOW", "wildfire").alias("record_class")), EVENTS)
    c = table(spark, sf, "customer")
    k, seg, bal = F.col("c_nationkey"), F.col("c_mktsegment"), F.col("c_acctbal")

    def land(arm, label, year, where):
        return fit_columns(c.where(where).select(
            F.col("c_custkey").alias("pixel_id"), F.lit(arm).alias("arm"),
            F.lit(arm).alias("source_layer"), label.alias("class_value"),
            year.cast("int").alias("event_year")), EVENTS)

    null = F.lit(None)
    own = land("own", F.when(k < 2, "Federal").when(k < 4, "Non Profit")
               .when(k < 5, "Tribal").otherwise("Unlisted"), null, k < 6)
    pa = land("pa", F.when(seg == "BUILDING", "State").otherwise("County"),
              F.when(bal >= 0, 1993 + F.pmod(k, F.lit(8))),
              (seg == "BUILDING") | ((seg == "FURNITURE") & (k > 18)))
    tribal = land("tribal", null, null, (seg == "MACHINERY") & (k == 24))
    offset = land("offset", null, 1995 + F.pmod(k, F.lit(7)),
                  (seg == "HOUSEHOLD") & (bal > 8000))
    return stack_events([rec, own, pa, tribal, offset])


CTE = {
    "units": """SELECT c_custkey AS pixel_id, c_mktsegment AS lulc,
        lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS zone, c_acctbal AS x1,
        c_nationkey FROM customer""",
    "event_log": """SELECT o_custkey AS pixel_id,
        CAST(year(o_orderdate) AS INTEGER) AS event_year,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'F4' WHEN '2-HIGH' THEN 'F3'
          WHEN '3-MEDIUM' THEN 'T2' WHEN '4-NOT SPECIFIED' THEN 'Td'
          WHEN '5-LOW' THEN 'Fu' END AS token,
        o_totalprice AS amount, o_orderstatus AS layer FROM orders""",
    "ranked": """SELECT DISTINCT pixel_id, event_year,
        CASE WHEN left(token, 1) = 'F' THEN 2 ELSE 1 END AS arm_id,
        first_value(token) OVER (PARTITION BY pixel_id, event_year, left(token, 1)
          ORDER BY CASE token WHEN 'F4' THEN 1 WHEN 'F3' THEN 2 WHEN 'F2' THEN 3
            WHEN 'Fu' THEN 4 WHEN 'T3' THEN 1 WHEN 'T2' THEN 2 WHEN 'T1' THEN 3
            WHEN 'Tv' THEN 4 WHEN 'Td' THEN 5 ELSE 6 END) AS token
        FROM event_log""",
    "neighbours": """SELECT *, lag(arm_id) OVER w AS pa, lead(arm_id) OVER w AS na,
        event_year - lag(event_year) OVER w AS gp,
        lead(event_year) OVER w - event_year AS gn, lead(token) OVER w AS nt
        FROM ranked WINDOW w AS (PARTITION BY pixel_id ORDER BY event_year, arm_id)""",
    "merged": """SELECT pixel_id, event_year, arm_id, token FROM neighbours
        WHERE NOT (token IN ('Fu', 'Td') AND (
          coalesce(pa = arm_id AND gp <= 1, false)
          OR (coalesce(na = arm_id AND gn <= 1, false)
              AND nt NOT IN ('Fu', 'Td'))))""",
    "cohorts": """SELECT c_custkey AS pixel_id, c_mktsegment AS lulc,
        lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS zone, c_acctbal AS x1,
        CAST(coalesce((SELECT min(year(o_orderdate)) FROM orders
          WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT'
          AND o_orderstatus = 'P'), 0) AS INTEGER) AS gvar FROM customer""",
    "yearly_value": """SELECT o_custkey AS pixel_id,
        CAST(year(o_orderdate) AS INTEGER) AS year,
        sum(l_extendedprice * (1 - l_discount)) AS value
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""",
    "rk": """SELECT *, CAST(gvar > 0 AS INTEGER) AS treat,
        row_number() OVER (PARTITION BY lulc, gvar > 0 ORDER BY pixel_id) AS k
        FROM cohorts""",
    "matched_units": """SELECT a.pixel_id, a.lulc, a.zone, a.x1, a.gvar, a.treat,
        b.pixel_id AS pair_id, a.pixel_id AS unit_id FROM rk a JOIN rk b
        ON a.lulc = b.lulc AND a.k = b.k AND b.treat = 1
        AND EXISTS (SELECT 1 FROM rk c WHERE c.lulc = a.lulc AND c.k = a.k
                    AND c.treat = 0)""",
    "panel": """SELECT u.*, v.year, v.value FROM matched_units u
        JOIN yearly_value v USING (pixel_id)""",
    "layer_values": """SELECT 'L' || l_returnflag AS layer, l_partkey AS pixel_id,
        CAST(year(l_shipdate) AS INTEGER) AS year, round(avg(l_quantity), 6) AS value
        FROM lineitem GROUP BY ALL""",
    "detections": """SELECT o_custkey AS pixel_id,
        CAST(year(l_shipdate) AS INTEGER) AS year, max(l_discount) AS treefrac_loss,
        max(CASE WHEN l_tax > 0.02 THEN l_tax END) AS agb_loss
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY ALL""",
    "grid": """SELECT p_partkey + 1 AS pixel_id, p_type AS analysis_group,
        p_brand AS brand, p_size AS size, p_retailprice AS price,
        p_partkey // 50 AS row, p_partkey % 50 AS col FROM part""",
    "frame": """SELECT o_custkey AS pixel_id,
          CASE WHEN o_totalprice > 400000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')
            THEN 'fire' ELSE 'thin' END AS arm,
          'src_' || o_orderstatus AS source_layer,
          CAST(CASE WHEN o_totalprice > 400000 AND o_orderstatus = 'O'
            AND o_orderpriority = '3-MEDIUM' THEN NULL
            ELSE year(o_orderdate) END AS INTEGER) AS event_year,
          CASE WHEN o_totalprice > 400000 THEN CASE o_orderpriority WHEN '1-URGENT' THEN '4'
            WHEN '2-HIGH' THEN '3' WHEN '3-MEDIUM' THEN 'Medium' END END AS class_value,
          CASE WHEN o_totalprice > 400000 THEN CASE o_orderpriority
            WHEN '3-MEDIUM' THEN 'treatment_LMH' WHEN '4-NOT SPECIFIED' THEN 'disturbance_only'
            WHEN '5-LOW' THEN 'wildfire' END ELSE 'non_disturbing' END AS record_class
        FROM orders
        UNION ALL SELECT c_custkey, 'own', 'own', NULL,
          CASE WHEN c_nationkey < 2 THEN 'Federal' WHEN c_nationkey < 4 THEN 'Non Profit'
            WHEN c_nationkey < 5 THEN 'Tribal' ELSE 'Unlisted' END, NULL
        FROM customer WHERE c_nationkey < 6
        UNION ALL SELECT c_custkey, 'pa', 'pa',
          CASE WHEN c_acctbal >= 0 THEN 1993 + c_nationkey % 8 END,
          CASE WHEN c_mktsegment = 'BUILDING' THEN 'State' ELSE 'County' END, NULL
        FROM customer WHERE c_mktsegment = 'BUILDING'
          OR (c_mktsegment = 'FURNITURE' AND c_nationkey > 18)
        UNION ALL SELECT c_custkey, 'tribal', 'tribal', NULL, NULL, NULL
        FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey = 24
        UNION ALL SELECT c_custkey, 'offset', 'offset', 1995 + c_nationkey % 7, NULL, NULL
        FROM customer WHERE c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 8000""",
    # classification of the frame, step by step
    "k_log": """SELECT pixel_id, event_year, CASE
          WHEN arm = 'fire' AND class_value = '4' THEN 'F4'
          WHEN arm = 'fire' AND class_value = '3' THEN 'F3'
          WHEN record_class = 'treatment_LMH' THEN 'T2'
          WHEN record_class = 'disturbance_only' THEN 'Td'
          WHEN record_class = 'wildfire' THEN 'Fu'
          WHEN record_class = 'non_disturbing' THEN 'Tn' END AS token
        FROM frame WHERE arm IN ('fire', 'thin') AND event_year IS NOT NULL""",
    "k_entry": """SELECT pixel_id, event_year, left(token, 1) AS arm, arg_min(token,
          CASE token WHEN 'F4' THEN 1 WHEN 'F3' THEN 2 WHEN 'Fu' THEN 4
            WHEN 'T2' THEN 2 WHEN 'Td' THEN 5 WHEN 'Tn' THEN 6 END) AS token
        FROM k_log GROUP BY ALL""",
    "k_near": """SELECT *, lag(arm) OVER w AS pa, lead(arm) OVER w AS na,
          event_year - lag(event_year) OVER w AS gp,
          lead(event_year) OVER w - event_year AS gn, lead(token) OVER w AS nt
        FROM k_entry WINDOW w AS (PARTITION BY pixel_id
          ORDER BY event_year, arm DESC)""",
    "k_kept": """SELECT * FROM k_near WHERE NOT (token IN ('Fu', 'Td') AND (
          coalesce(pa = arm AND gp <= 1, false) OR coalesce(
            na = arm AND gn <= 1 AND nt NOT IN ('Fu', 'Td'), false)))""",
    "k_hist": """SELECT pixel_id,
          string_agg(token, '' ORDER BY event_year, arm DESC) AS event_chain,
          count(*) AS n_events,
          count(*) FILTER (event_year <= 2000 AND token <> 'Tn') AS n_effective,
          min(token) FILTER (event_year <= 2000 AND token <> 'Tn') AS tok,
          min(event_year) FILTER (event_year <= 2000 AND token <> 'Tn') AS yr
        FROM k_kept GROUP BY pixel_id""",
    "k_land": """SELECT pixel_id, max(CASE
          WHEN arm = 'tribal' OR (arm = 'own' AND class_value = 'Tribal') THEN 7
          WHEN arm = 'pa' AND class_value = 'State' THEN 6
          WHEN arm = 'pa' THEN 5 WHEN class_value = 'Federal' THEN 4
          WHEN class_value = 'Non Profit' THEN 3 ELSE 2 END) AS s,
          min(event_year) FILTER (arm = 'pa' AND class_value = 'State') AS est,
          max(CASE WHEN arm = 'pa' AND class_value = 'State' AND event_year IS NULL
            THEN 1 ELSE 0 END) AS und
        FROM frame WHERE arm IN ('own', 'pa', 'tribal') GROUP BY pixel_id""",
    "k_cell": """SELECT u.pixel_id, u.lulc, coalesce(h.event_chain, 'U') AS chain,
          coalesce(h.n_effective, 0) AS ne,
          CASE WHEN h.n_effective = 1 THEN h.tok END AS tok,
          CASE WHEN h.n_effective = 1 THEN h.yr END AS yr,
          CASE coalesce(l.s, 1) WHEN 7 THEN 'TR' WHEN 6 THEN 'P' WHEN 5 THEN 'PO'
            WHEN 4 THEN 'PUB' WHEN 3 THEN 'NGO' WHEN 2 THEN 'UN' ELSE 'NP' END AS status,
          l.est, coalesce(l.und = 1 AND l.est IS NULL, false) AS pa_undated,
          EXISTS (SELECT 1 FROM frame f WHERE f.pixel_id = u.pixel_id AND f.arm = 'thin'
            AND f.event_year IS NULL) AS undated,
          (SELECT min(event_year) FROM frame f WHERE f.pixel_id = u.pixel_id
            AND f.arm = 'offset') AS off,
          (SELECT count(*) FROM detections d WHERE d.pixel_id = u.pixel_id) AS nd,
          EXISTS (SELECT 1 FROM detections d WHERE d.pixel_id = u.pixel_id
            AND h.n_effective = 1 AND abs(d.year - h.yr) <= 1) AS det
        FROM units u LEFT JOIN k_hist h USING (pixel_id)
        LEFT JOIN k_land l USING (pixel_id)""",
    "k_rule": """SELECT *, CASE WHEN status = 'TR' THEN 'tribal'
          WHEN pa_undated THEN 'pa_undated'
          WHEN status NOT IN ('P', 'NP') THEN 'status_not_analysed'
          WHEN undated THEN 'undated_thin_record'
          WHEN ne > 1 THEN 'multi_event'
          WHEN ne = 1 AND tok NOT IN ('T2', 'F3', 'F4') THEN 'unclassifiable_event'
          WHEN ne = 1 AND yr < 1996 THEN 'pre_window_event'
          WHEN status = 'P' AND ne = 1 AND yr BETWEEN 1996 AND 2000 AND est > yr
            THEN 'pa_after_cohort'
          WHEN off IS NOT NULL AND ne = 1 THEN 'offset_event_conflict'
          WHEN off < 1996 OR off > 2000 THEN 'offset_out_of_window'
          WHEN ne = 1 AND NOT det THEN 'no_detection_at_event'
          WHEN ne = 0 AND nd > 0 THEN 'screen_detection' END AS rule FROM k_cell""",
    "k_group": """SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
          WHEN ne = 1 THEN tok || status WHEN off IS NOT NULL THEN 'O' || status
          ELSE 'U' || status END AS grp,
          CASE WHEN (rule IS NULL OR rule = 'no_detection_at_event') AND ne = 1
            THEN tok || status END AS cand FROM k_rule""",
}
NEEDS = {
    "ranked": ["event_log"], "neighbours": ["ranked"], "merged": ["neighbours"],
    "rk": ["cohorts"], "matched_units": ["rk"], "panel": ["matched_units", "yearly_value"],
    "k_log": ["frame"], "k_entry": ["k_log"], "k_near": ["k_entry"],
    "k_kept": ["k_near"], "k_hist": ["k_kept"], "k_land": ["frame"],
    "k_cell": ["units", "k_hist", "k_land", "detections"], "k_rule": ["k_cell"],
    "k_group": ["k_rule"],
}


def with_(*names: str, **extra: str) -> str:
    """WITH clause of the named views and what they need, then ``extra``."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in NEEDS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS MATERIALIZED ({CTE[n]})" for n in order]
    parts += [f"{n} AS MATERIALIZED ({s})" for n, s in extra.items()]
    return "WITH " + ", ".join(parts) + " "
