"""Event histories, exclusion ledger and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark import profile as P
from panelspark.operators import events as E
from panelspark.operators import ledger as L
from panelspark.plans.classify import classify_cells
from panelspark.queries.base import (FIRST, LAST, detections, event_frame, event_log,
                                     isum, n_if, query, units, with_)


def entries(spark, sf):
    return E.collapse_entries(event_log(spark, sf))


def merged(spark, sf):
    return E.merge_adjacent(entries(spark, sf))


def groups(spark, sf):
    return classify_cells(units(spark, sf), event_frame(spark, sf),
                          detections(spark, sf), FIRST, LAST)


query("event_collapse", with_("ranked") + "SELECT * FROM ranked")(entries)
query("adjacent_merge", with_("merged") + "SELECT * FROM merged")(merged)


@query("gap_histogram", with_("ranked", g="""SELECT arm_id, arm_id = lag(arm_id) OVER w
    AS same, least(event_year - lag(event_year) OVER w, 6) AS gap FROM ranked
    WINDOW w AS (PARTITION BY pixel_id ORDER BY event_year, arm_id)""")
    + "SELECT arm_id, gap, count(*) AS n FROM g WHERE same GROUP BY ALL")
def gap_histogram(spark, sf):
    return E.gap_histogram(entries(spark, sf))


@query("event_chain", with_("merged") + """SELECT pixel_id,
    string_agg(token, '' ORDER BY event_year, arm_id) AS event_chain
    FROM merged GROUP BY pixel_id""")
def event_chain(spark, sf):
    return E.event_chain(merged(spark, sf))


@query("event_profile", with_("merged", p=f"""SELECT pixel_id,
    string_agg(token, '' ORDER BY event_year, arm_id) AS event_chain,
    min(event_year) AS first_event_year, max(event_year) AS last_event_year,
    count(*) AS n_events, {n_if("token LIKE 'T%'")} AS n_thin,
    {n_if("token LIKE 'F%'")} AS n_fire,
    {n_if("event_year <= 2000")} AS n_effective,
    min(token) FILTER (event_year <= 2000) AS t,
    min(event_year) FILTER (event_year <= 2000) AS y FROM merged GROUP BY pixel_id""")
    + """SELECT * EXCLUDE (t, y), CASE WHEN n_effective = 1 THEN t END AS sole_token,
    CASE WHEN n_effective = 1 THEN y END AS sole_year FROM p""")
def event_profile(spark, sf):
    return E.event_profile(merged(spark, sf), LAST)


@query("first_last_event", with_("event_log") + """SELECT pixel_id, min(event_year)
    AS first_year, arg_min(amount, (event_year, amount)) AS first_amount,
    max(event_year) AS last_year, arg_max(amount, (event_year, amount)) AS last_amount
    FROM event_log GROUP BY pixel_id""")
def first_last_event(spark, sf):
    from panelspark.sources.sinks import first_per_key, keep_last

    e = event_log(spark, sf).select("pixel_id", "event_year", "amount")
    a = first_per_key(e, ["pixel_id"], ["event_year", "amount"]).toDF(
        "pixel_id", "first_year", "first_amount")
    e = e.withColumn("seq", F.struct("event_year", "amount"))
    b = keep_last(e, ["pixel_id"], "seq").drop("seq").toDF(
        "pixel_id", "last_year", "last_amount")
    return a.join(b, "pixel_id")


@query("event_frame_counts", with_("frame") + """SELECT arm, source_layer, class_value,
    record_class, count(*) AS n, count(DISTINCT pixel_id) AS n_pixels,
    count(event_year) AS n_dated FROM frame GROUP BY ALL""")
def event_frame_counts(spark, sf):
    return event_frame(spark, sf).groupBy(
        "arm", "source_layer", "class_value", "record_class").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("pixel_id").alias("n_pixels"),
        F.count("event_year").alias("n_dated"))


@query("category_events", with_("layer_values") + """SELECT pixel_id, year AS event_year,
    CAST(CAST(round(value) AS INTEGER) AS VARCHAR) AS class_value, 'fire' AS arm
    FROM layer_values WHERE layer = 'LR' AND round(value) <> 6""")
def category_events(spark, sf):
    from panelspark.queries.base import layer_values

    lay = layer_values(spark, sf).where(F.col("layer") == "LR")
    return E.category_events(lay, "fire", "LR", P.SEVERITY_NODATA).select(
        "pixel_id", "event_year", "class_value", "arm")


@query("project_events", with_("units") + """SELECT o_custkey AS pixel_id,
    upper(trim(' ' || lower(n_name) || ' ')) AS class_value,
    CAST(1994 + n_regionkey AS INTEGER) AS event_year,
    CAST(2000 + n_regionkey AS INTEGER) AS aux_year, count(*) AS n
    FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def project_events(spark, sf):
    from panelspark.queries.base import table

    n = table(spark, sf, "nation")
    rec = (table(spark, sf, "orders")
           .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
           .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
           .select(F.col("o_custkey").alias("pixel_id"),
                   F.lit(None).cast("int").alias("event_year"),
                   F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("key_value")))
    proj = n.select("n_name", (1994 + F.col("n_regionkey")).alias("start_year"),
                    (2000 + F.col("n_regionkey")).alias("last_year"))
    ev = E.project_events(rec, proj, "n_name", "start_year", "last_year")
    return ev.groupBy("pixel_id", "class_value", "event_year", "aux_year").agg(
        F.count(F.lit(1)).alias("n"))


@query("token_assignment", with_("frame") + f"""SELECT arm, CASE
    WHEN arm = 'fire' AND class_value = '4' THEN 'F4' WHEN arm = 'fire' THEN 'F3'
    WHEN record_class = 'treatment_LMH' THEN 'T2'
    WHEN record_class = 'disturbance_only' THEN 'Td'
    WHEN record_class = 'non_disturbing' THEN 'Tn' ELSE 'Fu' END AS token,
    count(*) AS n, {n_if("event_year IS NULL")} AS n_undated
    FROM frame WHERE arm IN ('fire', 'thin') GROUP BY ALL""")
def token_assignment(spark, sf):
    f = event_frame(spark, sf).where(F.col("arm").isin("fire", "thin"))
    tok = F.when(F.col("arm") == "fire", E.fire_token(F.col("class_value"))).otherwise(
        E.thin_token(F.col("record_class"), F.col("class_value"), F.col("key_value")))
    return f.groupBy("arm", tok.alias("token")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("event_year").isNull().cast("long")).alias("n_undated"))


@query("undated_flags", with_("frame") + """SELECT pixel_id, count(*) AS n_undated
    FROM frame WHERE arm = 'thin' AND event_year IS NULL GROUP BY pixel_id""")
def undated_flags(spark, sf):
    return E.undated_flags(event_frame(spark, sf).where(F.col("arm") == "thin"))


@query("status_precedence", with_("k_land", "frame") + """SELECT pixel_id, CASE s
    WHEN 7 THEN 'TR' WHEN 6 THEN 'P' WHEN 5 THEN 'PO' WHEN 4 THEN 'PUB'
    WHEN 3 THEN 'NGO' ELSE 'UN' END AS status_code, est AS pa_est_year,
    und = 1 AND est IS NULL AS pa_undated FROM k_land""")
def status_precedence(spark, sf):
    f = event_frame(spark, sf)
    return E.land_status(*[f.where(F.col("arm") == a) for a in ("own", "pa", "tribal")])


@query("undeclared_labels", with_("frame") + """SELECT class_value, count(*) AS n_records
    FROM frame WHERE arm = 'own' AND class_value NOT IN ('Federal', 'State', 'County',
    'City', 'Special District', 'Non Profit', 'Tribal') GROUP BY ALL""")
def undeclared_labels(spark, sf):
    from panelspark.operators.lookups import undeclared_labels as op

    own = event_frame(spark, sf).where(F.col("arm") == "own")
    return op(own, "class_value", P.OWNER_ROLE)


@query("label_roles", with_("frame") + """SELECT CASE class_value WHEN 'State' THEN
    'pa_treatment' WHEN 'County' THEN 'protected_other' END AS role, count(*) AS n
    FROM frame WHERE arm = 'pa' GROUP BY ALL""")
def label_roles(spark, sf):
    from panelspark.operators.lookups import label_roles as op

    pa = event_frame(spark, sf).where(F.col("arm") == "pa")
    return op(pa, "class_value", P.AGENCY_ROLE).groupBy("role").agg(
        F.count(F.lit(1)).alias("n"))


@query("earliest_date", with_("frame") + """SELECT pixel_id, min(event_year) AS offset_start
    FROM frame WHERE arm = 'offset' AND event_year IS NOT NULL GROUP BY pixel_id""")
def earliest_date(spark, sf):
    return E.earliest_year(event_frame(spark, sf).where(F.col("arm") == "offset"),
                           "offset_start")


@query("cell_groups", with_("k_group") + """SELECT pixel_id, lulc,
    chain || CASE WHEN undated THEN 'Tu' ELSE '' END || '_' || status AS class_code,
    status AS status_code, grp AS analysis_group, coalesce(CASE WHEN grp IN ('UP', 'OP',
      'ONP', 'T2P', 'F3P', 'F4P') THEN 'treatment' WHEN grp IS NOT NULL THEN 'control' END,
      rule) AS eligibility,
    CASE WHEN grp IS NULL THEN NULL WHEN ne = 1 THEN yr WHEN off IS NOT NULL THEN off END
      AS cohort_year, nd AS n_detect, det AS detect_at_event FROM k_group""")
def cell_groups(spark, sf):
    return groups(spark, sf).select(
        "pixel_id", "lulc", "class_code", "status_code", "analysis_group",
        "eligibility", "cohort_year", F.col("n_detect").cast("long").alias("n_detect"),
        "detect_at_event")


_STEPS = ", ".join(f"({i + 1}, '{r}')" for i, r in enumerate(P.LEDGER_ORDER))


@query("rule_ledger", with_("k_group", s=f"""SELECT * FROM (VALUES {_STEPS}) v(step, rule)""")
    + """SELECT s.step, s.rule, count(k.pixel_id) AS removed,
    CAST((SELECT count(*) FROM k_group) - sum(count(k.pixel_id)) OVER (ORDER BY s.step)
      AS BIGINT) AS remaining
    FROM s LEFT JOIN k_group k ON k.rule = s.rule GROUP BY s.step, s.rule""")
def rule_ledger(spark, sf):
    return L.ledger_table(groups(spark, sf), "rule", P.LEDGER_ORDER)


@query("rule_ledger_ends", with_("k_group", s=f"""SELECT * FROM (VALUES {_STEPS}) v(step, rule)""",
    l="""SELECT s.step, s.rule, count(k.pixel_id) AS removed, CAST((SELECT count(*) FROM k_group)
      - sum(count(k.pixel_id)) OVER (ORDER BY s.step) AS BIGINT) AS remaining
      FROM s LEFT JOIN k_group k ON k.rule = s.rule GROUP BY s.step, s.rule""")
    + f"""SELECT * FROM l UNION ALL SELECT 0, 'start', 0, count(*) FROM k_group UNION ALL
    SELECT {len(P.LEDGER_ORDER) + 1}, 'assigned', count(grp),
      {n_if("rule IS NULL AND grp IS NULL")} FROM k_group""")
def rule_ledger_ends(spark, sf):
    return L.ledger_with_ends(groups(spark, sf), "rule", P.LEDGER_ORDER, "analysis_group")


@query("class_taxonomy", with_("k_group") + """SELECT chain || CASE WHEN undated THEN 'Tu'
    ELSE '' END || '_' || status AS class_code, status AS status_code, grp AS analysis_group,
    count(*) AS n FROM k_group GROUP BY ALL""")
def class_taxonomy(spark, sf):
    return L.crosstab(groups(spark, sf), ["class_code", "status_code", "analysis_group"])


@query("taxonomy_tail", with_("k_group", c="""SELECT chain || CASE WHEN undated THEN 'Tu'
    ELSE '' END || '_' || status AS code, count(*) AS n FROM k_group GROUP BY ALL""",
    b="SELECT unnest([10, 100, 1000]) AS below")
    + f"""SELECT CAST(below AS BIGINT) AS below, {n_if("n < below")} AS n_codes,
    CAST(coalesce(sum(n) FILTER (n < below), 0) AS BIGINT) AS n_cells
    FROM b, c GROUP BY below""")
def taxonomy_tail(spark, sf):
    return L.small_codes(groups(spark, sf), "class_code")


@query("group_summary", with_("k_group", g="""SELECT grp AS analysis_group, count(*) AS n,
    min(CASE WHEN ne = 1 THEN yr ELSE off END) AS cohort_first,
    max(CASE WHEN ne = 1 THEN yr ELSE off END) AS cohort_last,
    count(DISTINCT CASE WHEN ne = 1 THEN yr ELSE off END) AS n_cohorts
    FROM k_group WHERE grp IS NOT NULL GROUP BY grp""",
    c="SELECT cand AS analysis_group, count(*) AS n_candidates FROM k_group "
      "WHERE cand IS NOT NULL GROUP BY cand")
    + """SELECT g.*, n_candidates, round(100.0 * n / n_candidates, 2) AS retention_pct
    FROM g LEFT JOIN c USING (analysis_group)""")
def group_summary(spark, sf):
    return L.group_summary(groups(spark, sf))


@query("detection_miss", with_("k_group") + """SELECT cand AS "group", count(*) AS n_missed,
    round(100 * avg(CASE WHEN nd = 0 THEN 1.0 ELSE 0.0 END), 1) AS pct_never_disturbed,
    round(100 * avg(CASE WHEN nd > 0 THEN 1.0 ELSE 0.0 END), 1) AS pct_disturbed_off_window
    FROM k_group WHERE cand IS NOT NULL AND NOT det GROUP BY cand""")
def detection_miss(spark, sf):
    return L.detection_miss(groups(spark, sf))


@query("cohort_share", with_("k_group", n="""SELECT grp AS analysis_group,
    CASE WHEN ne = 1 THEN yr ELSE off END AS cohort_year, count(*) AS n FROM k_group
    WHERE grp IS NOT NULL AND (ne = 1 OR off IS NOT NULL) GROUP BY ALL""",
    s="""SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY analysis_group), 2) AS pct
    FROM n""") + "SELECT *, max(pct) OVER (PARTITION BY analysis_group) AS top_pct FROM s")
def cohort_share(spark, sf):
    g = groups(spark, sf).where(F.col("cohort_year").isNotNull())
    return L.share_in_group(g, ["analysis_group"], "cohort_year")


@query("establishment_eras", with_("frame") + """SELECT CASE WHEN event_year IS NULL THEN
    'unknown' WHEN event_year < 1995 THEN '<1995' WHEN event_year < 1998 THEN '1995-1997'
    ELSE '>=1998' END AS era, count(*) AS n FROM frame WHERE arm = 'pa' GROUP BY ALL""")
def establishment_eras(spark, sf):
    pa = event_frame(spark, sf).where(F.col("arm") == "pa")
    return pa.groupBy(L.eras(F.col("event_year"), [1995, 1998]).alias("era")).agg(
        F.count(F.lit(1)).alias("n"))


@query("exclusion_table", with_("frame", "units", e="""SELECT DISTINCT pixel_id, arm, event_year
    FROM frame WHERE arm IN ('thin', 'fire')""", c="""SELECT pixel_id, count(*) FILTER (arm = 'thin')
    AS nt, count(*) FILTER (arm = 'fire') AS nf FROM e GROUP BY pixel_id""", x="""SELECT pixel_id,
    bool_or(arm = 'thin' AND event_year IS NULL) AS undated, bool_or(arm = 'thin' AND
    coalesce(class_value NOT IN ('Low', 'Medium', 'High'), true)) AS odd, bool_or(arm = 'fire' AND
    coalesce(class_value IN ('1', '5'), false)) AS unc FROM frame WHERE arm IN ('thin', 'fire')
    GROUP BY pixel_id""", q="""SELECT unnest([{'q': 'any_thin', 'v': nt > 0}, {'q': 'any_fire',
    'v': nf > 0}, {'q': 'multi_thin', 'v': nt > 1}, {'q': 'multi_fire', 'v': nf > 1},
    {'q': 'both_arms', 'v': nt > 0 AND nf > 0}, {'q': 'undated_thin', 'v': undated},
    {'q': 'ineligible_thin', 'v': odd}, {'q': 'unclassified_fire', 'v': unc AND nf <= 1},
    {'q': 'single_event_only', 'v': nt > 1 OR nf > 1 OR (nt > 0 AND nf > 0)}]) AS s
    FROM c JOIN x USING (pixel_id)""", g="SELECT count(*) AS n FROM units",
    k="SELECT s.q AS q, count(*) FILTER (s.v) AS n FROM q GROUP BY s.q") + """SELECT
    'grid' AS quantity, n, 100.0 AS pct_of_grid, NULL::DOUBLE AS pct_of_arm FROM g UNION ALL
    SELECT k.q, k.n, round(100.0 * k.n / g.n, 3), CASE k.q
      WHEN 'multi_thin' THEN round(100.0 * k.n / (SELECT n FROM k WHERE q = 'any_thin'), 2)
      WHEN 'multi_fire' THEN round(100.0 * k.n / (SELECT n FROM k WHERE q = 'any_fire'), 2)
      WHEN 'both_arms' THEN round(100.0 * k.n / (SELECT count(*) FROM c), 2) END FROM k, g""")
def exclusion_table(spark, sf):
    from panelspark.operators.quality import exclusion_table as op

    return op(event_frame(spark, sf), units(spark, sf), ["Low", "Medium", "High"], ["1", "5"])


@query("exclusion_accounting", with_("merged", c=f"""SELECT pixel_id,
    {n_if("arm_id = 1")} AS nt, {n_if("arm_id = 2")} AS nf FROM merged GROUP BY pixel_id""")
    + f"""SELECT count(*) AS n_cells, {n_if("nt > 1")} AS n_multi_thin,
    {n_if("nf > 1")} AS n_multi_fire, {n_if("nt > 0 AND nf > 0")} AS n_both_arms,
    {n_if("nt > 1 AND nf > 1")} AS n_multi_in_both,
    {n_if("nt > 1 OR nf > 1 OR (nt > 0 AND nf > 0)")} AS n_union FROM c""")
def exclusion_accounting(spark, sf):
    from panelspark.operators.quality import exclusion_accounting as op

    return op(merged(spark, sf))


@query("reburn", with_("merged", f="""SELECT pixel_id, count(*) AS k,
    arg_min(token, event_year) AS first_token FROM merged WHERE arm_id = 2
    GROUP BY pixel_id""") + f"""SELECT first_token, count(*) AS n_cells,
    {n_if("k > 1")} AS n_reburned, round(100.0 * {n_if("k > 1")} / count(*), 2)
    AS pct_reburned FROM f GROUP BY first_token""")
def reburn(spark, sf):
    from panelspark.operators.quality import reburn as op

    return op(merged(spark, sf))


@query("events_per_year", with_("event_log") + f"""SELECT event_year, token, count(*) AS n,
    count(DISTINCT pixel_id) AS n_pixels, round(avg(amount), 4) AS mean_amount,
    {isum("CASE WHEN amount > 400000 THEN 1 ELSE 0 END")} AS n_large
    FROM event_log GROUP BY ALL""")
def events_per_year(spark, sf):
    return event_log(spark, sf).groupBy("event_year", "token").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("pixel_id").alias("n_pixels"),
        F.round(F.avg("amount"), 4).alias("mean_amount"),
        F.sum((F.col("amount") > 400000).cast("long")).alias("n_large"))
