"""Cell grid and event frame to the group table, as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark import profile as P
from panelspark.operators.detect import detected_near, detection_history
from panelspark.operators.events import (collapse_entries, earliest_year,
                                         event_profile, fire_token, land_status,
                                         merge_adjacent, thin_token, undated_flags)
from panelspark.operators.ledger import (assign_groups, class_code,
                                         exclusion_rules, first_rule)

COLUMNS = ["pixel_id", "lulc", "class_code", "event_chain", "status_code",
           "analysis_group", "arm", "stratum", "eligibility", "cohort_year",
           "pa_est_year", "offset_start", "n_events", "n_thin", "n_fire",
           "n_effective", "first_event_year", "last_event_year", "undated_thin",
           "n_detect", "detect_at_event", "candidate_group", "rule"]


def event_entries(events: DataFrame, demoted: Sequence[str] = ()) -> DataFrame:
    """Thinning and fire records with tokens, collapsed and merged."""
    thin = events.where(F.col("arm") == "thin").select(
        "pixel_id", "event_year", thin_token(
            F.col("record_class"), F.col("class_value"), F.col("key_value"),
            demoted).alias("token"))
    fire = events.where(F.col("arm") == "fire").select(
        "pixel_id", "event_year", fire_token(F.col("class_value")).alias("token"))
    tokens = thin.unionByName(fire).where(F.col("token").isNotNull())
    return merge_adjacent(collapse_entries(tokens))


def classify_cells(grid: DataFrame, events: DataFrame, detections: DataFrame,
                   first: int, last: int, demoted: Sequence[str] = (),
                   undeclared: str = "UN", require_detection: bool = True) -> DataFrame:
    """One row per grid cell: history, status, first exclusion rule, group.

    Every input is reduced to one row per cell before it meets the grid, so the
    grid is joined by its own key throughout and keeps one partitioning.
    """
    def arm(a: str) -> DataFrame:
        return events.where(F.col("arm") == a)

    profile = event_profile(event_entries(events, demoted), last)
    undated = undated_flags(arm("thin"))
    status = land_status(arm("own"), arm("pa"), arm("tribal"), undeclared)
    offset = earliest_year(arm("offset"), "offset_start")
    c = (grid.select("pixel_id", "lulc").join(profile, "pixel_id", "left")
         .join(undated, "pixel_id", "left").join(status, "pixel_id", "left")
         .join(offset, "pixel_id", "left"))
    c = (c.withColumn("status_code", F.coalesce("status_code", F.lit("NP")))
         .withColumn("pa_undated", F.coalesce("pa_undated", F.lit(False)))
         .withColumn("undated_thin", F.col("n_undated").isNotNull()).drop("n_undated"))
    for k in ("n_events", "n_thin", "n_fire", "n_effective"):
        c = c.withColumn(k, F.coalesce(k, F.lit(0)))
    w = F.when(F.substring("sole_token", 1, 1) == "F", P.DETECT_WINDOW["fire"]).otherwise(
        P.DETECT_WINDOW["thin"])
    c = detected_near(c, detection_history(detections), w, "sole_year")
    rules = exclusion_rules(first, last, require_detection)
    c = c.withColumn("rule", first_rule(rules)).withColumn(
        "class_code", class_code(F.col("event_chain"), F.col("undated_thin"),
                                 F.col("status_code")))
    late = ("no_detection_at_event", "screen_detection")
    open_ = F.col("rule").isNull() | F.col("rule").isin(*late)
    cand = (open_ & (F.col("n_effective") == 1)
            & F.col("sole_token").isin(list(P.TREATMENT))
            & F.col("sole_year").between(first, last))
    c = c.withColumn("candidate_group", F.when(cand, F.concat(
        "sole_token", F.when(F.col("status_code") == "P", "P").otherwise("NP"))))
    return assign_groups(c, first, last)
