"""From raw records to one event history per cell."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark import profile as P
from panelspark.functions.numeric import lookup
from panelspark.functions.text import fold_key
from panelspark.sources.scans import fit_columns
from panelspark.sources.schemas import EVENTS


def record_events(records: DataFrame, arm: str, source: str,
                  class_column: str | None) -> DataFrame:
    """A polygon record table as rows of the common event frame."""
    cls = F.col(class_column).cast("string") if class_column else F.lit(None)
    return fit_columns(
        records.withColumn("arm", F.lit(arm))
        .withColumn("source_layer", F.lit(source))
        .withColumn("class_value", cls), EVENTS)


def category_events(layer: DataFrame, arm: str, source: str,
                    nodata: int) -> DataFrame:
    """A yearly class layer as events, without the no-data class."""
    code = F.round("value").cast("int")
    kept = layer.where(F.col("value").isNotNull() & (code != nodata))
    return fit_columns(kept.select(
        "pixel_id", F.lit(arm).alias("arm"), F.lit(source).alias("source_layer"),
        F.col("year").alias("event_year"),
        code.cast("string").alias("class_value")), EVENTS)


def project_events(records: DataFrame, projects: DataFrame, project_key: str,
                   cohort: str, last: str) -> DataFrame:
    """Project records dated by the project table, key folded on both sides."""
    p = projects.groupBy(fold_key(F.col(project_key)).alias("class_value")).agg(
        F.min(F.struct(F.col(cohort).alias("event_year"),
                       F.col(last).alias("aux_year"))).alias("__p"))
    out = (records.drop("event_year")
           .withColumn("class_value", fold_key(F.col("key_value")))
           .join(p, "class_value", "left").select("*", "__p.*").drop("__p")
           .withColumn("arm", F.lit("offset"))
           .withColumn("source_layer", F.lit("offset")))
    return fit_columns(out, EVENTS)


def stack_events(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def detection_screen(layer: DataFrame, secondary: DataFrame | None,
                     threshold: float) -> DataFrame:
    """Sparse table of values above the threshold, secondary value at hits."""
    hit = layer.where(F.col("value") > threshold).select(
        "pixel_id", "year", F.col("value").cast("double").alias("treefrac_loss"))
    if secondary is None:
        return hit.withColumn("agb_loss", F.lit(None).cast("double"))
    s = secondary.select("pixel_id", "year",
                         F.col("value").cast("double").alias("agb_loss"))
    return hit.join(s, ["pixel_id", "year"], "left")


def screen_tally(layer: DataFrame, threshold: float) -> DataFrame:
    """Per year: valid values, detections and their percentage."""
    v = F.col("value")
    out = layer.groupBy("year").agg(
        F.count(v).alias("n_valid"),
        F.coalesce(F.sum((v > threshold).cast("long")), F.lit(0))
        .alias("n_detected"))
    return out.withColumn("pct_detected", F.round(
        100.0 * F.col("n_detected") / F.greatest("n_valid", F.lit(1)), 3))


def count_of_counts(df: DataFrame, key: str, name: str = "n_rows") -> DataFrame:
    """How many keys have 1, 2, ... rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).groupBy(name).agg(
        F.count(F.lit(1)).alias("n_keys"))


def thin_token(record_class: Column, intensity: Column, activity: Column,
               demoted: Sequence[str] = (), all_demoted: bool = False) -> Column:
    """Token of a thinning record.

    An eligible record takes its intensity's token, or the unresolved one.
    Activities that the disturbance test demoted count as entries.
    """
    base = F.when(
        record_class == "treatment_LMH",
        F.coalesce(lookup(intensity, P.INTENSITY_TOKEN), F.lit("Tv"))
    ).otherwise(lookup(record_class, P.RECORD_CLASS_TOKEN))
    if all_demoted:
        move = F.lit(True)
    elif demoted:
        move = F.coalesce(activity.isin(list(demoted)), F.lit(False))
    else:
        return base
    return F.when((base == "Tn") & move, "Td").otherwise(base)


def fire_token(class_value: Column) -> Column:
    return lookup(class_value.try_cast("int"), P.SEVERITY_TOKEN)


def undated_flags(df: DataFrame, year: str = "event_year") -> DataFrame:
    """One row per cell that has an undated record, with how many."""
    return df.where(F.col(year).isNull()).groupBy("pixel_id").agg(
        F.count(F.lit(1)).alias("n_undated"))


def token_arm(token: Column) -> Column:
    """2 for fire evidence, whichever layer it came through; 1 for thinning."""
    return F.when(F.substring(token, 1, 1) == "F", 2).otherwise(1)


def collapse_entries(events: DataFrame,
                     info: Mapping[str, int] = P.TOKEN_INFO) -> DataFrame:
    """One entry per (cell, year, arm): the most informative token.

    Tokens are ranked by a number that also identifies them, so the choice is a
    plain integer minimum with map-side combining.
    """
    names = sorted(info, key=lambda t: (info[t], t))
    rank = lookup(F.col("token"), {t: i for i, t in enumerate(names)})
    pos = F.coalesce(rank, F.lit(len(names)))
    d = (events.where(F.col("event_year").isNotNull())
         .withColumn("arm_id", token_arm(F.col("token")))
         .groupBy("pixel_id", "event_year", "arm_id")
         .agg(F.min(pos).alias("__pos"), F.min("token").alias("__any")))
    back = lookup(F.col("__pos"), {i: t for i, t in enumerate(names)})
    return d.select("pixel_id", "event_year", "arm_id",
                    F.coalesce(back, F.col("__any")).alias("token"))


def _chain() -> Window:
    # at most one row per (year, arm) and cell after the collapse
    return Window.partitionBy("pixel_id").orderBy("event_year", "arm_id", "token")


def merge_adjacent(entries: DataFrame,
                   no_magnitude: Sequence[str] = P.NO_MAGNITUDE) -> DataFrame:
    """Drop entries without magnitude next to an entry of the same arm.

    Neighbours are adjacent rows of the whole cell chain at most one year away.
    Single pass: a run of such entries leaves its first one.
    """
    w = _chain()
    nm = F.col("token").isin(list(no_magnitude))
    prev_arm, next_arm = F.lag("arm_id").over(w), F.lead("arm_id").over(w)
    gap_prev = F.col("event_year") - F.lag("event_year").over(w)
    gap_next = F.lead("event_year").over(w) - F.col("event_year")
    next_nm = F.lead(nm).over(w)
    adj_prev = F.coalesce((prev_arm == F.col("arm_id")) & (gap_prev <= 1),
                          F.lit(False))
    adj_next = F.coalesce((next_arm == F.col("arm_id")) & (gap_next <= 1),
                          F.lit(False))
    drop = nm & (adj_prev | (adj_next & ~F.coalesce(next_nm, F.lit(True))))
    return (entries.withColumn("__drop", drop).where(~F.col("__drop"))
            .drop("__drop"))


def gap_histogram(entries: DataFrame, longest: int = 6) -> DataFrame:
    """Years between consecutive entries of one arm, long gaps together."""
    w = _chain()
    d = entries.select(
        "arm_id", (F.lag("arm_id").over(w) == F.col("arm_id")).alias("__same"),
        F.least(F.col("event_year") - F.lag("event_year").over(w),
                F.lit(longest)).alias("gap"))
    return d.where("__same").groupBy("arm_id", "gap").agg(
        F.count(F.lit(1)).alias("n"))


def event_chain(entries: DataFrame) -> DataFrame:
    """Tokens of a cell in order, as one string."""
    rows = F.array_sort(F.collect_list(F.struct("event_year", "arm_id", "token")))
    return entries.groupBy("pixel_id").agg(F.concat_ws(
        "", F.transform(rows, lambda r: r["token"])).alias("event_chain"))


def event_profile(entries: DataFrame, last_year: int,
                  counting: Sequence[str] = P.COUNTING) -> DataFrame:
    """Chain, years, counts and the sole counting event: one aggregation."""
    kind = F.substring("token", 1, 1)
    eff = (F.col("event_year") <= last_year) & F.col("token").isin(list(counting))
    rows = F.array_sort(F.collect_list(F.struct("event_year", "arm_id", "token")))
    d = entries.groupBy("pixel_id").agg(
        F.concat_ws("", F.transform(rows, lambda r: r["token"]))
        .alias("event_chain"),
        F.min("event_year").alias("first_event_year"),
        F.max("event_year").alias("last_event_year"),
        F.count(F.lit(1)).alias("n_events"),
        F.sum((kind == "T").cast("long")).alias("n_thin"),
        F.sum((kind == "F").cast("long")).alias("n_fire"),
        F.sum(eff.cast("long")).alias("n_effective"),
        F.min(F.when(eff, F.col("token"))).alias("__tok"),
        F.min(F.when(eff, F.col("event_year"))).alias("__yr"))
    sole = F.col("n_effective") == 1
    return d.select(
        "pixel_id", "event_chain", "first_event_year", "last_event_year",
        "n_events", "n_thin", "n_fire", "n_effective",
        F.when(sole, F.col("__tok")).alias("sole_token"),
        F.when(sole, F.col("__yr")).alias("sole_year"))


def land_status(own: DataFrame, protected: DataFrame, tribal: DataFrame,
                undeclared: str = "UN") -> DataFrame:
    """Status and establishment per cell that has any land record.

    Precedence TR > P > PO > PUB > NGO > UN > NP is a maximum over records.
    ``undeclared`` says what a label missing from the registries gives.
    """
    order = {s: len(P.STATUS_ORDER) - i for i, s in enumerate(P.STATUS_ORDER)}
    own_role = lookup(F.col("class_value"), P.OWNER_ROLE)
    pa_role = lookup(F.col("class_value"), P.AGENCY_ROLE)
    o = own.select("pixel_id", F.when(own_role == "tribal", "TR")
                   .when(own_role == "public", "PUB")
                   .when(own_role == "exclude_both", "NGO")
                   .otherwise(undeclared).alias("s"),
                   F.lit(None).cast("int").alias("est"),
                   F.lit(0).alias("pa"), F.lit(0).alias("undated"))
    is_pa = pa_role == "pa_treatment"
    pa = protected.select(
        "pixel_id", F.when(is_pa, "P")
        .when(pa_role.isin("protected_other", "tribal"), "PO")
        .otherwise(undeclared).alias("s"),
        F.when(is_pa, F.col("event_year")).cast("int").alias("est"),
        F.coalesce(is_pa.cast("int"), F.lit(0)).alias("pa"),
        F.coalesce((is_pa & F.col("event_year").isNull()).cast("int"), F.lit(0))
        .alias("undated"))
    t = tribal.select("pixel_id", F.lit("TR").alias("s"),
                      F.lit(None).cast("int").alias("est"),
                      F.lit(0).alias("pa"), F.lit(0).alias("undated"))
    best = o.unionByName(pa).unionByName(t).groupBy("pixel_id").agg(
        F.max(lookup(F.col("s"), order)).alias("__s"),
        F.min("est").alias("pa_est_year"), F.max("undated").alias("__u"))
    back = lookup(F.col("__s"), {v: k for k, v in order.items()})
    return best.select(
        "pixel_id", back.alias("status_code"), "pa_est_year",
        ((F.col("__u") == 1) & F.col("pa_est_year").isNull()).alias("pa_undated"))


def earliest_year(df: DataFrame, name: str, year: str = "event_year") -> DataFrame:
    """Earliest dated record per cell."""
    return df.where(F.col(year).isNotNull()).groupBy("pixel_id").agg(
        F.min(year).alias(name))
