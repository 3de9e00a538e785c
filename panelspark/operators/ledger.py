"""Ordered exclusion rules, analysis groups and their summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark import profile as P
from panelspark.functions.numeric import lookup
from panelspark.operators.core import pct, registry, require


def first_rule(rules: Mapping[str, Column]) -> Column:
    """Name of the first rule that fires; a null condition does not fire."""
    out = None
    for name, cond in rules.items():
        hit = F.coalesce(cond, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def ledger_table(df: DataFrame, rule: str, order: Sequence[str]) -> DataFrame:
    """Removed and remaining rows per step, starting from the whole table.

    One map-side counted aggregation; the running total is over the steps.
    """
    steps = registry(df.sparkSession, ["step", "rule"],
                     [(i + 1, r) for i, r in enumerate(order)])
    counts = df.groupBy(F.coalesce(F.col(rule), F.lit("(kept)")).alias("rule")).agg(
        F.count(F.lit(1)).alias("removed"))
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    removed = F.coalesce("removed", F.lit(0))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    joined = counts.join(steps, "rule", "full").select(
        "step", "rule", removed.alias("removed"), F.sum(removed).over(every).alias("__all"))
    return joined.where(F.col("step").isNotNull()).select(
        F.col("step").cast("int").alias("step"), "rule", "removed",
        (F.col("__all") - F.sum("removed").over(w)).alias("remaining"))


def ledger_with_ends(df: DataFrame, rule: str, order: Sequence[str], group: str) -> DataFrame:
    """The ledger between its first and last line: all rows, and those given a group.

    ``start`` removes nothing; ``assigned`` counts the rows with a group, and as remaining
    the rows that no rule removed and no group took.
    """
    kept, given = F.col(rule).isNull(), F.col(group).isNotNull()
    ends = df.agg(F.count(F.lit(1)).alias("n"),
                  F.coalesce(F.sum(given.cast("long")), F.lit(0)).alias("a"),
                  F.coalesce(F.sum((kept & ~given).cast("long")), F.lit(0)).alias("r"))
    last = len(order) + 1

    def line(step: int, name: str, removed: Column, remaining: Column) -> Column:
        return F.struct(F.lit(step).alias("step"), F.lit(name).alias("rule"),
                        removed.cast("long").alias("removed"), remaining.alias("remaining"))

    two = F.array(line(0, "start", F.lit(0), F.col("n")),
                  line(last, "assigned", F.col("a"), F.col("r")))
    return ledger_table(df, rule, order).unionByName(
        ends.select(F.explode(two).alias("l")).select("l.*"))


def class_code(chain: Column, undated: Column, status: Column) -> Column:
    return F.concat(F.coalesce(chain, F.lit("U")),
                    F.when(undated, "Tu").otherwise(""), F.lit("_"), status)


def exclusion_rules(first: int, last: int, require_detection: bool = True,
                    label_at_cohort: bool = True,
                    treatment: Sequence[str] = P.TREATMENT) -> dict[str, Column]:
    """The study's rules over the columns of a cell table, in order."""
    c = F.col
    n, tok, yr = c("n_effective"), c("sole_token"), c("sole_year")
    one = n == 1
    eligible = F.coalesce(tok.isin(list(treatment)), F.lit(False))
    off = c("offset_start")
    rules = {
        "tribal": c("status_code") == "TR",
        "pa_undated": c("pa_undated"),
        "status_not_analysed": ~c("status_code").isin("P", "NP"),
        "undated_thin_record": c("undated_thin"),
        "multi_event": n > 1,
        "unclassifiable_event": one & ~eligible,
        "pre_window_event": one & (yr < first),
        "pa_after_cohort": (c("status_code") == "P") & one & eligible
        & yr.between(first, last) & (c("pa_est_year") > yr),
        "offset_event_conflict": off.isNotNull() & one,
        "offset_out_of_window": off.isNotNull() & ~off.between(first, last),
        "no_detection_at_event": one & eligible & ~c("detect_at_event"),
        "screen_detection": (n == 0) & (c("n_detect") > 0),
    }
    if not require_detection:
        rules.pop("no_detection_at_event")
    if not label_at_cohort:
        rules.pop("pa_after_cohort")
    return rules


def assign_groups(cells: DataFrame, first: int, last: int,
                  groups: Mapping = P.GROUPS,
                  treatment: Sequence[str] = P.TREATMENT) -> DataFrame:
    """Analysis group, role, arm, stratum and cohort of cells left open.

    ``cells`` has a ``rule`` column, null where no rule fired. A code outside
    the registry fails the job.
    """
    c = F.col
    open_ = c("rule").isNull()
    suffix = F.when(c("status_code") == "P", "P").otherwise("NP")
    treated = (open_ & (c("n_effective") == 1) & c("sole_token").isin(list(treatment))
               & c("sole_year").between(first, last))
    zero = open_ & (c("n_effective") == 0)
    offset = zero & c("offset_start").isNotNull()
    group = (F.when(treated, F.concat(c("sole_token"), suffix))
             .when(offset, F.concat(F.lit("O"), suffix))
             .when(zero, F.concat(F.lit("U"), suffix)))
    out = cells.withColumn("analysis_group", group)
    out = require(out, F.coalesce(~c("analysis_group").isin(list(groups)),
                                  F.lit(False)), "undeclared analysis group")
    g = c("analysis_group")
    role = lookup(g, {k: v[1] for k, v in groups.items()})
    return (out.withColumn("arm", lookup(g, {k: v[0] for k, v in groups.items()}))
            .withColumn("stratum", lookup(
                g, {k: v[2] for k, v in groups.items() if v[2]}))
            .withColumn("eligibility", F.coalesce(role, c("rule"),
                                                  F.lit("unassigned")))
            .withColumn("cohort_year", F.when(treated, c("sole_year"))
                        .when(offset, c("offset_start")).cast("int")))


def crosstab(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts per combination, null levels included."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def group_summary(cells: DataFrame, candidates: str = "candidate_group") -> DataFrame:
    """Size and cohort span per group, with retention against candidates."""
    g = cells.where(F.col("analysis_group").isNotNull()).groupBy(
        "analysis_group").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("cohort_year").alias("cohort_first"),
        F.max("cohort_year").alias("cohort_last"),
        F.count_distinct("cohort_year").alias("n_cohorts"))
    k = cells.where(F.col(candidates).isNotNull()).groupBy(
        F.col(candidates).alias("analysis_group")).agg(
        F.count(F.lit(1)).alias("n_candidates"))
    return g.join(k, "analysis_group", "left").withColumn(
        "retention_pct", pct(F.col("n"), F.col("n_candidates")))


def detection_miss(cells: DataFrame, group: str = "candidate_group") -> DataFrame:
    """Candidates without a detection at the event: never, or off the window."""
    miss = cells.where(F.col(group).isNotNull() & ~F.col("detect_at_event"))
    ever = (F.col("n_detect") > 0).cast("double")
    return miss.groupBy(F.col(group).alias("group")).agg(
        F.count(F.lit(1)).alias("n_missed"),
        F.round(100 * F.avg(1 - ever), 1).alias("pct_never_disturbed"),
        F.round(100 * F.avg(ever), 1).alias("pct_disturbed_off_window"))


def small_codes(cells: DataFrame, code: str,
                limits: Sequence[int] = (10, 100, 1000)) -> DataFrame:
    """Codes and cells below each size."""
    n = cells.groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    lim = registry(cells.sparkSession, ["below"], [(x,) for x in limits])
    hit = F.col("n") < F.col("below")
    return n.join(lim, F.lit(True)).groupBy("below").agg(
        F.sum(hit.cast("long")).alias("n_codes"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_cells"))


def share_in_group(df: DataFrame, group: Sequence[str], level: str) -> DataFrame:
    """Level counts with their share of the group and the group's top share."""
    n = df.groupBy(*group, level).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group)
    share = F.round(100.0 * F.col("n") / F.sum("n").over(w), 2)
    return n.withColumn("pct", share).withColumn(
        "top_pct", F.max("pct").over(w))


def eras(year: Column, cuts: Sequence[int]) -> Column:
    """Half-open year classes ``[a, b)``; before, between and after the cuts."""
    out = F.when(year.isNull(), "unknown").when(year < cuts[0], f"<{cuts[0]}")
    for a, b in zip(cuts, cuts[1:]):
        out = out.when(year < b, f"{a}-{b - 1}")
    return out.otherwise(f">={cuts[-1]}")
