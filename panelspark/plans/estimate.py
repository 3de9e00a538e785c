"""Units and yearly values to estimates, support windows and result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.numeric import outcome_transform
from panelspark.operators import did
from panelspark.operators.units import balanced_panel, shift_base, viable_cohorts
from panelspark.session import cut_lineage


def analysis_cells(panel: DataFrame, stratum: str, zone: str) -> DataFrame:
    """Every row in the cells it belongs to: all, its stratum, its zone, both.

    A pooled level reads ''. Four copies at most, made before aggregation; the
    cells are then estimated together.
    """
    s, z = F.col(stratum), F.col(zone)
    blank = F.lit("")

    def cell(a: Column, b: Column) -> Column:
        return F.struct(a.alias("s"), b.alias("z"))

    cells = F.array(cell(blank, blank), cell(s, blank), cell(blank, z), cell(s, z))
    keep = F.array_distinct(F.filter(cells, lambda c: c["s"].isNotNull()
                                     & c["z"].isNotNull()))
    return panel.withColumn("__c", F.explode(keep)).withColumn(
        stratum, F.col("__c.s")).withColumn(zone, F.col("__c.z")).drop("__c")


def estimation_rows(panel: DataFrame, by: Sequence[str], transform: Column,
                    base_shift: int = 0, balanced: bool = False) -> DataFrame:
    """Rows an estimator takes: shifted cohorts, viable ones, transformed value."""
    d = panel.withColumn("gvar", shift_base(F.col("gvar"), base_shift))
    d = viable_cohorts(d, by)
    if balanced:
        d = balanced_panel(d, by)
    return d.withColumn("y", outcome_transform(F.col("value"), transform))


def estimate_all(panel: DataFrame, by: Sequence[str], transform: str,
                 base_shift: int = 0, draws: int = 0,
                 kinds: Sequence[str] = ("event", "calendar", "simple"),
                 pooled: bool = False, always_treated: str = "drop") -> DataFrame:
    """Both estimators, all targets of every cell; one pass of scores per estimator.

    ``draws`` gives the varying-base estimator simultaneous bands; ``pooled`` and
    ``always_treated`` (fixed base only) are those of ``did.estimate``.
    """
    tf = F.lit(transform)
    # each table is read by three aggregations twice over: written once
    un = cut_lineage(estimation_rows(panel, by, tf, base_shift))
    bal = cut_lineage(estimation_rows(panel, by, tf, base_shift, balanced=True))
    out = did.estimate(un, by, "etwfe", kinds, pooled=pooled,
                       always_treated=always_treated).unionByName(
        did.estimate(bal, by, "attgt", kinds, draws=draws, pooled=pooled))
    return out.withColumn("transform", tf)
