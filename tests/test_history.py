import pandas as pd
from pyspark.sql import functions as F

from panelspark.operators import cleaning, events, ledger, spatial
from panelspark.plans.classify import classify_cells
from panelspark.sources.schemas import EVENTS
from panelspark.sources.scans import fit_columns


def entries(spark, rows):
    return spark.createDataFrame(rows, "pixel_id long, event_year int, token string")


def chains(spark, rows):
    d = events.event_chain(events.merge_adjacent(events.collapse_entries(entries(spark, rows))))
    return {r.pixel_id: r.event_chain for r in d.collect()}


def test_collapse_and_merge_edges(spark):
    got = chains(spark, [
        (1, 2000, "Fu"), (1, 2000, "F2"),                      # same year: measured wins
        (2, 2000, "Fu"), (2, 2001, "F3"),                      # merges into next
        (3, 2000, "F2"), (3, 2001, "F3"),                      # measured never merge
        (4, 2000, "Fu"), (4, 2001, "Fu"), (4, 2002, "Fu"),     # first survives
        (5, 2000, "Fu"), (5, 2000, "T1"), (5, 2001, "F2"),     # adjacent row is another arm?
        (6, 2000, "Td"), (6, 2002, "T2"),                      # two years apart: both stay
        (7, 2000, "F2"), (7, 2001, "T1"), (7, 2001, "Fu")])    # other arm in between
    assert got[1] == "F2" and got[2] == "F3" and got[3] == "F2F3" and got[4] == "Fu"
    assert got[5] == "T1F2" and got[6] == "TdT2" and got[7] == "F2T1Fu"


def frame(spark, rows):
    d = spark.createDataFrame(rows, "pixel_id long, arm string, event_year int, "
                              "class_value string, record_class string")
    return fit_columns(d, EVENTS)


def test_classification_rules(spark):
    ev = frame(spark, [
        (1, "fire", 2000, "3", None), (2, "fire", 2000, "3", None), (3, "fire", 1980, "4", None),
        (4, "fire", 2030, "4", None), (5, "thin", None, "Low", "treatment_LMH"),
        (6, "own", None, "Tribal", None), (7, "pa", None, "Federal", None),
        (8, "pa", 1995, "Federal", None), (8, "pa", None, "State", None),
        (9, "own", None, "Mystery", None), (10, "pa", 2005, "State", None),
        (10, "fire", 2000, "2", None), (11, "offset", 2015, None, None),
        (12, "offset", 2015, None, None), (12, "fire", 2001, "2", None),
        (13, "fire", 2000, "2", None), (13, "fire", 2010, "2", None)])
    grid = spark.range(1, 15).select(F.col("id").alias("pixel_id"), F.lit("Everg").alias("lulc"))
    det = spark.createDataFrame([(1, 2001, .2, None), (2, 2005, .2, None), (14, 2000, .1, None)],
                                "pixel_id long, year int, treefrac_loss double, agb_loss double")
    g = {r.pixel_id: r for r in classify_cells(grid, ev, det, 1990, 2025).collect()}
    e = {k: r.eligibility for k, r in g.items()}
    assert e[1] == "control" and g[1].analysis_group == "F3NP" and g[1].cohort_year == 2000
    assert e[2] == "no_detection_at_event" and g[2].candidate_group == "F3NP"
    assert e[3] == "pre_window_event"
    assert g[4].analysis_group == "UNP"              # a future event does not disqualify
    assert e[5] == "undated_thin_record" and g[5].class_code == "UTu_NP"
    assert e[6] == "tribal" and e[7] == "pa_undated"
    assert g[8].analysis_group == "UP" and g[8].pa_est_year == 1995
    assert e[9] == "status_not_analysed" and g[9].status_code == "UN"
    assert e[10] == "pa_after_cohort" and g[11].analysis_group == "ONP"
    assert e[12] == "offset_event_conflict" and e[13] == "multi_event"
    assert e[14] == "screen_detection"
    again = classify_cells(grid.repartition(5), ev.repartition(3), det, 1990, 2025)
    t = ledger.ledger_table(again, "rule", ledger.P.LEDGER_ORDER).orderBy("step").collect()
    open_ = again.where(F.col("rule").isNull()).count()
    assert t[-1].remaining == open_ and sum(r.removed for r in t) + open_ == 14


def test_cleaning_edges(spark):
    d = spark.createDataFrame([
        (1, 2000, "NBP", 32767.0), (2, 2000, "NBP", 32766.0), (3, 2000, "GPP", -4.0),
        (4, 2000, "CH", 5.0), (5, 2000, "CH", 5.0), (6, 2000, "GPP", None)],
        "pixel_id long, year int, layer string, value double")
    ref = spark.createDataFrame([(4, 2000, 1.0)], "pixel_id long, year int, ref_value double")
    out = cleaning.clean_layer(d, {k: (1.0, False, "") for k in ("NBP", "GPP", "CH")}, .47,
                               {"NBP": 32767.0}, [("GPP", "clip_lower", 0.0),
                                                  ("CH", "mask_by_reference", None)], ref)
    v = {r.pixel_id: r.value for r in out.collect()}
    assert v == {1: None, 2: 32766.0, 3: 0.0, 4: 5.0, 5: None, 6: None}


def brute_spacing(reps: pd.DataFrame) -> set:
    kept = []
    for r in reps.sort_values(["d2", "pixel_id"]).itertuples():
        if all((r.row - k.row)**2 + (r.col - k.col)**2 >= 25 for k in kept):
            kept.append(r)
    return {k.pixel_id for k in kept}


def test_spacing_equals_one_by_one(spark):
    d = spark.range(1, 4001).where("id * 2654435761 % 100 < 35").select(
        F.col("id").alias("pixel_id"), (F.col("id") % 2).cast("string").alias("g"))
    reps = spatial.block_representatives(d, "g", 60, 5, 2)
    kept = spatial.enforce_spacing(reps, "g", 25).toPandas()
    for g, part in reps.toPandas().groupby("g"):
        assert set(kept[kept.g == g].pixel_id) == brute_spacing(part)


def test_spacing_distance_limits(spark):
    n = 100
    def cell(r, c):
        return r * n + c + 1
    # squared distances across a block edge: 16 conflicts; 25 and 26 do not
    d = spark.createDataFrame([("a", cell(2, 3)), ("a", cell(2, 7)), ("b", cell(2, 2)),
                               ("b", cell(2, 7)), ("c", cell(2, 2)), ("c", cell(3, 7))],
                              "g string, pixel_id long")
    kept = spatial.spaced_sample(d, "g", n, 5, 2).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in kept} == {"a": 1, "b": 2, "c": 2}


def test_nearest_distance(spark):
    d = spark.createDataFrame([(1,), (3,), (50,), (9001,)], "pixel_id long")
    got = {r.pixel_id: r.distance for r in spatial.nearest_distance(d, 100, 10, 1, 1.0, 2).collect()}
    assert got == {1: 2.0, 3: 2.0, 50: 47.0, 9001: 90.0}


def test_control_distance_covers_every_cell(spark, tmp_path):
    import numpy as np

    from panelspark.queries.spatial import control_distance
    keys = np.random.default_rng(5).permutation(150_000)[:20_500]
    spark.createDataFrame(pd.DataFrame({
        "p_partkey": keys, "p_type": "t", "p_brand": "b", "p_size": 1, "p_retailprice": 1.0,
    })).write.parquet(f"{tmp_path}/part.parquet")
    got = control_distance(spark, str(tmp_path)).toPandas().set_index("pixel_id")["distance"]
    assert len(got) == len(keys) and got.index.is_unique
    row, col = (keys // 50).astype(np.int32), (keys % 50).astype(np.int32)
    assert ((got.index - 1).isin(keys)).all()
    for at in np.array_split(np.arange(len(keys)), 40):
        d2 = (row[at, None] - row) ** 2 + (col[at, None] - col) ** 2
        d2[np.arange(len(at)), at] = 1 << 30
        assert np.allclose(got.loc[keys[at] + 1], 30 * np.sqrt(d2.min(1)), atol=1e-6)
