"""Declared schemas. Codes are strings everywhere so leading zeros survive."""

GRID = "pixel_id BIGINT, lulc STRING, x DOUBLE, y DOUBLE"
YEARLY = "layer STRING, year INT, lulc STRING, pixel_id BIGINT, value FLOAT"
STATIC = "layer STRING, lulc STRING, pixel_id BIGINT, value STRING"
RECORDS = ("pixel_id BIGINT, poly_uid STRING, event_year INT, key_value STRING, "
           "key_value_2 STRING, method_value STRING, intensity STRING, "
           "record_class STRING, xwalk_origin STRING")
EVENTS = ("pixel_id BIGINT, arm STRING, source_layer STRING, poly_uid STRING, "
          "event_year INT, class_value STRING, key_value STRING, "
          "key_value_2 STRING, method_value STRING, record_class STRING, "
          "xwalk_origin STRING, aux_year INT")
DETECTIONS = "pixel_id BIGINT, year INT, treefrac_loss DOUBLE, agb_loss DOUBLE"
MATCHED = ("pixel_id BIGINT, lulc STRING, treat INT, subclass STRING, "
           "weights DOUBLE, distance DOUBLE, analysis_group STRING, "
           "stratum STRING, ecoregion_l3 STRING, huc8 STRING, "
           "cohort_year INT, win_key STRING")
ESTIMATES = ("run_id STRING, estimator STRING, pairing STRING, outcome STRING, "
             "transform STRING, stratum STRING, ecoregion STRING, "
             "base_shift INT, aggregation STRING, term STRING, "
             "time_type STRING, time DOUBLE, estimate DOUBLE, "
             "std_error DOUBLE, statistic DOUBLE, p_value DOUBLE, "
             "conf_low DOUBLE, conf_high DOUBLE, crit_val DOUBLE")
