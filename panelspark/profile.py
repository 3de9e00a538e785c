"""Example profile: the study's rules as data. Operators take them as arguments.

Fixed values: they decide the results and are stated as they are declared.
"""

from __future__ import annotations

STUDY_YEARS = (1985, 2025)
ANALYSIS_YEARS = (1990, 2025)
BASELINE_YEARS = (1985, 1989)
TREAT_YEARS = {"pa": (1990, 2025), "fire": (1990, 2025), "thin": (1990, 2025),
               "offset": (2012, 2019)}
CLASSES = {41: "Decid", 42: "Everg", 43: "Mixed"}

CARBON_FRACTION = 0.47
# layer -> (factor, carbon fraction applies, target unit)
UNITS = {
    "Carbon_AGB": (100.0, True, "gC/m2"),
    "eMapR": (100.0, True, "gC/m2"),
    "LEMMA": (0.1, True, "gC/m2"),
    "Carbon_GPP": (1.0, False, "gC/m2/yr"),
    "GPP": (1.0, False, "gC/m2/yr"),
    "NPP": (1.0, False, "gC/m2/yr"),
    "NEP": (1.0, False, "gC/m2/yr"),
    "NBP": (1.0, False, "gC/m2/yr"),
    "Disturbance_AGB": (1.0, False, "delta t/ha"),
    "Disturbance_TreeFrac": (1.0, False, "delta fraction"),
    "Veg_TreeFrac": (1.0, False, "fraction"),
    "Fire_LCP_CH": (1.0, False, "m"),
}
# layer -> stored sentinel
SENTINELS = {"Carbon_GPP": -32768.0, "NBP": 32767.0,
             "Veg_TreeFrac": 32767 * 1e-4,
             "Disturbance_TreeFrac": -32767 * 1e-4}
# layer, rule, bound
CLEAN_RULES = [("Veg_TreeFrac", "clip_upper", 1.0),
               ("Veg_TreeFrac", "clip_lower", 0.0),
               ("Carbon_GPP", "clip_lower", 0.0),
               ("GPP", "clip_lower", 0.0),
               ("Fire_LCP_CH", "mask_by_reference", None)]
# outcome -> (layer, log1p, native, scope)
OUTCOMES = {
    "agb_almanac": ("Carbon_AGB", True, True, "all"),
    "gpp": ("Carbon_GPP", True, True, "all"),
    "npp_tree": ("NPP", False, True, "all"),
    "nep": ("NEP", False, True, "all"),
    "nbp": ("NBP", False, True, "fire"),
    "agb_emapr": ("eMapR", True, True, "all"),
    "agb_lemma": ("LEMMA", True, True, "all"),
}

# token -> (arm, counts as event, treatment eligible)
TOKENS = {
    "U": ("none", False, False),
    "T1": ("thin", True, True), "T2": ("thin", True, True),
    "T3": ("thin", True, True), "Tv": ("thin", True, False),
    "Td": ("thin", True, False), "Tn": ("thin", False, False),
    "Tu": ("thin", False, False),
    "F2": ("fire", True, True), "F3": ("fire", True, True),
    "F4": ("fire", True, True), "Fu": ("fire", True, False),
}
TOKEN_INFO = {"F4": 1, "F3": 2, "F2": 3, "Fu": 4,
              "T3": 1, "T2": 2, "T1": 3, "Tv": 4, "Td": 5, "Tn": 6}
NO_MAGNITUDE = ("Fu", "Td")
COUNTING = tuple(t for t, (_, counts, _e) in TOKENS.items() if counts)
TREATMENT = tuple(t for t, (_, _c, eligible) in TOKENS.items() if eligible)

SEVERITY_TOKEN = {1: "Fu", 2: "F2", 3: "F3", 4: "F4", 5: "Fu"}
SEVERITY_NODATA = 6
INTENSITY_TOKEN = {"Low": "T1", "Medium": "T2", "High": "T3"}
RECORD_CLASS_TOKEN = {"wildfire": "Fu", "disturbance_only": "Td",
                      "non_disturbing": "Tn"}
AGENCY_ROLE = {
    "Federal": "pa_treatment", "State": "pa_treatment",
    "County": "protected_other", "City": "protected_other",
    "Non Profit": "protected_other", "Special District": "protected_other",
    "Joint": "protected_other", "Private": "protected_other",
    "Home Owners Association": "protected_other", "Tribal": "tribal",
}
OWNER_ROLE = {
    "Federal": "public", "State": "public", "County": "public",
    "City": "public", "Special District": "public",
    "Non Profit": "exclude_both", "Tribal": "tribal",
}
# highest first
STATUS_ORDER = ("TR", "P", "PO", "PUB", "NGO", "UN", "NP")

LEDGER_ORDER = (
    "tribal", "pa_undated", "status_not_analysed", "undated_thin_record",
    "multi_event", "unclassifiable_event", "pre_window_event",
    "pa_after_cohort", "offset_event_conflict", "offset_out_of_window",
    "no_detection_at_event", "screen_detection")

# group -> (arm, role, stratum)
GROUPS = {
    "UP": ("pa", "treatment", None), "UNP": ("control", "control", None),
    "OP": ("offset", "treatment", None), "ONP": ("offset", "treatment", None),
    "F2P": ("fire", "treatment", "Low severity"),
    "F3P": ("fire", "treatment", "Moderate severity"),
    "F4P": ("fire", "treatment", "High severity"),
    "F2NP": ("fire", "control", "Low severity"),
    "F3NP": ("fire", "control", "Moderate severity"),
    "F4NP": ("fire", "control", "High severity"),
    "T1P": ("thin", "treatment", "Low intensity"),
    "T2P": ("thin", "treatment", "Medium intensity"),
    "T3P": ("thin", "treatment", "High intensity"),
    "T1NP": ("thin", "control", "Low intensity"),
    "T2NP": ("thin", "control", "Medium intensity"),
    "T3NP": ("thin", "control", "High intensity"),
}
# pairing -> (treated groups, control groups, arm)
PAIRINGS = {
    "UP_UNP": (("UP",), ("UNP",), "pa"),
    "ONP_UNP": (("ONP",), ("UNP",), "offset"),
    "FP_UP": (("F2P", "F3P", "F4P"), ("UP",), "fire"),
    "FNP_UNP": (("F2NP", "F3NP", "F4NP"), ("UNP",), "fire"),
    "TP_UP": (("T1P", "T2P", "T3P"), ("UP",), "thin"),
    "TNP_UNP": (("T1NP", "T2NP", "T3NP"), ("UNP",), "thin"),
}
DETECT_WINDOW = {"fire": 1, "thin": 1}
SCREEN_THRESHOLD = 0.0

WINDOW_YEARS = 5
WINDOW_MIN = 3
EVENT_DROP = {"pa": 0, "fire": 0, "thin": 1, "offset": 0}
BASE_SHIFT = {"pa": 0, "offset": 0, "fire": 0, "thin": 1}

EXACT = ("lulc", "ecoregion_l3", "huc8")
COVARIATES = {
    "baseline": ("elevation", "slope", "northness", "eastness", "ppt_normal",
                 "tmean_normal", "pop_density", "city_travel_time"),
}
COVARIATES["augmented"] = COVARIATES["baseline"] + (
    "gpp_pre5", "agb_pre5", "ch_pre5")
COVARIATES["augmented_noch"] = COVARIATES["baseline"] + ("gpp_pre5", "agb_pre5")
CALIPER_SD = 0.25
GATE = {"ceiling_config": "nn_exact_1to1", "retention_min": 0.90,
        "smd_max": 0.10, "vr_low": 0.5, "vr_high": 2.0}
# config -> (score, distance, caliper)
CONFIGS = {
    "nn_exact_1to1": (None, "rank", False),
    "glm_nocal": ("glm", "mahalanobis", False),
    "glm_cal025": ("glm", "score", True),
    "elastic_nocal": ("elasticnet", "mahalanobis", False),
    "elastic_cal025": ("elasticnet", "mahalanobis", True),
    "trees_nocal": ("trees", "mahalanobis", False),
    "trees_cal025": ("trees", "mahalanobis", True),
    "mahal_nocal": (None, "mahalanobis", False),
    "mahal_pscal": ("glm", "mahalanobis", True),
    "rmahal_nocal": (None, "robust", False),
    "rmahal_cal025": (None, "robust", True),
}
CAP_PER_GROUP = 100_000
SEED = 160617
BLOCK = 5
BLOCK_CENTRE = 2
MIN_TREATED = 48
EVENT_TIMES = (-15, 45)
FLOORS = {"n_min": MIN_TREATED, "cohorts_min": 3, "retention_min": 0.05}
WIDTH_REFERENCE = 5
WIDTH_FACTOR = 2.0
PRETREND_FLOOR = -9
