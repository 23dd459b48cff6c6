"""Column names, code tables and limits of the road-accident data model."""

# --- fixed values -----------------------------------------------------------------------------
FIRST_YEAR = 2021

CATEGORY_KEYWORDS = {
    "caracteristiques": ["caract"],
    "lieux": ["lieux"],
    "usagers": ["usagers"],
    "vehicules": ["vehicules", "vehicul"],
}
HEADER_COLUMNS = {
    "caracteristiques": ["num_acc", "jour", "mois", "an", "lum"],
    "lieux": ["num_acc", "catr", "vma"],
    "usagers": ["num_acc", "grav", "catu"],
    "vehicules": ["num_acc", "catv"],
}
TITLE_EXCLUSIONS = [
    "enrichi", "consolidé", "traitement", "qualité", "bilan",
    "synthèse", "analyse", "open data", "résumé",
]
MIN_FILE_BYTES = 500 * 1024
FUZZY_THRESHOLD = 0.75

COLUMN_RENAMES = {"caracteristiques": {"Accident_Id": "Num_Acc"}}

REQUIRED_COLUMNS = {
    "caracteristiques": ["Num_Acc", "jour", "mois", "lum", "dep", "agg", "int", "lat", "long"],
    "lieux": ["Num_Acc", "catr", "circ", "surf", "situ", "vma"],
    "usagers": ["Num_Acc", "id_vehicule", "num_veh", "catu", "grav", "sexe", "secu1"],
    "vehicules": ["Num_Acc", "id_vehicule", "num_veh", "catv", "obsm", "motor"],
}
# column -> (type, check); a check is ("range", low, high), ("set", values) or None
TABLE_SCHEMAS = {
    "caracteristiques": {
        "Num_Acc": ("string", None),
        "jour": ("int", ("range", 1, 31)),
        "mois": ("int", ("range", 1, 12)),
        "hrmn": ("string", None),
        "lum": ("int", ("set", [-1, 1, 2, 3, 4, 5])),
        "dep": ("string", None),
        "com": ("string", None),
        "agg": ("int", ("set", [-1, 1, 2])),
        "int": ("int", None),
        "atm": ("int", ("range", -1, 9)),
        "col": ("int", None),
        "lat": ("string", None),
        "long": ("string", None),
    },
    "lieux": {
        "Num_Acc": ("string", None),
        "catr": ("int", None),
        "circ": ("int", None),
        "surf": ("int", None),
        "situ": ("int", None),
        "vma": ("int", None),
    },
    "usagers": {
        "Num_Acc": ("string", None),
        "id_vehicule": ("string", None),
        "num_veh": ("string", None),
        "place": ("int", None),
        "catu": ("int", ("set", [-1, 1, 2, 3, 4])),
        "grav": ("int", ("set", [-1, 1, 2, 3, 4])),
        "sexe": ("int", ("set", [-1, 1, 2])),
        "an_nais": ("double", None),
        "secu1": ("double", None),
    },
    "vehicules": {
        "Num_Acc": ("string", None),
        "id_vehicule": ("string", None),
        "num_veh": ("string", None),
        "catv": ("int", None),
        "obsm": ("int", None),
        "motor": ("int", None),
    },
}
NOT_NULL_COLUMNS = {
    "caracteristiques": ["Num_Acc", "jour", "mois", "lum", "dep", "agg", "int"],
    "lieux": ["Num_Acc"],
    "usagers": ["Num_Acc", "id_vehicule", "num_veh", "catu", "grav", "sexe"],
    "vehicules": ["Num_Acc", "id_vehicule", "num_veh"],
}
ROW_COUNT_BOUNDS = (40_000, 90_000)
NULL_RATE_LIMIT = 0.30
SPARSE_LIMIT = 0.70
LAT_BOUNDS = (41.0, 51.5)
LON_BOUNDS_VALIDATION = (-5.5, 9.6)
LON_BOUNDS_HOTSPOTS = (-5.5, 9.5)
SEVERITY_VALUES = [-1, 1, 2, 3, 4]

SEVERITY_RECODE = {1: 1, 2: 3, 3: 4, 4: 2}
TARGET_RECODE = {1: 0, 2: 0, 3: 1, 4: 1}
WEATHER_RECODE = {1: 0, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 0, 9: 0}
VEHICLE_RECODE = {
    0: 0, 1: 1, 2: 1, 3: 2, 4: 1, 5: 1, 6: 6, 7: 2, 8: 5, 9: 5,
    10: 5, 11: 5, 12: 5, 13: 4, 14: 4, 15: 4, 16: 4, 17: 4, 18: 3, 19: 3,
    20: 4, 21: 4, 30: 1, 31: 1, 32: 1, 33: 1, 34: 1, 35: 6, 36: 6, 37: 3,
    38: 3, 39: 3, 40: 3, 41: 1, 42: 1, 43: 1, 50: 1, 60: 1, 80: 0, 99: 0,
}
DEPARTMENT_LETTERS = {"2A": "201", "2B": "202"}

NULL_IF_MINUS_ONE = ["trajet", "secu1", "catv", "obsm", "motor", "circ", "surf", "situ", "vma", "atm", "col"]
NULL_IF_ZERO = ["trajet", "catv", "motor"]
TECHNICAL_COLUMNS = [
    "senc", "larrout", "actp", "manv", "choc", "nbv", "prof", "plan", "Num_Acc", "id_vehicule",
    "id_usager", "num_veh", "pr", "pr1", "voie", "trajet", "secu2", "secu3", "adr", "v1", "lartpc",
    "occutc", "v2", "vosp", "locp", "etatp", "infra", "obs",
]
CRITICAL_COLUMNS = ["catv", "vma", "secu1", "obsm", "atm"]
IMPUTED_COLUMNS = ["surf", "circ", "col", "motor"]

MODEL_FEATURES = [
    "place", "catu", "sexe", "secu1", "victim_age", "catv", "obsm", "motor", "catr", "circ",
    "surf", "situ", "vma", "jour", "mois", "lum", "dep", "com", "agg_", "int", "atm", "col",
    "lat", "long", "hour", "nb_victim", "nb_vehicules",
]
FLOAT_FEATURES = [
    "secu1", "victim_age", "circ", "surf", "situ", "vma", "atm", "col", "lat", "long",
]
DRIFT_CATEGORICAL = [
    "place", "catu", "sexe", "secu1", "catv", "obsm", "motor", "catr", "circ", "surf", "situ",
    "lum", "dep", "com", "agg_", "intersection_type", "atm", "col",
]
DRIFT_NUMERIC = ["victim_age", "vma", "jour", "mois", "hour", "nb_victim", "nb_vehicules"]
DRIFT_LEVELS = (0.10, 0.25)

KPI_THRESHOLDS = {"f1": 0.60, "auc": 0.77, "accuracy": 0.72, "recall": 0.58}
PRIMARY_METRIC = "f1"
MIN_GAIN = 0.01

MODEL_PARAMS = {
    "rf": {"n_estimators": 200, "min_samples_leaf": 5, "max_features": "sqrt", "criterion": "gini",
           "max_depth": None, "class_weight": "balanced"},
    "gbt_depth": {"n_estimators": 300, "max_depth": 5, "learning_rate": 0.05, "subsample": 1.0,
                  "colsample_bytree": 1.0, "gamma": 0.0, "min_child_weight": 1},
    "gbt_leaf": {"n_estimators": 650, "num_leaves": 100, "learning_rate": 0.05, "subsample": 0.8,
                 "colsample_bytree": 0.7, "min_child_samples": 12, "class_weight": "balanced"},
}
META_PARAMS = ["algorithm", "years", "n_train", "n_test", "n_features"]

LATENCY_BUCKETS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
ALERT_LEVELS = {"OK": 0, "WARNING": 1, "CRITICAL": 2}
# --- end of fixed values ----------------------------------------------------------------------
