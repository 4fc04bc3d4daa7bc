"""Fixed values of the domain: lookup tables, bounds, bands and defaults."""

# --- Fixed values: ordinal codes -------------------------------------------------
ATTACK_SEVERITY = {
    "Suspicious": 1,
    "Attempted": 2,
    "Boarding": 3,
    "Boarded": 4,
    "Fired Upon": 5,
    "Detained": 5,
    "Hijacked": 6,
    "Explosion": 7,
}
VESSEL_VULNERABILITY = {
    "Berthed": 1,
    "Moored": 1,
    "Anchored": 2,
    "Stationary": 2,
    "Grounded": 3,
    "Drifting": 3,
    "Towed": 4,
    "Fishing": 4,
    "Steaming": 5,
    "Underway": 5,
}
DEFAULT_ORDINAL = 3
COMPLETED_ATTACKS = ("Boarded", "Hijacked", "Fired Upon", "Explosion", "Detained")

# --- Fixed values: regional war-risk multipliers ---------------------------------
REGION_MULTIPLIER = {
    "Gulf of Aden": 2.50,
    "Indian Ocean": 2.00,
    "Middle East & North Africa": 1.90,
    "West Africa": 2.00,
    "South Asia": 1.60,
    "Malacca Strait": 1.80,
    "East Asia & Pacific": 1.40,
    "South America": 1.30,
    "Central America & Caribbean": 1.20,
    "Sub-Saharan Africa": 1.70,
    "Europe & Central Asia": 1.05,
    "North America": 1.00,
}
DEFAULT_REGION_MULTIPLIER = 1.00

# --- Fixed values: pricing defaults ----------------------------------------------
DEFAULT_LGD = 0.35
DEFAULT_THETA = 0.20
DEFAULT_BASE_RATE = 0.0005
DEFAULT_INSURED_VALUE = 25_000_000.0

# --- Fixed values: geography and calendar ----------------------------------------
EARTH_RADIUS_KM = 6371.0
HOTSPOT_LATITUDE = 12.0
HOTSPOT_LONGITUDE = 47.0

# --- Fixed values: cleaning ------------------------------------------------------
DOMAIN_BOUNDS = {
    "latitude": (-90, 90),
    "longitude": (-180, 180),
    "month": (1, 12),
    "year": (1900, 2100),
    "shore_distance": (0, None),
}
UNKNOWN_TEXTS = ("", "nan", "None")
UNKNOWN = "Unknown"
# Texts a CSV reader takes for a missing value (the documented pandas list).
NA_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- Fixed values: risk bands, upper edges in percent, left-closed ---------------
RISK_BANDS = ("Low", "Moderate", "High", "Critical")
RISK_BAND_EDGES = (25, 50, 75)

# --- Fixed values: features and models -------------------------------------------
TOP_COUNTRIES = 15
IQR_MULTIPLIER = 1.5
TREES = 200
TREE_DEPTH = 4
LEARNING_RATE = 0.05
SUBSAMPLE = 0.8
MIN_LEAF = 10
SEED = 42
FOLDS = 10
OVERFIT_MILD_GAP = 0.03
OVERFIT_SIGNIFICANT_GAP = 0.07
