"""Fixed values the results depend on."""

# Robust statistics
IQR_DIVISOR = 1.35
MAD_SCALE = 1.4826
DPAT_K = 6.0
SMALL_COHORT = 20
MIN_COHORT = 3
MIN_ZONE_COHORT = 20
TUKEY_MILD = 1.5
TUKEY_EXTREME = 3.0
BOXPLOT_K = 1.5
BOXPLOT_UPPER_POS = 3.0
BOXPLOT_LOWER_POS = -4.0
BOXPLOT_UPPER_NEG = 4.0
BOXPLOT_LOWER_NEG = -3.0
Z_ELEVATED = 3.0
Z_ANOMALOUS = 4.5
Z_SEVERE = 6.0

# Finite-sample MAD correction for n = 1..19
MAD_CORRECTION = (
    1.0, 1.1955, 1.4872, 1.3606, 1.2168, 1.1896, 1.1379, 1.1274, 1.1012, 1.0957,
    1.0799, 1.0766, 1.0661, 1.0638, 1.0563, 1.0547, 1.0491, 1.0479, 1.0435,
)

# Minimum covariance determinant
MCD_SAMPLE_FACTOR = 5
MCD_SUPPORT = 0.75
MCD_SEED = 42
MCD_CONDITION = 1e12

# Drift, bound and safety
ALPHA = 0.10
HORIZON_H = 168.0
EARLY_H = 24.0
LINEAR_PHI = 7.0
MARGIN_FRACTION = 0.20
MONDRIAN_MIN = 50
MONDRIAN_NONE = 3
RATIO_WATCH = 0.7
RATIO_EARLY_WARNING = 1.0

# Risk and roll-up
WEIGHTS = {"anomaly": 0.30, "drift": 0.30, "margin": 0.20, "quality": 0.10, "credit": 0.10}
SUM_TOLERANCE = 1e-9
RISK_RATIO_REF = 2.0
ZONE_CREDIT = 0.5
PDA_LIMIT = 5.0
PDA_REVIEW = 0.8
PERCENT = 100.0

# Setup attribution and exchangeability guard
SETUP_OFFSET_SIGMA = 2.0
PSI_FIRE = 0.25
PSI_WARN = 0.10
PSI_BINS = 10
PSI_EPSILON = 1e-4
KS_P = 0.01
LOT_CENTRE_Z = 3.0

# physics
BOLTZMANN_EV = 8.617333262145e-5
KELVIN = 273.15

# Persistent shift and series quality
CUSUM_K = 0.5
CUSUM_H = 4.0
CUSUM_MIN = 3
QUALITY_RATES = {
    "MISSING_OBSERVATION": 0.05,
    "NON_FINITE_VALUE": 0.10,
    "IMPOSSIBLE_VALUE": 0.10,
    "CENSORED_READING": 0.02,
    "FLATLINE": 0.25,
    "TIMESTAMP_GAP": 0.05,
    "TIMESTAMP_DISORDER": 0.05,
    "DISCONTINUITY": 0.10,
}
GAP_FACTOR = 1.5
SPIKE_SIGMA = 8.0

# enumerations
PARAMETERS = ("iddq_standby", "leakage_input", "prop_delay", "vth_shift", "icc_active", "output_res")
STATUSES = ("OK", "BELOW_LOD", "OVERRANGE", "NOT_MEASURED", "SUSPECT")
SEVERITY_RANK = {"NOMINAL": 0, "ELEVATED": 1, "ANOMALOUS": 2, "SEVERE": 3, "ABSOLUTE_FAIL": 4}
BAND_RANK = {"SAFE": 0, "WATCH": 1, "EARLY_WARNING": 2, "REJECT": 3}
REJECTION_CLASSES = ("SCHEMA", "RANGE", "UNIT", "DUPLICATE")
PROVENANCE = "SYNTHETIC"
IMPLAUSIBLE_ABS = 1e9
SCREENING_GRID = (0, 24)
REQUIRED_COLUMNS = (
    "component_id", "lot_id", "component_type", "parameter",
    "elapsed_hours", "measurement_value", "measurement_unit", "status",
)
