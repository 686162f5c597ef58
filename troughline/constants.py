"""Fixed values of the dosing study. They must stay as they are for results to agree."""

# Two-compartment population model: typical values.
TVCL = 4.5  # clearance, L/h
TVVC = 58.4  # central volume, L
TVVP = 38.4  # peripheral volume, L
TVQ = 6.5  # inter-compartmental clearance, L/h

# Covariate model.
REF_WT = 70.0
REF_CRCL = 120.0
CL_CRCL = 0.8  # exponent of creatinine clearance on CL
CL_DIAL = 0.7  # dialysis factor on CL
VC_DIAL = 0.5  # dialysis factor on VC

# Residual error: proportional fraction and additive mg/L.
ERR_PRO = 0.227
ERR_ADD = 3.4

# Variances of the random effects on CL, VC and VP (diagonal).
OMEGA = (0.158404, 0.665856, 0.326041)

# Variances of the proportional and additive residual draws.
SIGMA = (1.0, 1.0)

# Bounds of exp(eta) in the estimation step.
ETA_FACTOR_BOUNDS = (0.001, 1000.0)

# Smallest prediction used in a likelihood.
PREDICTION_FLOOR = 2.220446049250313e-16

# Study time axis, hours.
HORIZON = 168.0
GRID_STEP = 0.25

# Loading and maintenance doses in mg by creatinine clearance group.
STANDARD_LOADING = 2000.0
LOADING_BY_GROUP = {100: 3000.0, 75: 2750.0, 50: 2500.0, 25: 2000.0}
MAINTENANCE_BY_GROUP = {100: 1500.0, 75: 1000.0, 50: 750.0, 25: 1000.0}
# Groups dosed once a day; every other group is dosed every 12 h.
DAILY_GROUPS = (25,)

# Exposure band in mg.h/L over 24 h.
AUC_LOWER = 400.0
AUC_TARGET = 500.0
AUC_UPPER = 550.0
AUC_RESAMPLE = 800.0
AUC_TOXIC = 700.0
PROPORTIONAL_TARGET = 400.0

# Waits until the next sample, hours.
SHORT_WAIT = 24.0
LONG_WAIT = 72.0

# Dose search.
DOSE_STEP = 250.0
MAX_DOSE = 5000.0
START_DOSE = 1000.0  # result of the search when its window holds no exposure difference

# Intervals of the proportional policy and the dose range that needs no interval change.
INTERVALS = (6.0, 8.0, 12.0, 24.0)
DOSE_RANGE = (500.0, 2000.0)

# First sample: creatinine clearance limits.
MIN_CRCL = 20.0
EARLY_CRCL = 39.0

# Method codes, labels and display order.
METHOD_LABELS = (
    ("sagov", "SA Health Guidelines", 1),
    ("auc24", "Proportional TDM", 2),
    ("bayes", "Model-Based TDM", 3),
    ("baynl", "Model-Based w/ Loading Dose", 4),
)

# Percentile pairs of the interval family, as probabilities.
INTERVAL_LEVELS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)

# Guideline decision table, tested in this order.
# (crcl test, concentration test, dose mg, interval h, fallback dose, fallback interval)
# A dose of None keeps the last dose and interval, or takes the fallback when the last dose was 0.
# Bounds are (low, low included, high, high included); None is unbounded.
GUIDELINE_RULES = (
    ((None, True, None, True), (30.0, False, None, True), 0.0, 24.0, None, None),
    ((90.0, False, None, True), (None, True, 10.0, False), 1000.0, 6.0, None, None),
    ((90.0, False, None, True), (10.0, True, 15.0, False), 1250.0, 8.0, None, None),
    ((90.0, False, None, True), (15.0, True, 20.0, True), None, None, 1000.0, 12.0),
    ((90.0, False, None, True), (20.0, False, 25.0, True), 1250.0, 12.0, None, None),
    ((90.0, False, None, True), (25.0, False, 30.0, True), 1000.0, 12.0, None, None),
    ((60.0, True, 90.0, True), (None, True, 10.0, False), 1500.0, 12.0, None, None),
    ((60.0, True, 90.0, True), (10.0, True, 15.0, False), 1250.0, 12.0, None, None),
    ((60.0, True, 90.0, True), (15.0, True, 20.0, True), None, None, 750.0, 12.0),
    ((60.0, True, 90.0, True), (20.0, False, 30.0, True), 750.0, 12.0, None, None),
    ((40.0, True, 60.0, False), (None, True, 15.0, False), 1000.0, 12.0, None, None),
    ((40.0, True, 60.0, False), (15.0, True, 20.0, True), None, None, 500.0, 12.0),
    ((40.0, True, 60.0, False), (20.0, False, 30.0, True), 500.0, 12.0, None, None),
    ((20.0, True, 40.0, False), (None, True, 15.0, False), 750.0, 12.0, None, None),
    ((20.0, True, 40.0, False), (15.0, True, 20.0, True), None, None, 750.0, 24.0),
    ((20.0, True, 40.0, False), (20.0, False, 30.0, True), 750.0, 24.0, None, None),
)
