"""Job parameters. Every function takes what it needs as arguments; these are the defaults."""

from __future__ import annotations

# Label presets.
DEFAULT_STATUSES = ("Charged Off", "Default")
EDA_DEFAULT_STATUSES = ("Charged Off", "Default", "Late (31-120 days)")

# Name fragments of columns filled in after the loan was granted.
LEAKAGE_KEYWORDS = (
    "total_pymnt", "recoveries", "collection_recovery",
    "last_pymnt", "next_pymnt", "debt_settlement",
)
EDA_LEAKAGE_KEYWORDS = (
    "total_pymnt", "recoveries", "collection_recovery",
    "last_pymnt", "next_pymnt", "debt_settlement_flag",
    "settlement", "hardship",
)

# Columns looked at by the exploratory reports.
HISTOGRAM_FEATURES = ("loan_amnt", "int_rate", "annual_inc", "dti", "fico_range_high")
CORRELATION_FEATURES = ("loan_amnt", "int_rate", "annual_inc", "dti", "revol_bal", "default")

TARGET = "loan_status"
MISSING_LIMIT = 0.5

TEST_SHARE = 0.2
VALIDATION_SHARE = 0.1
SEED = 42

# Settings of the two classifiers.
BASELINE_MAX_ITER = 1000
BOOSTED = {
    "n_estimators": 200,
    "max_depth": 7,
    "learning_rate": 0.05,
    "subsample": 0.8,
    "colsample": 0.8,
    "reg_alpha": 0.1,
    "reg_lambda": 1.0,
}
TUNING_GRID = {
    "n_estimators": (100, 200),
    "max_depth": (5, 7),
    "learning_rate": (0.05, 0.1),
    "subsample": (0.8,),
    "colsample": (0.8,),
}

DECISION_THRESHOLD = 0.5
LOW_RISK_BELOW = 0.3
MEDIUM_RISK_BELOW = 0.6

# A false positive turns down a good loan; a false negative grants a bad one.
COST_FALSE_POSITIVE = 1
COST_FALSE_NEGATIVE = 5

DRIFT_P_VALUE = 0.05
DRIFT_DISTANCE = 0.1
DRIFT_DATASET_SHARE = 0.5
DRIFT_SMALL_REFERENCE = 1000
DRIFT_CATEGORICAL_UP_TO = 5

LOG_DAYS = 30
