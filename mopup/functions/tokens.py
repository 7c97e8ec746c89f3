"""Fixed vocabularies.

FIXED VALUES: these lists must equal the behaviour being matched (placeholder
sets, boolean tokens, numeric name hints, read-time NA tokens).  They are data,
not logic; keep them in their natural order.
"""

# --- fixed values: placeholder set used when listing outliers (matched on stripped text,
# case-sensitive, or a value starting with "###")
PH_OUTLIER = [
    "####", "#####", "######", "N/A", "n/a", "NA", "NULL", "null", "None",
    "-", "--", "?", "NaN", "nan",
]

# --- fixed values: placeholder set used by the quality score (matched on stripped,
# lower-cased text, or a value made only of "#", or a missing value)
PH_SCORE = [
    "", "unknown", "not applicable", "n/a", "na", "null", "none",
    "nan", "inf", "infinity", "-", "--", "---", "?", "??", "???",
    "missing", "undefined",
]

# --- fixed values: placeholder set used by profiling (stripped, case-sensitive,
# or a value starting with "###")
PH_ANALYZE = [
    "", "####", "#####", "######", "#######",
    "N/A", "n/a", "NA", "na", "N.A.", "n.a.",
    "NULL", "null", "Null", "None", "none", "NONE",
    "-", "--", "---", "?", "??", "???",
    "NaN", "nan", "NAN", "#N/A", "#NA", "#VALUE!", "#REF!", "#DIV/0!",
    "undefined", "UNDEFINED", "missing", "MISSING",
    ".", "..", "...", "*", "**", "***",
]

# --- fixed values: placeholder set used by cleaning (profiling set plus "unknown")
PH_CLEAN = [
    "####", "#####", "######", "#######",
    "",
    "N/A", "n/a", "NA", "na", "N.A.", "n.a.",
    "NULL", "null", "Null", "None", "none", "NONE",
    "-", "--", "---", "?", "??", "???",
    "NaN", "nan", "NAN", "#N/A", "#NA", "#VALUE!", "#REF!", "#DIV/0!",
    "undefined", "UNDEFINED", "missing", "MISSING", "unknown", "UNKNOWN",
    ".", "..", "...", "*", "**", "***",
]

# --- fixed values: text tokens for the bool conversion (exact match)
BOOL_TRUE = ["true", "True", "TRUE", "t", "T", "yes", "Yes", "YES", "y", "Y", "1"]
BOOL_FALSE = ["false", "False", "FALSE", "f", "F", "no", "No", "NO", "n", "N", "0"]

# --- fixed values: column-name parts that mark a column as numeric-like for scoring
NUMERIC_NAME_PARTS = [
    "duration", "score", "rating", "vote", "income", "revenue",
    "amount", "price", "cost", "budget", "gross", "year", "count",
    "number", "qty", "quantity", "total", "percent", "percentage",
]

# --- fixed values: tokens a delimited-text reader turns into missing values
READ_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# --- fixed values: separators tried when sniffing a delimited file
SEPARATOR_CANDIDATES = [",", ";", "\t", "|"]

# --- fixed values: score weights, in formula order
SCORE_WEIGHTS = {
    "missing_pct": 0.45,
    "placeholder_pct": 0.20,
    "dup_pct": 0.20,
    "numeric_issue_pct": 0.15,
    "row_placeholder_pct": 0.15,
    "outlier_pct": 0.10,
    "const_col_pct": 0.05,
}

# --- fixed values: thresholds
AUTO_NUMERIC_RATIO = 0.70      # default-pipeline numeric conversion
CONVERT_AUTO_NUMERIC_RATIO = 0.95  # dtype_map "auto": numeric first
CONVERT_AUTO_DATE_LIKE = 0.50  # share of values carrying - / or :
CONVERT_AUTO_DATE_RATIO = 0.70
ROW_PLACEHOLDER_SHARE = 0.80
CANDIDATE_MIN_VALUES = 5
CANDIDATE_DIGIT_RATIO = 0.85
CANDIDATE_ALPHA_RATIO = 0.20
LABEL_MAX_CLASSES = 1000
LABEL_ROW_SHARE = 0.8
PREVIEW_ROWS = 1000
OUTLIER_LIST_ROWS = 100
DEFAULT_FILL_TEXT = "Unknown"
