"""Fixed values of the date rules: formats, patterns, name hints, ranges."""

# Date formats in the order they are tried
# (Spark pattern, strptime pattern, shape of a text the pattern can read).
DATE_FORMATS = [
    ("yyyy-M-d", "%Y-%m-%d", r"\d{4}-\d{1,2}-\d{1,2}"),
    ("M/d/yyyy", "%m/%d/%Y", r"\d{1,2}/\d{1,2}/\d{4}"),
    ("d/M/yyyy", "%d/%m/%Y", r"\d{1,2}/\d{1,2}/\d{4}"),
    ("yyyy/M/d", "%Y/%m/%d", r"\d{4}/\d{1,2}/\d{1,2}"),
    ("M-d-yyyy", "%m-%d-%Y", r"\d{1,2}-\d{1,2}-\d{4}"),
    ("d-M-yyyy", "%d-%m-%Y", r"\d{1,2}-\d{1,2}-\d{4}"),
    ("yyyy.M.d", "%Y.%m.%d", r"\d{4}\.\d{1,2}\.\d{1,2}"),
    ("d.M.yyyy", "%d.%m.%Y", r"\d{1,2}\.\d{1,2}\.\d{4}"),
    ("yyyy-M-d H:m:s", "%Y-%m-%d %H:%M:%S", r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}"),
    ("M/d/yyyy H:m:s", "%m/%d/%Y %H:%M:%S", r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}"),
    ("d/M/yyyy H:m:s", "%d/%m/%Y %H:%M:%S", r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}"),
    ("yyyy-M-d'T'H:m:s", "%Y-%m-%dT%H:%M:%S", r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}"),
    ("yyyy-M-d H:m:s[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]", "%Y-%m-%d %H:%M:%S.%f",
     r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}"),
    ("MMM d, yyyy", "%b %d, %Y", r"[A-Za-z]{3} \d{1,2}, \d{4}"),
    ("MMMM d, yyyy", "%B %d, %Y", r"[A-Za-z]{3,9} \d{1,2}, \d{4}"),
    ("d MMM yyyy", "%d %b %Y", r"\d{1,2} [A-Za-z]{3} \d{4}"),
    ("d MMMM yyyy", "%d %B %Y", r"\d{1,2} [A-Za-z]{3,9} \d{4}"),
    ("M/d/yy", "%m/%d/%y", r"\d{1,2}/\d{1,2}/\d{2}"),
    ("d/M/yy", "%d/%m/%y", r"\d{1,2}/\d{1,2}/\d{2}"),
    ("yy/M/d", "%y/%m/%d", r"\d{2}/\d{1,2}/\d{1,2}"),
    ("d-MMM-yyyy", "%d-%b-%Y", r"\d{1,2}-[A-Za-z]{3}-\d{4}"),
    ("yyyyMMdd", "%Y%m%d", r"\d{8}"),
]

# No listed format reads a longer text.
LONGEST_DATE = 40

# Texts in a table column that look like a date.
TABLE_DATE_PATTERNS = [
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{2}/\d{2}/\d{4}\b",
    r"\b\d{2}-\d{2}-\d{4}\b",
    r"\b\d{4}/\d{2}/\d{2}\b",
    r"\b\d{2}\.\d{2}\.\d{4}\b",
    r"\b\d{4}\.\d{2}\.\d{2}\b",
    r"\b\d{1,2}-[A-Za-z]{3}-\d{4}\b",
    r"\b\d{1,2}\s[A-Za-z]{3,9}\s\d{4}\b",
    r"\b[A-Za-z]{3,9}\s\d{1,2},?\s\d{4}\b",
    r"\b\d{1,2}[/-][A-Za-z]{3}[/-]\d{2,4}\b",
    r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}.*\b",
    r"\b\d{2}[/-]\d{2}[/-]\d{2,4}\b",
    r"\b\d{4}\d{2}\d{2}\b",
]

# Column names of a table that suggest a date.
TABLE_DATE_NAMES = [
    "date", "time", "year", "month", "day", "created", "modified", "timestamp", "period",
]

# Texts in a time-series file that look like a date.
SERIES_DATE_PATTERNS = [
    r"\b\d{4}-\d{1,2}-\d{1,2}\b",
    r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    r"\b\d{1,2}-\d{1,2}-\d{4}\b",
    r"\b\d{4}/\d{1,2}/\d{1,2}\b",
    r"\b\d{1,2}\.\d{1,2}\.\d{4}\b",
    r"\b\d{4}\.\d{1,2}\.\d{1,2}\b",
    r"\b\d{1,2}-[A-Za-z]{3}-\d{4}\b",
    r"\b[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}\b",
    r"\b\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}\b",
    r"\b\d{4}-\d{1,2}-\d{1,2}T\d{2}:\d{2}:\d{2}\b",
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\s+\d{1,2}:\d{2}\b",
    r"\b\d{8}\b",
]

# Column names of a time-series file that suggest a date;
# the first three count only as the whole name.
SERIES_EXACT_NAMES = ["date", "time", "datetime"]
SERIES_DATE_NAMES = [
    "date", "time", "year", "month", "day", "created", "modified", "timestamp", "period",
    "when", "posted", "updated", "occurred",
]

# Keywords for scoring time columns before training.
TIME_KEYWORDS = [
    "date", "time", "timestamp", "datetime", "created", "updated", "year", "month", "day",
    "hour", "minute", "second", "period", "quarter", "week",
]

# Open ranges (years 2000-2030) in which numbers are read as epoch times.
EPOCH_SECONDS = (946684800, 1893456000)
EPOCH_MILLIS = (946684800000, 1893456000000)

# Closed ranges used when time columns are scored.
SCORE_EPOCH_SECONDS = (1000000000, 2147483647)
SCORE_EPOCH_MILLIS = (1000000000000, 2147483647000)

DATE_PARTS = ["year", "month", "day", "dayofweek", "quarter"]
