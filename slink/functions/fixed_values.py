"""Fixed values. Results depend on these exact patterns, words and numbers."""

# Columns and tables that an import leaves out (regex, searched anywhere).
SKIP_COLUMN_PATTERNS = [
    "^__HEVO_",
    "^_FIVETRAN_",
    "^_AIRBYTE_",
    "_SCD$",
    "(?i)default",
    "(?i)values",
]
SKIP_TABLE_PATTERNS = ["FIVETRAN_AUDIT", "^_AIRBYTE_", "_SCD$"]

# Value cleaning.
MAX_VALUE_LENGTH = 600
MAX_INDEXED_VALUE_LENGTH = 100
MIN_HEX_LENGTH = 20
CHUNK_CHARS = 7500
MIN_CHARS_PER_TOKEN = 2.0
# `\z` in Spark (Java) is the very end of the text.
NUMBER_PATTERN = r"^[-+]?(\d+\.\d*|\d*\.\d+|\d+)\z"
HEX_PATTERN = r"^[#0-9a-fA-F]+\z"

# The nine vector indexes, by level, in feature order.
TABLE_INDEXES = [
    "table_name",
    "table_and_all_column_names",
    "table_and_all_column_names_and_all_values",
]
COLUMN_INDEXES = [
    "column_name",
    "table_and_column_name",
    "column_name_and_all_values",
    "table_and_column_name_and_all_values",
]
VALUE_INDEXES = ["value", "table_column_and_value"]
ALL_INDEXES = TABLE_INDEXES + COLUMN_INDEXES + VALUE_INDEXES

# Their scores side by side, as features.
TABLE_SCORES = [f"{name}_score" for name in TABLE_INDEXES]
COLUMN_SCORES = [f"{name}_score" for name in COLUMN_INDEXES]
VALUE_SCORES = [f"{name}_score" for name in VALUE_INDEXES]
ALL_SCORES = TABLE_SCORES + COLUMN_SCORES + VALUE_SCORES

# Default weights of the fixed-weight ranker.
TABLE_WEIGHTS = [1.5, 0.0, 0.1]
COLUMN_WEIGHTS = [0.1, 0.0, 0.0, 0.0]
VALUE_WEIGHTS = [0.5, 0.2]

# Hits kept per question and index: (table and column indexes, value indexes).
WEIGHTED_RANK_LIMITS = (1000, 100)
LEARNED_RANK_LIMITS = (10_000, 5_000)
TRAINING_RANK_LIMITS = (1_000_000, 5_000)

VALUE_SCORE_SCALE = 0.9
FEW_SHOT_SCORE = 100.0
FEW_SHOT_MATCHES = 3
HIDDEN_UNITS = 50

# Packing.
HINTS_STORED = 6
HINTS_RENDERED = 5
DEFAULT_COLUMN_PATTERN = "(_ID$|^ID$|^CREATED_AT$)"

# Import, query and cache limits.
MAX_LIMIT = 10_000
ROW_CAP = 100
CACHE_SECONDS = 60 * 60 * 24 * 2
PREVIEW_QUESTIONS = 3

# Split of question groups by id % 10; 9 is not used.
SPLIT_MODULUS = 10
TRAIN_SLOTS = [0, 1, 2, 3, 4, 5, 6]
TEST_SLOTS = [7]
VALIDATION_SLOTS = [8]

# Identifiers that have to be quoted.
KEYWORDS = [
    "ACCOUNT",
    "ALTER",
    "ANY",
    "BY",
    "CASE",
    "CHECK",
    "CONNECT",
    "CONSTRAINT",
    "CROSS",
    "CURRENT_DATE",
    "CURRENT_TIMESTAMP",
    "DELETE",
    "DROP",
    "ELSE",
    "FOLLOWING",
    "FROM",
    "GROUP",
    "IN",
    "INNER",
    "INTERSECT",
    "IS",
    "LEFT",
    "LOCALTIME",
    "NOT",
    "ON",
    "ORDER",
    "REVOKE",
    "RLIKE",
    "ROWS",
    "SAMPLE",
    "SELECT",
    "SOME",
    "TABLESAMPLE",
    "TO",
    "TRUE",
    "UNIQUE",
    "USING",
    "VALUES",
    "WHENEVER",
    "WITH",
]
