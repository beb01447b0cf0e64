"""Limits and names that the data model prescribes."""

# Fixed values.
MAX_QUERY_BYTES = 256
MAX_PAGE = 50
PAGE_DEFAULT = 20
MAX_BODY_BYTES = 1_000_000
MAX_TITLE_BYTES = 200
MAX_NAME_BYTES = 200
MAX_PROVENANCE_BYTES = 500
MAX_LABEL_PART_BYTES = 64
MAX_LABEL_IDS = 100
MAX_SOURCES = 100
MAX_ITEMS = 100
MAX_DIMENSIONS = 4096
NORM_TOLERANCE = 0.001
RECALL_CANDIDATES = 20
RECALL_MAX_RESULTS = 5
RECALL_MIN_RESULTS = 3
RECALL_SOURCES = 3
EXCERPT_MIN_BYTES = 160
EXCERPT_MAX_BYTES = 640
RRF_K = 60.0
BUDGET_DEFAULT = 12_000
BUDGET_MIN = 4_000
BUDGET_MAX = 32_000
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6

# Names of kinds, states and relations.
KINDS = ["note", "observation", "decision", "idea", "snippet", "metric", "evidence"]
LIFECYCLES = ["active", "superseded", "merged", "retracted"]
DIRECT_RELATIONS = [
    "references",
    "mentions",
    "derived_from",
    "supports",
    "contradicts",
    "summarizes",
]
RELATIONS = [
    "references",
    "mentions",
    "derived_from",
    "supports",
    "contradicts",
    "supersedes",
    "merged_into",
    "summarizes",
]
GLOBAL_SCOPE = "global"
