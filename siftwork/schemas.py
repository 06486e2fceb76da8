"""Schemas and fixed lookup values.

Everything under "fixed values" must equal what the evaluated workflows
use, so results stay comparable; it is stated plainly here, once.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# fixed values
# --------------------------------------------------------------------------

# database dimension: (database_id, database_name, free_api_available)
DATABASES = [
    (1, "pubmed", True),
    (2, "medline", False),
    (3, "embase", False),
    (4, "openalex", True),
]

# search types: (search_type_id, name)
SEARCH_TYPES = [(1, "overarching"), (2, "topic-specific")]

# search strategy types: (id, name)
STRATEGY_TYPES = [
    (1, "boolean-kw"),
    (2, "openalex-topic-search"),
    (3, "boolean-kw-vectorsearch"),
]

# ground-truth id column per database (medline articles carry the pubmed id)
TRUTH_ID_COLUMN = {
    "openalex": "retrieved_oa_id",
    "oa": "retrieved_oa_id",
    "embase": "retrieved_embase_id",
    "pubmed": "retrieved_pubmed_id",
    "medline": "retrieved_pubmed_id",
}

# per-database column names of exported search results -> canonical names
SOURCE_COLUMNS = {
    "pubmed": {"original_id": "pmid", "title": "title", "abstract": "abstract",
               "publication_year": "publication_year"},
    "openalex": {"original_id": "id", "title": "title", "abstract": "abstract",
                 "publication_year": "publication_year"},
    "embase": {"original_id": "accession_number", "title": "primary_title",
               "abstract": "notes_abstract", "publication_year": "publication_year"},
    "medline": {"original_id": "id", "title": "primary_title",
                "abstract": "notes_abstract", "publication_year": "publication_year"},
}

# combined question ids used in file names -> question id of the guideline
QUESTION_ID_REMAP = [
    ("4.2.4.3.combined", "4.2/4.3"),
    ("1.5", "1.5.1/1.5.2"),
    ("1.4", "1.4.1/1.4.2"),
    ("2.1", "2.1.1/2.1.2"),
    ("1.9.1.embase", "1.9.1"),
]

# sr_update flag -> evidence review type (null flag -> narrative review)
REVIEW_TYPE_BY_SR_UPDATE = [
    ("Y", "systematic review update"),
    ("N", "new systematic review"),
]
REVIEW_TYPE_FOR_NULL = "narrative reivew"

OPENALEX_PREFIX = "https://openalex.org/"
RRF_K = 60
RECALL_AT_K = (10, 100, 1000)
BROAD_YEAR_RANGE = (1990, 2022)
DATE_WINDOW_DEFAULT = ("1990-01-01", "2022-12-31", 2)
GOLD_SAMPLE_SIZE = 3
GOLD_SAMPLE_SEED = 42
MIN_INCLUDED_FOR_EVAL = 5
SHOTS = ("zero-shot", "one-shot", "few-shot")
SCOPES = ("overall", "topic")
WORKFLOW_LABELS = [
    ("W1", "T", "topic-specific boolean"),
    ("W2", "O", "overarching boolean"),
    ("W3", "O+OVS", "overarching + overall vector ranking"),
    ("W4", "O+TVS", "overarching + topic vector ranking"),
]
DATABASE_ORDER = ["pubmed", "medline", "embase", "openalex"]

# --------------------------------------------------------------------------
# schemas
# --------------------------------------------------------------------------

SEARCH_RESULT = T.StructType([
    T.StructField("search_strategy_id", T.LongType()),
    T.StructField("article_id", T.LongType()),
    T.StructField("original_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("publication_year", T.IntegerType()),
])

EMBEDDING = T.StructType([
    T.StructField("database", T.StringType()),
    T.StructField("article_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
])

OPENALEX_PAGE = T.StructType([
    T.StructField("meta", T.StructType([T.StructField("next_cursor", T.StringType())])),
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("ids", T.StructType([
            T.StructField("openalex", T.StringType()),
            T.StructField("doi", T.StringType()),
            T.StructField("pmid", T.StringType()),
        ])),
        T.StructField("title", T.StringType()),
        T.StructField("publication_year", T.IntegerType()),
        T.StructField("publication_date", T.DateType()),
        T.StructField("type", T.StringType()),
        T.StructField("abstract_inverted_index",
                      T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))),
        T.StructField("primary_topic", T.StructType([
            T.StructField("id", T.StringType()),
            T.StructField("display_name", T.StringType()),
        ])),
    ]))),
])

EVAL_METRIC_COLUMNS = [
    "nnr", "n_retrieved", "n_missed", "recall", "precision",
    "f1_score", "f2_score", "f3_score", "overall_screening_workload",
]

RANKED_METRIC_COLUMNS = [
    "nnr_raw", "rank_new_relevant", "rank_first_relevant", "nnr_cutoff",
    "n_retrieved", "n_missed", "recall", "recall_cutoff", "precision",
    "precision_cutoff", "f1_score", "f2_score", "f3_score", "f1_score_cutoff",
    "f2_score_cutoff", "f3_score_cutoff", "recall_at_10", "recall_at_100",
    "recall_at_1000", "similarity_threshold_cutoff", "mrr", "mrr_new_relevant",
    "overall_screening_workload", "overall_screening_workload_cutoff",
]
