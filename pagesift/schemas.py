"""Fixed schemas, enums and default settings. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

FETCH_RECORD = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("nosniff", T.BooleanType()),
        T.StructField("error_kind", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("crawled_at", T.TimestampNTZType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("can_be_vectorized", T.BooleanType(), False),
    ]
)

LINK = T.StructType(
    [
        T.StructField("src_page_id", T.LongType(), False),
        T.StructField("dst_page_id", T.LongType(), False),
    ]
)

# The JSON form of one URL's state. -1 means "not set".
URL_STATE_JSON = T.StructType(
    [
        T.StructField("status", T.IntegerType()),
        T.StructField("worker_id", T.StringType()),
        T.StructField("take_on_at", T.LongType()),
        T.StructField("try", T.IntegerType()),
        T.StructField("retry_at", T.LongType()),
        T.StructField("parent", T.StringType()),
    ]
)

# FIFO position is (enqueue_round, enqueue_seq, enqueue_pos), ties by url: ordered
# without ever numbering the whole table in one task.
URL_STATE = T.StructType(
    [
        T.StructField("url", T.StringType(), False),
        T.StructField("status", T.IntegerType()),
        T.StructField("worker_id", T.StringType()),
        T.StructField("try", T.IntegerType()),
        T.StructField("take_on_at", T.LongType()),
        T.StructField("retry_at", T.LongType()),
        T.StructField("parent", T.StringType()),
        T.StructField("enqueue_round", T.LongType()),
        T.StructField("enqueue_seq", T.LongType()),
        T.StructField("enqueue_pos", T.LongType()),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

# Crawl status codes.
UNKNOWN, QUEUED, PROCESSING, DONE, MANUAL, GIVE_UP, RETRY = range(7)
CRAWL_STATUS_LABELS = ["Unknown", "Queued", "Processing", "Done", "Manual", "GiveUp", "Retry"]

# Fetch class codes.
FETCH_IMPOSSIBLE, FETCH_OK, FETCH_RETRY, FETCH_MANUAL = range(4)
FETCH_STATUS_LABELS = ["fetch impossible", "fetch ok", "fetch retry", "fetch manual"]
FETCH_STATUS_UNKNOWN = "unknown fetch status"

# Crawl settings.
WORKERS = 20
TRY_LIMIT = 5
RETRY_BASE_MS = 5_000
STALE_AFTER_MS = 15_000

# Search and embedding settings.
MIN_SIMILARITY = 0.3
DEFAULT_K = 10
VECTOR_DIM = 384
MAX_CHUNK_BYTES = 3_500_000
