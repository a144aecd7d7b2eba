"""Table layouts and fixed vocabulary shared by the whole library."""

from pyspark.sql import types as T

CATALOG = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("hash", T.StringType(), False),
        T.StructField("original_name", T.StringType(), False),
        T.StructField("file_size", T.LongType(), False),
        T.StructField("extension", T.StringType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("processed_at", T.TimestampNTZType(), True),
        T.StructField("source_path", T.StringType(), False),
        T.StructField("target_path", T.StringType(), True),
        T.StructField("hash_type", T.StringType(), False),
    ]
)

# Schema of Spark's binaryFile source; streams must be given it up front.
BINARY = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

FILE_EVENTS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

INVENTORY_COLUMNS = ["path", "name", "extension", "file_size", "modified_at", "hash", "hash_type"]

# Outcomes a file can have in an action plan.
MOVE = "MOVE"
CATALOG_ACTION = "CATALOG"
DELETE_DUPLICATE = "DELETE_DUPLICATE"
SKIP_DUPLICATE = "SKIP_DUPLICATE"
REPLACE_STALE = "REPLACE_STALE"
ALREADY_CATALOGUED = "ALREADY_CATALOGUED"
ERROR = "ERROR"
SKIPPED = "SKIPPED"

# The extension lists and limits a user of the original system relies on.
DEFAULT_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".webp", ".svg"]
IMAGE_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".svg", ".ico",
    ".raw", ".cr2", ".nef", ".arw", ".dng", ".orf", ".rw2", ".pef", ".srw", ".x3f",
]
LARGE_FILE_SIZE = 1024 * 1024
COLUMN_LIMITS = {"hash": 128, "original_name": 500, "extension": 50, "hash_type": 20}
SLOW_LIMITS_MS = {"database_query": 100.0, "batch_insert": 1000.0}
