"""Small frames with the awkward cases every operator has to take."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows (doc_id, text[, lang]) as a table of documents."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def clashing(df: DataFrame) -> DataFrame:
    """The same rows with columns of names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("id", "k1", "k2", "fp", "root", "score", "n_words", "spans", "rate", "token_ids", "host", "bucket", "v", "m")
    return df.withColumns({name: F.lit("x") for name in names})


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
