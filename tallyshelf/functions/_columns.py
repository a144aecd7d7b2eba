from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: Column | str) -> Column:
    """A column given by name or as an expression."""
    return F.col(value) if isinstance(value, str) else value
