"""Content hashes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._columns import col


def sha256_hex(content: Column | str) -> Column:
    """SHA-256 as lower-case hex."""
    return F.sha2(col(content), 256)


def md5_hex(content: Column | str) -> Column:
    """MD5 as lower-case hex."""
    return F.md5(col(content))


def hash_algorithm(name: str | None) -> str:
    """Canonical name of a supported algorithm; none given means SHA-256."""
    name = (name or "sha256").lower()
    if name not in ("md5", "sha256"):
        raise ValueError(f"unsupported hash algorithm {name!r}: use 'md5' or 'sha256'")
    return name


def content_hash(content: Column | str, algorithm: str | None = None) -> Column:
    """Hash of ``content`` by the chosen algorithm."""
    return md5_hex(content) if hash_algorithm(algorithm) == "md5" else sha256_hex(content)


def hash_prefix(digest: Column | str, n: int = 12) -> Column:
    """First ``n`` characters and an ellipsis; a digest no longer than that stays as it is."""
    digest = col(digest)
    return F.when(F.length(digest) > n, F.concat(F.left(digest, F.lit(n)), F.lit("..."))).otherwise(digest)
