"""Column expressions: every function takes and returns Columns, all of them built in."""

from .hashing import content_hash, hash_prefix, md5_hex, sha256_hex
from .logtext import log_level_rank, parse_log_line, skipped_file_name
from .names import (
    base_name,
    date_path,
    file_extension,
    join_path,
    name_stem,
    normalize_extension,
    raw_extension,
    suffixed_name,
    walk_key,
    walked_path,
)
from .units import duration_ms, format_file_size, round_to_second, size_mb, transfer_speed

__all__ = [
    "base_name", "content_hash", "date_path", "duration_ms", "file_extension", "format_file_size",
    "hash_prefix", "join_path", "log_level_rank", "md5_hex", "name_stem", "normalize_extension",
    "parse_log_line", "raw_extension", "round_to_second", "sha256_hex", "size_mb",
    "skipped_file_name", "suffixed_name", "transfer_speed", "walk_key", "walked_path",
]
