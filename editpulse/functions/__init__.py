"""Column functions: built-in Spark expressions only, no Python per row."""

from .addresses import IPV4_PATTERN, IPV6_PATTERN, is_ip_address, looks_anonymous
from .numbers import hourly_rate, safe_ratio, share, speed_score, speed_score_of_sums
from .text import fill_text, null_if_empty, strip
from .times import bucket_offset_minutes, hour_start, parse_timestamp, to_iso

__all__ = [
    "IPV4_PATTERN", "IPV6_PATTERN", "is_ip_address", "looks_anonymous",
    "hourly_rate", "safe_ratio", "share", "speed_score", "speed_score_of_sums",
    "fill_text", "null_if_empty", "strip",
    "bucket_offset_minutes", "hour_start", "parse_timestamp", "to_iso",
]
