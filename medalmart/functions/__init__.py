"""Column expressions: every function here returns a Spark ``Column``."""

from .bands import band, whole_years
from .conform import (
    canonical_name,
    compose_timestamp,
    matched_format,
    parse_date,
    variant_kind,
    variant_text,
)
from .keys import hash_key

__all__ = [
    "band",
    "canonical_name",
    "compose_timestamp",
    "hash_key",
    "matched_format",
    "parse_date",
    "variant_kind",
    "variant_text",
    "whole_years",
]
