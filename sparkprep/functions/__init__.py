from .parsing import (
    CONVERSION_NULL_TOKENS,
    DATE_FORMATS,
    FALLBACK_FORMATS,
    NULL_TOKENS,
    READER_NULL_TOKENS,
    DateFormat,
    format_datetime,
    kind_of,
    null_if_token,
    numeric_value,
    parse_bool,
    parse_datetime,
    parse_integer,
    parse_number,
    trim_text,
)

__all__ = [
    "CONVERSION_NULL_TOKENS",
    "DATE_FORMATS",
    "FALLBACK_FORMATS",
    "NULL_TOKENS",
    "READER_NULL_TOKENS",
    "DateFormat",
    "format_datetime",
    "kind_of",
    "null_if_token",
    "numeric_value",
    "parse_bool",
    "parse_datetime",
    "parse_integer",
    "parse_number",
    "trim_text",
]
