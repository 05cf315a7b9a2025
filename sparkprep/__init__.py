"""Data cleaning, validation and quality measurement as Spark DataFrame operators."""

from .operators import *  # noqa: F401,F403
from .operators.convert import csv_to_json, json_to_csv  # noqa: F401
from .plans import CleanConfig, CleanResult, clean, run, run_history, run_status_counts  # noqa: F401
from .session import build_session, materialize  # noqa: F401
from .sources import (  # noqa: F401
    flatten,
    normalize_text_docs,
    read_any,
    read_csv,
    read_excel,
    read_json,
    read_markdown_tables,
    read_text_docs,
)
from .sources.sinks import read_vectors, write, write_report, write_vectors  # noqa: F401
from .streaming import clean_stream, write_split  # noqa: F401
