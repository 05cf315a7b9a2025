"""CSV scan: everything as text first, damaged lines skipped or dropped, never an abort."""

from __future__ import annotations

import re
from collections.abc import Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.parsing import READER_NULL_TOKENS, trim_text

SEPARATORS = [",", ";", "\t", "|"]


def _options(sep: str, encoding: str) -> dict[str, str]:
    options = {"sep": sep, "encoding": encoding, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    return options | ({"multiLine": "true"} if _wide(encoding) else {})


def _wide(encoding: str) -> bool:
    """Whether a line feed is more than one byte, so that a file cannot be split at that byte."""
    return encoding.upper().startswith("UTF-16")


@contextmanager
def _missing_file(path):
    """A missing path is a missing file to the caller."""
    try:
        yield
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"CSV file not found: {path}") from error
        raise


def sniff_separator(spark: SparkSession, path: str | Sequence[str]) -> str:
    """The candidate that splits the header line most often."""
    with _missing_file(path):
        first = spark.read.text(path).where(F.trim("value") != "").first()
    line = first["value"] if first else ""
    return max(SEPARATORS, key=line.count)


def read_header(spark: SparkSession, path, sep: str = ",", encoding: str = "UTF-8") -> list[str]:
    """Names from the first line; repeats get a numbered suffix and blanks a positional name."""
    with _missing_file(path):
        first = spark.read.options(**_options(sep, encoding)).csv(path, header=False).first()
    if first is None:
        raise ValueError(f"CSV file is empty: {path}")
    names, seen = [], {}
    for i, cell in enumerate(first):
        name = (cell or "").lstrip("﻿") or f"Unnamed: {i}"
        if name in seen:
            seen[name] += 1
            name = f"{name}.{seen[name]}"
        seen.setdefault(name, 0)
        names.append(name)
    return names


def scan_lines(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8") -> tuple[bool, dict[str, list[str]]]:
    """Whether a quoted cell may go over several lines, as some line has an odd number of quotes; and the files by
    their first line. One pass over the lines; one row for each file comes back, as the scan lists them anyway."""
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.option("encoding", encoding).text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    filled = F.when(F.trim("value") != "", F.col("value"))
    found = lines.select(F.col("_metadata.file_path").alias("file"), filled.alias("line"), place.alias("place"), (quotes % 2 == 1).alias("odd"))
    files = found.groupBy("file").agg(
        F.min_by("line", F.when(F.col("line").isNotNull(), F.col("place"))).alias("line"), F.bool_or("odd").alias("odd")
    )
    rows = files.orderBy("file").collect()
    headers: dict[str, list[str]] = {}
    for row in rows:
        if row["line"] is not None:
            headers.setdefault(row["line"].lstrip("\ufeff").rstrip("\r"), []).append(row["file"])
    return any(row["odd"] for row in rows), headers


def detect_encodings(spark: SparkSession, path: str | Sequence[str]) -> dict[str, list[str]]:
    """Files by encoding: by byte-order mark, by zero bytes in the first line, by whether all bytes are valid UTF-8.

    What is neither UTF-16 nor valid UTF-8 anywhere in the file is taken as ISO-8859-1, which can hold any bytes; other encodings
    of one byte a character are not told apart from it. One pass over the bytes of all lines; one row for each file
    comes back. Files without bytes are left out.
    """
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    mark = F.hex(F.substring(F.col("value").cast("binary"), 1, 3))
    first = F.struct(mark.alias("mark"), F.instr("value", "\0").alias("zero"))
    with _missing_file(path):
        lines = spark.read.text(path)  # the reader hands on the bytes as they are
    seen = lines.select(
        F.col("_metadata.file_path").alias("file"), place.alias("place"), first.alias("first"), F.is_valid_utf8("value").alias("valid")
    )
    files = seen.groupBy("file").agg(F.min_by("first", "place").alias("first"), F.bool_and("valid").alias("valid"))
    found: dict[str, list[str]] = {}
    for row in files.orderBy("file").collect():
        mark, zero = row["first"]
        if mark.startswith(("FFFE", "FEFF")):
            encoding = "UTF-16"
        elif zero and not mark.startswith("EFBBBF"):
            encoding = "UTF-16BE" if zero == 1 else "UTF-16LE"
        else:
            encoding = "UTF-8" if row["valid"] else "ISO-8859-1"
        found.setdefault(encoding, []).append(row["file"])
    return found


def _by_encoding(spark: SparkSession, found: dict[str, list[str]], header: Sequence[str] | None, sep: str, **options) -> DataFrame:
    """Files of several encodings as one table, with the columns of the first file."""
    groups = sorted(found.items(), key=lambda group: group[1][0])
    parts = [read_csv(spark, files, sep=sep, encoding=encoding, header=header, **options) for encoding, files in groups]
    names = parts[0].columns
    for (_, files), part in zip(groups, parts):
        if sorted(part.columns) != sorted(names):
            raise ValueError(f"files do not share their columns: {files[0]} has {part.columns}, others have {names}")
    return reduce(DataFrame.unionAll, [p.select(*[F.col("`" + n.replace("`", "``") + "`") for n in names]) for p in parts])


def has_line_breaks(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8") -> bool:
    """Whether a quoted cell may go over several lines."""
    return scan_lines(spark, path, encoding)[0]


def _by_name(spark: SparkSession, headers: dict[str, list[str]], names: list[str], sep: str, encoding: str, **options) -> DataFrame:
    """Files whose headers name the same columns in different orders, in the order of ``names``."""
    parts = []
    for line, files in headers.items():
        own = read_header(spark, files[0], sep, encoding)
        if sorted(own) != sorted(names):
            raise ValueError(f"files do not share their columns: {files[0]} has {own}, others have {names}")
        found = read_csv(spark, files, sep=sep, encoding=encoding, same_header=True, **options)
        parts.append(found.select(*[F.col("`" + n.replace("`", "``") + "`") for n in names]))
    return reduce(DataFrame.unionAll, parts)


def field_count(record: Column, sep: str) -> Column:
    """Fields of a raw record; separators inside quoted fields do not count."""
    mark = re.escape(sep)
    bare = F.regexp_replace(record, rf'(?<=^|{mark})"(?:[^"]|"")*+"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    on_bad_lines: str = "skip",
    sep: str | None = ",",
    encoding: str | None = "UTF-8",
    multi_line: bool | None = None,
    header: Sequence[str] | None = None,
    null_tokens: Sequence[str] = READER_NULL_TOKENS,
    same_header: bool = False,
) -> DataFrame:
    """Read CSV files, a folder or a list of files that share a header, as text columns.

    ``skip``: lines with more fields than the header are left out, however many, shorter ones padded with
    NULL. ``encoding=None`` finds each file's encoding (``detect_encodings``); UTF-16 takes one task per file. ``strict``: any line whose number of fields differs is left out. Reader null tokens become NULL,
    fully empty rows disappear, cells are trimmed. ``sep=None`` looks for the separator in the header.
    Line breaks inside quotes take one task per file; whether there are any is looked up in the lines
    first, unless ``multi_line`` says so. Files without a header line need their names in ``header``.

    Files may order their columns differently: columns are those of the first file by name, and files with other columns
    are an error. ``same_header`` says that all begin with the same line; then and with ``multi_line`` no line is looked at first.
    """
    if on_bad_lines not in ("skip", "strict"):
        raise ValueError(f"unknown value for on_bad_lines: '{on_bad_lines}'")
    path = path if isinstance(path, str) else list(path)
    if sep is None:
        sep = sniff_separator(spark, path)
    if encoding is None:
        found = detect_encodings(spark, path)
        if len(found) > 1:
            options = {"on_bad_lines": on_bad_lines, "multi_line": multi_line, "null_tokens": null_tokens, "same_header": same_header}
            return _by_encoding(spark, found, header, sep, **options)
        encoding = next(iter(found), "UTF-8")
    if _wide(encoding):
        multi_line = True
    names = list(header) if header else read_header(spark, path, sep, encoding)
    if multi_line is None or not (header or same_header):
        broken, headers = scan_lines(spark, path, encoding)
        multi_line = broken if multi_line is None else multi_line
        if not header and len(headers) > 1:
            options = {"on_bad_lines": on_bad_lines, "multi_line": multi_line, "null_tokens": null_tokens}
            return _by_name(spark, headers, names, sep, encoding, **options)
    positions = [f"_c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*positions, "_damaged"]])
    reader = spark.read.options(**_options(sep, encoding) | {"multiLine": str(multi_line).lower()}).schema(schema)
    raw = reader.option("columnNameOfCorruptRecord", "_damaged").csv(path, header=header is None)
    fits = F.col("_damaged").isNull()
    if on_bad_lines == "skip":
        # only records that differ from the header are kept as text, and only those are counted
        fits = fits | (field_count(F.rtrim(F.col("_damaged"), F.lit("\r\n")), sep) <= len(names))
    tokens = list(null_tokens)
    known = raw.where(fits).select(
        *[F.when(~F.col(c).isin(tokens), F.col(c)).alias(c) if tokens else F.col(c) for c in positions]
    )
    filled = known.na.drop("all")
    return filled.select(*[trim_text(F.col(c)).alias(c) for c in positions]).toDF(*names)
