"""Column functions that read text cells: trimming, null tokens, booleans, numbers, dates.

Everything here is a built-in expression, so it stays inside whole-stage code generation and can be
used on batch and streaming frames alike. Nothing raises on bad cells: they become NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

# ---- fixed values -----------------------------------------------------------------------------

# Cells that mean "missing" when types are normalised (exact match, case matters).
NULL_TOKENS = ["", " ", "null", "none", "nan", "na", "n/a", "N/A", "undefined"]

# Cells that mean "missing" when converting between CSV and JSON (after trimming).
CONVERSION_NULL_TOKENS = ["", "none", "null", "nan", "na", "n/a", "undefined"]

# Cells a CSV or workbook reader takes as missing before anything else happens.
READER_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

TRUE_TOKENS = ["true", "1", "yes"]
FALSE_TOKENS = ["false", "0", "no"]
TRUE_TOKENS_EXTENDED = ["true", "t", "yes", "y", "1"]
FALSE_TOKENS_EXTENDED = ["false", "f", "no", "n", "0"]

# Text that counts as a number. Spark's own cast also takes "1d", "1.0f" and "Infinity".
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# The usual case: no exponent and too short to overflow a double.
PLAIN_NUMBER_PATTERN = r"^\s*[+-]?(\d{1,300}\.?\d*|\.\d+)\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"

WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())


@dataclass(frozen=True)
class DateFormat:
    """A layout: cells must match ``pattern``; ``iso`` rewrites the groups where they are not in ISO order.

    ``shape`` is what ``date_shape`` gives for its cells. ``parts`` names the groups of layouts that need more
    than an order: day (else the first), name (of the month), month, year, short (year of two digits), time, half (AM or
    PM), and sign, hours and minutes of an offset.
    """

    name: str
    shape: int
    pattern: str
    iso: str | None = None
    parts: tuple[str, ...] = ()

    @property
    def signature(self) -> str:
        """A pattern of the signatures that cells of this layout can have (``date_signature``)."""
        text = self.pattern
        for written, sign in SIGNS:
            text = text.replace(written, sign)
        return text


# Fields of the patterns. They leave out impossible months, days and times, so that hardly any cell
# reaches the cast only to be refused there.
YEAR = r"\d{4}"
MONTH = r"(?:1[0-2]|0?[1-9])"
DAY = r"(?:3[01]|[12]\d|0?[1-9])"
MINUTES = r"(?:2[0-3]|[01]?\d):[0-5]?\d"
SECONDS = MINUTES + r":[0-5]?\d"
FRACTION = r"(?:\.\d{1,9})?"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
NAME = (
    "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|"
    "nov(?:ember)?|dec(?:ember)?)"
)
NAMED = "(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"  # no name of a day has these letters
CLOCK = rf"(?:[ T]({SECONDS}{FRACTION}|{MINUTES}))?"
DAYS = "montuewedthufrisatsun"
WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,? )?"
ZERO_ZONE = "(?: (?:GMT|UTC))?"
HALF = r"([ap])\.?m\.?"
SHORT = r"\d\d"
PADDED_MONTH = r"(?:1[0-2]|0[1-9])"
PADDED_DAY = r"(?:3[01]|[12]\d|0[1-9])"
# How the fields look in a signature, where every digit is a 9 and every word an "a". Longer fields come first.
SIGNS = [
    (WEEKDAY, r"(?:a\.?,? )?"), (NAME, "a"), (ZERO_ZONE, "(?: a)?"), (HALF, r"a\.?(?:a\.?)?"),
    (SECONDS, "99?:99?:99?"), (MINUTES, "99?:99?"), (FRACTION, r"(?:\.9{1,9})?"),
    (MONTH, "99?"), (DAY, "99?"), (PADDED_MONTH, "99"), (PADDED_DAY, "99"), (YEAR, "9{4}"), (SHORT, "99"),
    ("[ T]", "[ a]"), ("[T ]", "[ a]"), ("(?:Z|\\+00:?00)", r"(?:a|\+99:?99)"),
]

# Tried in this order; the first one that reads more than 70 % of a column is used for all of it.
DATE_FORMATS = [
    DateFormat("%Y-%m-%d", 0, f"^{YEAR}-{MONTH}-{DAY}$"),
    DateFormat("%m/%d/%Y", 4, f"^({MONTH})/({DAY})/({YEAR})$", "$3-$1-$2"),
    DateFormat("%d/%m/%Y", 4, f"^({DAY})/({MONTH})/({YEAR})$", "$3-$2-$1"),
    DateFormat("%Y/%m/%d", 2, f"^({YEAR})/({MONTH})/({DAY})$", "$1-$2-$3"),
    DateFormat("%Y-%m-%d %H:%M:%S", 1, f"^{YEAR}-{MONTH}-{DAY} {SECONDS}$"),
    DateFormat("%m/%d/%Y %H:%M", 5, f"^({MONTH})/({DAY})/({YEAR}) ({MINUTES})$", "$3-$1-$2 $4:00"),
]
# Further layouts, tried only when none of the above reads enough of the column.
FALLBACK_FORMATS = [
    DateFormat("iso", 1, f"^{YEAR}-{MONTH}-{DAY}[T ]{SECONDS}{FRACTION}$"),
    DateFormat("iso minutes", 1, f"^({YEAR}-{MONTH}-{DAY})[T ]({MINUTES})$", "$1 $2:00"),
    DateFormat("iso utc", 1, f"^({YEAR}-{MONTH}-{DAY})[T ]({SECONDS}{FRACTION})(?:Z|\\+00:?00)$", "$1 $2"),
    DateFormat("%m/%d/%Y %H:%M:%S", 5, f"^({MONTH})/({DAY})/({YEAR}) ({SECONDS})$", "$3-$1-$2 $4"),
    DateFormat("%Y/%m/%d %H:%M:%S", 3, f"^({YEAR})/({MONTH})/({DAY}) ({SECONDS})$", "$1-$2-$3 $4"),
    DateFormat("iso offset", 1, f"^({YEAR})-({MONTH})-({DAY}){CLOCK} ?([+-])(\\d\\d):?(\\d\\d)$",
               parts=("year", "month", "day", "time", "sign", "hours", "minutes")),
    DateFormat("%m/%d/%Y %I:%M %p", 5, f"(?i)^({MONTH})/({DAY})/({YEAR}){CLOCK} ?{HALF}$",
               parts=("month", "day", "year", "time", "half")),
    DateFormat("%m-%d-%Y", 6, f"^({MONTH})[-.]({DAY})[-.]({YEAR})$", "$3-$1-$2"),
    DateFormat("%d-%m-%Y", 6, f"^({DAY})[-.]({MONTH})[-.]({YEAR})$", "$3-$2-$1"),
    DateFormat("%m-%d-%Y time", 7, f"^({MONTH})[-.]({DAY})[-.]({YEAR}){CLOCK}$", parts=("month", "day", "year", "time")),
    DateFormat("%d-%m-%Y time", 7, f"^({DAY})[-.]({MONTH})[-.]({YEAR}){CLOCK}$", parts=("day", "month", "year", "time")),
    DateFormat("%d %b %Y", 8, f"(?i)^{WEEKDAY}({DAY})[ -]({NAME})\\.?,?[ -]({YEAR}){CLOCK}{ZERO_ZONE}$",
               parts=("day", "name", "year", "time")),
    DateFormat("%b %d %Y", 8, f"(?i)^{WEEKDAY}({NAME})\\.? ({DAY}),? ({YEAR}){CLOCK}{ZERO_ZONE}$",
               parts=("name", "day", "year", "time")),
    DateFormat("%m/%d/%y", 4, f"^({MONTH})/({DAY})/({SHORT})$", parts=("month", "day", "short")),
    DateFormat("%d/%m/%y", 4, f"^({DAY})/({MONTH})/({SHORT})$", parts=("day", "month", "short")),
    DateFormat("%m-%d-%y", 6, f"^({PADDED_MONTH})-({PADDED_DAY})-({SHORT})$", parts=("month", "day", "short")),
    DateFormat("%d-%m-%y", 6, f"^({PADDED_DAY})-({PADDED_MONTH})-({SHORT})$", parts=("day", "month", "short")),
    DateFormat("%d %b %y", 8, f"(?i)^{WEEKDAY}({DAY})[ -]({NAME})\\.?,?[ -]({SHORT})$", parts=("day", "name", "short")),
    DateFormat("%d/%m/%Y %H:%M:%S", 5, f"^({DAY})/({MONTH})/({YEAR}){CLOCK}$", parts=("day", "month", "year", "time")),
    DateFormat("%Y/%m/%d %H:%M", 3, f"^({YEAR})/({MONTH})/({DAY}) ({MINUTES})$", "$1-$2-$3 $4:00"),
    DateFormat("%Y.%m.%d", 0, f"^({YEAR})\\.({MONTH})\\.({DAY})$", "$1-$2-$3"),
    DateFormat("%Y-%m", 0, f"^({YEAR})-({PADDED_MONTH})$", "$1-$2-01"),
    DateFormat("%Y/%m", 2, f"^({YEAR})/({PADDED_MONTH})$", "$1-$2-01"),
    DateFormat("%m/%Y", 4, f"^({MONTH})/({YEAR})$", "$2-$1-01"),
    DateFormat("%b %Y", 8, f"(?i)^({NAME})\\.?,?[ -]({YEAR})$", parts=("name", "year")),
]
# ---- end of fixed values ----------------------------------------------------------------------

ALL_FORMATS = {fmt.name: fmt for fmt in DATE_FORMATS + FALLBACK_FORMATS}
FIRST_SHORT_YEAR = 69  # two digits from here on are of the 20th century


def trim_text(col: Column) -> Column:
    """Remove all leading and trailing whitespace, not only blanks.

    Cells that begin and end with printable ASCII characters, nearly all, are passed on as they are.
    """
    clean = F.ascii(col).between(33, 126) & F.ascii(F.right(col, F.lit(1))).between(33, 126)
    return F.when(clean, col).otherwise(F.btrim(col, F.lit(WHITESPACE)))


def null_if_token(
    col: Column, tokens: Sequence[str] = NULL_TOKENS, *, trim: bool = False, ignore_case: bool = False
) -> Column:
    """NULL where the cell is one of ``tokens``; other cells are returned as they are."""
    probe = trim_text(col) if trim else col
    probe = F.lower(probe) if ignore_case else probe
    return F.when(~probe.isin(list(tokens)), col)


def parse_bool(col: Column, extended: bool = False) -> Column:
    """TRUE / FALSE for the known words (trimmed, any case), NULL for everything else."""
    word = F.lower(trim_text(col.cast("string")))
    true_words = TRUE_TOKENS_EXTENDED if extended else TRUE_TOKENS
    false_words = FALSE_TOKENS_EXTENDED if extended else FALSE_TOKENS
    return F.when(word.isin(true_words), F.lit(True)).when(word.isin(false_words), F.lit(False))


def parse_number(col: Column) -> Column:
    """The cell as a finite double, or NULL. Only numbers with an exponent can overflow.

    Numbers begin with a digit, a sign, a point or whitespace, all below ':'; other cells are not
    looked at any further. The cast ignores outer whitespace by itself.
    """
    number = col.try_cast("double")
    finite = F.when(F.abs(number) < F.lit(float("inf")), number)
    return F.when(F.ascii(col) < ord(":"), F.when(col.rlike(PLAIN_NUMBER_PATTERN), number).when(
        col.rlike(NUMBER_PATTERN), finite
    ))


def parse_integer(col: Column) -> Column:
    """The cell as a long, without going through a double when it is written as an integer."""
    number = parse_number(col)
    return F.when(col.rlike(INTEGER_PATTERN), col.try_cast("bigint")).otherwise(
        F.when(is_integral(number), number.try_cast("bigint"))
    )


def is_integral(number: Column) -> Column:
    """TRUE for numbers without a fraction that fit a long."""
    return (number == F.floor(number)) & (F.abs(number) < F.lit(float(2**63)))


def parse_datetime(col: Column, fmt: str | DateFormat = DATE_FORMATS[0]) -> Column:
    """The cell as a zone-free timestamp in the given layout, or NULL.

    A regular expression decides whether the layout fits and rewrites it to ISO order; the cast then
    checks the calendar. This neither throws per bad cell nor depends on the session time zone.
    """
    layout = ALL_FORMATS[fmt] if isinstance(fmt, str) else fmt
    if layout.parts:
        return _from_parts(col, layout)
    if layout.iso:
        return _rewritten(col, layout, layout.iso).try_cast("timestamp_ntz")
    return F.when(col.rlike(layout.pattern), col.try_cast("timestamp_ntz"))


def _rewritten(col: Column, layout: DateFormat, text: str) -> Column:
    """The groups of a matching cell in another order; what is left of other cells, whose groups are empty, is no date.

    One search for both: a test first would match each cell twice.
    """
    return F.regexp_replace(col, layout.pattern + r"|^[\s\S]+$", text)


def _from_parts(col: Column, layout: DateFormat) -> Column:
    """A matching cell put together from its named groups.

    Cells are searched once for all groups, and nothing found is used twice: Spark would search again for every use
    inside a condition. What depends on one part is therefore told from the cell itself.
    """
    group = {name: f"${i + 1}" for i, name in enumerate(layout.parts)}
    year = group.get("year") or group["short"]
    text = f"{year}-{group.get('month', '#')}-{group.get('day', '1')} {group.get('time', '')}"
    moment = _rewritten(col, layout, text)
    if "name" in group:
        at = F.instr(F.lit(MONTHS), F.lower(F.regexp_extract(col, NAMED, 1)))
        moment = F.replace(moment, F.lit("#"), F.floor((at + 2) / 3).cast("string"))
    end = F.rtrim(col, F.lit("\n\r\u0085\u2028\u2029"))  # a pattern's end may lie before a line break
    if "short" in group:  # always the last field
        moment = F.concat(F.when(F.right(end, F.lit(2)).try_cast("int") < FIRST_SHORT_YEAR, "20").otherwise("19"), moment)
    moment = moment.try_cast("timestamp_ntz")
    if "half" in group:
        after = F.when(col.rlike("[ Tt](?:1[2-9]|2[0-3]):"), 0).otherwise(12)
        before = F.when(col.rlike("[ Tt]12:"), -12).otherwise(0)
        moment = moment + F.make_dt_interval(F.lit(0), F.when(col.rlike(r"(?i)p\.?m\.?$"), after).otherwise(before))
    if "sign" in group:
        offset = F.regexp_replace(F.right(end, F.lit(6)), r"^.?([+-]\d\d):?(\d\d)$", "$1$2").try_cast("int")
        moment = moment - F.make_dt_interval(F.lit(0), (offset / 100).cast("int"), offset % 100)
    return moment


def date_shape(col: Column) -> Column:
    """Which layouts can fit at all, told from one separator and the length; NULL when none can.

    0 year first with dashes, 2 year first with slashes, 4 year last, 6 year last with dashes or points; plus 1 when
    there is a time. 8 with the name of a month, with or without a time.
    """
    fifth = F.substring(col, 5, 1)
    family = F.when(fifth.isin("-", "."), 0).when((fifth == "/") & ~F.contains(F.substring(col, 1, 3), F.lit("/")), 2)
    early = F.substring(col, 2, 2)
    family = family.when(F.contains(early, F.lit("/")), 4)
    named = _begins_with_name(col) | (F.ascii(col).between(48, 57) & early.rlike("[ -]") & F.substring(col, 3, 2).rlike("[A-Za-z]"))
    dashed = F.ascii(col).between(48, 57) & early.rlike("[-.]")
    size = F.octet_length(col)  # known without reading the text; all layouts are ASCII
    timed = family.when(~named & dashed, 6) + F.when(size > 10, 1).otherwise(0)
    return F.when(size.between(*DATE_SIZES), F.when(named, 8).otherwise(timed))


DATE_SIZES = (6, 45)  # bytes of the shortest and longest cell that any layout reads


def _begins_with_name(col: Column) -> Column:
    names = [text[i : i + 3] for text in (MONTHS, DAYS) for i in range(0, len(text), 3)]
    return F.lower(F.left(col, F.lit(3))).isin(names)


def date_signature(col: Column) -> Column:
    """The cell with a 9 for every digit and an "a" for every word where some layout has such cells, else NULL.

    Layouts differ by their signatures but for the order of day and month, and there are a few hundred signatures
    whatever the table holds, so cells can be counted by them before any layout is tried.
    """
    signature = rough_signature(col)
    return F.when(is_known_signature(signature), signature)


def rough_signature(col: Column) -> Column:
    """The signature of cells whose length and first letters are those of dates."""
    likely = F.octet_length(col).between(*DATE_SIZES) & (F.ascii(col).between(48, 57) | _begins_with_name(col))
    digits = F.regexp_replace(col, "[0-9]", "9")
    return F.when(likely, F.regexp_replace(digits, "[A-Za-z]+", "a"))


def is_known_signature(signature: Column) -> Column:
    """Whether some layout has such cells."""
    return signature.rlike("|".join(dict.fromkeys(layout.signature for layout in DATE_FORMATS + FALLBACK_FORMATS)))


def format_datetime(col: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.date_format(col, pattern)


def is_upper(col: Column) -> Column:
    """At least one cased letter and no lower-case one."""
    return (col == F.upper(col)) & (col != F.lower(col))


def is_lower(col: Column) -> Column:
    return (col == F.lower(col)) & (col != F.upper(col))


def as_text(col: Column) -> Column:
    return col.cast("string")


NUMERIC_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType,
)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def kind_of(data_type: T.DataType) -> str:
    """One of numeric / boolean / datetime / text / other for a Spark type."""
    if isinstance(data_type, NUMERIC_TYPES):
        return "numeric"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, DATETIME_TYPES):
        return "datetime"
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    return "other"


def present(col: Column, data_type: T.DataType) -> Column:
    """The column with NULL for NaN, which means missing in every operator."""
    return F.when(~F.isnan(col), col) if isinstance(data_type, (T.DoubleType, T.FloatType)) else col


def numeric_value(col: Column, data_type: T.DataType) -> Column:
    """The column as a number, parsing text and leaving real numbers alone; NaN is missing."""
    kind = kind_of(data_type)
    if kind == "text":
        return parse_number(col)
    if kind == "numeric":
        return present(col, data_type).cast("double")
    if kind == "boolean":
        return col.cast("double")
    return F.lit(None).cast("double")
