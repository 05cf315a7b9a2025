"""JSON documents of any layout and size, cut into records in parallel.

Files are read in pieces that end at ``}``: Spark's text source finds them from any byte range on, so one large list is
read by as many tasks as a large CSV file. Where a range begins inside a string or at what depth is not known at
first. The first pass tells, for each range, what it does to both possible states (outside or inside a string): whether it
changes the state, and by how much it changes the depth. These few numbers of each range, put one after the other,
give the state at the start of every range. The second pass starts from there and cuts its range into records; records
that go on over the end of a range are put together from one fragment for each range. Each record becomes one line of text,
which Spark's own JSON reader reads.

A file is a list of objects, an object that holds such a list under a wrapper key, or objects one after the other, on one line
or several. What is left over between records must be what the layout asks for; anything else is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import materialize

#: Characters at the beginning of a file from which its layout is told.
HEAD = 4_096

#: Stands where other records have a comma before them.
FIRST = "\x00"

_ESCAPED = re.compile(r"\\.", re.S)


class JsonError(ValueError):
    """A file that is no list, wrapped list or sequence of objects."""


@dataclass
class Range:
    """What a byte range does, for text that begins outside [0] and inside [1] a string."""

    file: str
    start: int
    turns: bool
    depth: tuple[int, int]
    n_pieces: int
    n_bytes: int
    head: str
    size: int


@dataclass(frozen=True)
class Entry:
    """State at the start of a range, depth of the file's records, and the file's layout."""

    inside: bool
    depth: int
    level: int
    prefix: int
    last: bool
    closed: bool


def _pieces(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "}").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), meta["file_size"].alias("size"), "value"
    )


def _rows(batches: Iterator) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def outside(piece: str) -> tuple[str, str, bool]:
    """What of a piece is outside strings if it begins outside or inside one, and whether its quotes are odd."""
    parts = (_ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
    return "".join(parts[::2]), "".join(parts[1::2]), len(parts) % 2 == 0


def change(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("]")


def _summaries(batches: Iterator) -> Iterator:
    """First pass: one row for each range of the task."""
    import pyarrow as pa

    found: list[Range] = []
    for file, start, size, piece in _rows(batches):
        if not found or (found[-1].file, found[-1].start) != (file, start):
            found.append(Range(file, start, False, (0, 0), 0, 0, "", size))
        r = found[-1]
        out, in_, odd = outside(piece)
        steps = (change(in_), change(out)) if r.turns else (change(out), change(in_))
        r.turns ^= odd
        # the brace that ends the piece counts only outside a string
        ends = (0, 1) if r.turns else (1, 0)
        r.depth = (r.depth[0] + steps[0] - ends[0], r.depth[1] + steps[1] - ends[1])
        r.n_pieces += 1
        r.n_bytes += len(piece.encode()) + 1
        if start == 0 and len(r.head) < HEAD:
            r.head = (r.head + piece + "}")[:HEAD]
    rows = [[getattr(r, n) for r in found] for n in ("file", "start", "turns", "n_pieces", "n_bytes", "head", "size")]
    deltas = [[r.depth[k] for r in found] for k in (0, 1)]
    yield pa.RecordBatch.from_arrays(
        [*map(pa.array, rows[:2], (pa.string(), pa.int64())), pa.array(rows[2], pa.bool_()), *[pa.array(d, pa.int64()) for d in deltas],
         *[pa.array(x, t) for x, t in zip(rows[3:], (pa.int64(), pa.int64(), pa.string(), pa.int64()))]],
        names=["file", "start", "turns", "d0", "d1", "n_pieces", "n_bytes", "head", "size"],
    )


def layout(head: str, wrapper_keys: Sequence[str]) -> tuple[int, int]:
    """Depth of a file's records, and the characters before its first record or list."""
    text = head.lstrip("\ufeff").lstrip()
    skipped = len(head) - len(text)
    if text.startswith("["):
        return 1, skipped + 1
    keys = "|".join(map(re.escape, wrapper_keys))
    wrapped = re.match(rf'\{{(?:\s*"[^"\\{{}}\[\]]*"\s*:\s*(?:"[^"\\{{}}\[\]]*"|[^\s"{{}}\[\],]+)\s*,)*\s*"(?:{keys})"\s*:\s*\[', text)
    if keys and wrapped:
        return 2, skipped + wrapped.end()
    return 0, skipped


def entries(ranges: Sequence[Range], wrapper_keys: Sequence[str]) -> dict[tuple[str, int], Entry]:
    """The state at the start of each range; a file whose text does not close is an error."""
    files: dict[str, list[Range]] = {}
    for r in sorted(ranges, key=lambda r: (r.file, r.start)):
        files.setdefault(r.file, []).append(r)
    found = {}
    for file, parts in files.items():
        level, prefix = layout(parts[0].head, wrapper_keys)
        excess = sum(r.n_bytes for r in parts) - parts[0].size
        inside, depth = False, 0
        states = []
        for r in parts:
            states.append((inside, depth))
            depth += r.depth[inside]
            inside ^= r.turns
        # without a brace at its very end, the file's last piece has been counted one too deep
        closed = excess == 0 if excess in (0, 1) else depth == 0
        if inside or depth + (not closed) != 0:
            raise JsonError(f"invalid JSON in {file}: a string, list or object does not end")
        for r, state in zip(parts, states):
            found[file, r.start] = Entry(*state, level, prefix, r is parts[-1], closed)
    return found


def _cutter(known):
    """Second pass: records, fragments at the ends of a range, and what stands between records."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*made)) or [()] * 5
            types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string())
            names = ["file", "start", "level", "kind", "text"]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            made.clear()
            return out

        at, entry, held, seen = None, None, [], False
        inside, depth = False, 0

        def finish() -> None:
            """The end of a range: what is still open is a fragment, or the end of the file."""
            nonlocal held
            if at is None:
                return
            open_text = "".join(held)
            if entry.last and not entry.closed and open_text.endswith("}"):
                open_text = open_text[:-1]
            made.append((*at, entry.level, "tail" if seen else "middle", open_text))
            held = []

        for file, start, _, piece in _rows(batches):
            if (file, start) != at:
                finish()
                at, entry, seen = (file, start), known.value[file, start], False
                inside, depth = entry.inside, entry.depth
                if start == 0:  # behind the opening of the list
                    piece, depth, seen = piece[entry.prefix :], entry.level, True
                    held = [FIRST] if entry.level else []
            out, in_, odd = outside(piece)
            depth += change(in_ if inside else out)
            inside ^= odd
            held.append(piece + "}")
            if not inside:
                depth -= 1
                if depth == entry.level:
                    made.append((*at, entry.level, "whole" if seen else "head", "".join(held)))
                    held, seen = [], True
            if len(made) >= 5_000:
                yield batch()
        finish()
        yield batch()

    return cut


def cut_records(spark: SparkSession, path: str | Sequence[str], wrapper_keys: Sequence[str]) -> DataFrame:
    """One row for each record: file, level (0: no list around it) and text, one line each."""
    first = _pieces(spark, path).mapInArrow(
        _summaries, "file string, start long, turns boolean, d0 long, d1 long, n_pieces long, n_bytes long, head string, size long"
    )
    # one row for each byte range, as the scheduler holds them
    ranges = [Range(r.file, r.start, r.turns, (r.d0, r.d1), r.n_pieces, r.n_bytes, r.head, r.size) for r in first.collect()]
    known = spark.sparkContext.broadcast(entries(ranges, wrapper_keys))
    second = _pieces(spark, path).mapInArrow(_cutter(known), "file string, start long, level int, kind string, text string")
    cut = materialize(second)

    # fragments, at most two for each range: a tail begins a record that goes on in what follows
    order = F.when(F.col("kind") == "head", 0).when(F.col("kind") == "middle", 1).otherwise(2)
    begun = F.sum((F.col("kind") == "tail").cast("int")).over(Window.partitionBy("file").orderBy("start", order))
    fragments = cut.where("kind <> 'whole'").withColumn("number", begun).withColumn("order", order)
    parts = F.array_sort(F.collect_list(F.struct("start", "order", "text")))
    joined = fragments.groupBy("file", "level", "number").agg(parts.alias("parts"))
    last = F.col("number") == F.max("number").over(Window.partitionBy("file"))
    joined = joined.select("file", "level", F.array_join("parts.text", "").alias("text"), last.alias("last"))
    records = cut.where("kind = 'whole'").select("file", "level", "text")
    records = records.unionByName(joined.where("not last").select("file", "level", "text"))

    at, text = F.col("level"), F.col("text")
    begins = F.when(at == 0, text.rlike(r"^\s*\{")).otherwise(text.rlike(rf"^\s*[,{FIRST}]\s*\{{"))
    ends = F.when(at == 0, text.rlike(r"^\s*$")).when(at == 1, text.rlike(rf"^{FIRST}?\s*\]\s*$"))
    ends = ends.otherwise(text.rlike(rf'^{FIRST}?\s*\](?:[^\[\]{{}}"]|"[^"]*")*\}}\s*$'))
    wrong = records.where(~begins).select("file", "text")
    wrong = wrong.unionByName(joined.where(F.col("last") & ~ends).select("file", "text"))
    found = wrong.select("file", F.substring("text", 1, 80).alias("text")).first()
    if found and wrapper_keys and any(e.level == 2 for e in known.value.values()):
        return cut_records(spark, path, ())  # more than one list: such objects stay whole
    if found:
        raise JsonError(f"invalid JSON in {found['file']}: no record at {found['text'].strip(FIRST)!r}")
    line = F.regexp_replace(F.regexp_replace("text", rf"^[\s,{FIRST}]+", ""), r"[\r\n]+", " ")
    return records.select("file", "level", line.alias("text"))
