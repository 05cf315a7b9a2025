"""Exact duplicates by a persistent digest index, bucketed and sorted by digest.

The index is a Parquet table in a shared folder: one partition per delivery (``batch``), inside it ``buckets``
buckets, sorted by digest. ``add`` digests a delivery, groups it by digest (equal texts of one task become one
row before anything is shuffled), shuffles only those groups into the index's buckets, and takes out the known
ones by a sort-merge anti-join that reads the index where it lies, without shuffling it. What is left is appended
as the first rows of their texts; known texts are appended as rows that are not first, so that the index also
knows how often a text came and which row is the best one. ``verdicts`` sums that up by digest, again without
shuffling the index, and says for every row of every delivery which row of its text stays.

A delivery is staged before its partition is written, and adding it again replaces its partition: after a failure
the same call is repeated. Lost executors lose nothing, as all of it lies in the shared folder. ``open_index``
finds an index of an earlier session again.

Skew: a text with at least 1/HOT of all rows is one of at most HOT texts, and those are broadcast; the rest are
joined by digest. No step gathers the rows of a group.

Defined results: texts are equal if they are identical after deleting space, tab, line feed, vertical tab, form feed
and carriage return; null counts as empty, and all empty texts are equal. Of equal texts the row with the most code
points in the original text stays, then the smallest id (null last), then the first row of the earlier delivery by
name: exactly one, also of repeated rows. Very long texts are digested whole. An empty table adds nothing. Other
columns, whatever their names, come back unchanged.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .text import column, keep, whole

#: At most this many digests are broadcast: those that at least one row in HOT has.
HOT = 10_000

#: How the rows of a text are ranked; the smallest is the best.
_RANK = "struct<less: bigint, no_id: boolean, id: {}, batch: string, row: bigint>"


def normalised(text: Column) -> Column:
    """The text without any white space of the list."""
    return F.regexp_replace(whole(text), r"[\x20\x09-\x0D]+", "")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


@dataclass
class DigestIndex:
    """An index in ``path``; ``table`` is its name in this session, ``id_type`` the type of the document ids."""

    spark: SparkSession
    path: str
    table: str
    buckets: int
    id_type: str

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def members(self) -> DataFrame:
        """All rows of all deliveries, digests in place of texts."""
        return self.spark.read.option("basePath", f"{self.path}/members").parquet(f"{self.path}/members")


def open_index(spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None) -> DigestIndex:
    """The index in ``path``. If there is none, it is made for ids of ``id_type``, with ``buckets`` buckets (default: the
    session's shuffle partitions): the parallelism of later joins with it."""
    path = path.rstrip("/")
    try:
        id_type, buckets = spark.read.schema("id_type string, buckets int").parquet(f"{path}/settings").first()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        made = spark.range(1).select(F.lit(id_type).alias("id_type"), F.lit(buckets).alias("buckets"))
        made.write.parquet(f"{path}/settings")
    name = f"digest_index_{uuid.uuid4().hex}"
    place = f"{path}/entries".replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} (digest BINARY, first BOOLEAN, n_rows BIGINT, best {_RANK.format(id_type)}, batch STRING) "
        f"USING parquet PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
        f"LOCATION '{place}'"
    )
    spark.sql(f"INSERT INTO {name} SELECT * FROM {name} WHERE false")  # makes the folder
    spark.sql(f"MSCK REPAIR TABLE {name}")  # finds the deliveries that lie there
    return DigestIndex(spark, path, name, buckets, id_type)


def add(
    index: DigestIndex, docs: DataFrame, batch: str, key: str = "doc_id", text: str = "text", columns: list[str] | None = None
) -> DataFrame:
    """Add a delivery; returns its rows whose text is new to the index, one for each text, with ``columns``
    (default: all). Adding a delivery of the same name again replaces it."""
    columns = list(docs.columns) if columns is None else columns
    rows = docs.select(
        column(key).cast(index.id_type).alias("id"),
        digest(column(text)).alias("digest"),
        F.length(whole(column(text))).cast("bigint").alias("n_chars"),
        F.monotonically_increasing_id().alias("row"),
        *[column(c).alias(f"c{i}") for i, c in enumerate(columns)],
    )
    kept = keep(rows, "digest-rows")
    members = kept.select("id", "digest", "n_chars", "row", F.lit(batch).alias("batch"))
    members.drop("batch").write.mode("overwrite").parquet(f"{index.path}/members/batch={batch}")

    rank = F.struct(
        (-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "batch", "row"
    )
    groups = keep(members.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows"), F.min(rank).alias("best")), "digest-groups")
    known = index.entries().where(F.col("first") & (F.col("batch") != batch)).select("digest").hint("merge")
    parts = [
        groups.join(known, "digest", how).select("digest", F.lit(first).alias("first"), "n_rows", "best")
        for how, first in (("left_anti", True), ("left_semi", False))
    ]
    # staged first: a table that is read cannot be overwritten, not even in another partition
    staged = keep(parts[0].unionByName(parts[1]), "digest-staged")
    index.spark.sql(
        f"INSERT OVERWRITE TABLE {index.table} PARTITION (batch = '{batch}') SELECT digest, first, n_rows, best FROM {{staged}}",
        staged=staged.repartition(index.buckets, "digest"),  # one sorted file for each bucket
    )

    fresh = staged.where("first").select(F.col("best.row").alias("row"))
    found = kept.join(fresh, "row", "left_semi")
    return found.select(*[f"c{i}" for i in range(len(columns))]).toDF(*columns)


def verdicts(index: DigestIndex) -> DataFrame:
    """For every row of every delivery: id, batch, digest, n_chars, keep_id, group_size and kept."""
    totals = index.entries().groupBy("digest").agg(F.sum("n_rows").alias("group_size"), F.min("best").alias("best"))
    members = index.members().select("id", "digest", "n_chars", "row", F.col("batch").cast("string").alias("batch"))
    hot = F.col("group_size") * HOT >= members.count()  # at most HOT digests, whatever the table
    often = F.broadcast(totals.where(hot & (F.col("group_size") > 1)))
    rest = totals.where(~hot | (F.col("group_size") == 1)).hint("merge")
    joined = members.join(often, "digest").unionByName(
        members.join(often.select("digest"), "digest", "left_anti").join(rest, "digest")
    )
    kept = (F.col("best.batch") == F.col("batch")) & (F.col("best.row") == F.col("row"))
    return joined.select("id", "batch", "digest", "n_chars", F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept"))
