"""A corpus pipeline: rules, near duplicates, decontamination, personal data and the final mix, in this order."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkprep.llm import decontamination, mixing, near_duplicates, pii, quality_rules  # noqa: E402
from sparkprep.llm.text import column, keep, read  # noqa: E402


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or with as many underscores before it as it takes to be no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule of the table for a corpus."""
    measures, broken = free_name(docs, "_quality"), free_name(docs, "_broken")
    judged = quality_rules.apply_rules(docs, quality_rules.CORPUS_RULES, measures=measures, broken=broken)
    return judged.where(F.size(column(broken)) == 0).select(*map(column, docs.columns))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.without_near_duplicates(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows the new text."""
    redacted = pii.redact(docs, pii.fit(pii.detect(docs)))
    return redacted.withColumn("n_chars", F.length("text").cast("bigint"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and taken (words, repeats counted).

    A column of the documents that has one of these names keeps it; the mix's then gets an underscore before it.
    """
    into = free_name(docs, "_mix")
    told = [column(into)[c].alias(free_name(docs, c)) for c in ("size", "source_size", "target", "taken")]
    return mixing.mix(docs, into=into).where(column(into)["taken"] > 0).select(*map(column, docs.columns), *told)


STAGES = [
    ("quality rules", good_quality),
    ("near duplicates", one_of_each_group),
    ("benchmark decontamination", not_in_benchmark),
    ("personal data", without_personal_data),
    ("mixing", mixed),
]

#: SQL has no form for the MinHash join and the fitted span classifier; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read back, so no stage runs twice."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
