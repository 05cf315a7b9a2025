"""Feature vectors."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sparkprep import embed_text, one_hot, standardize, vector_info, vectorize, read_vectors, write_vectors
from sparkprep.operators.vectors import vector_entries, vector_width

from .registry import query


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, coalesce(l_quantity, (SELECT quantile_cont(l_quantity, 0.5) FROM {dirty_lineitem})) AS l_quantity,
  l_extendedprice FROM {dirty_lineitem})
SELECT l_orderkey, l_linenumber,
  round((l_quantity - (SELECT avg(l_quantity) FROM f)) / (SELECT stddev_pop(l_quantity) FROM f), 6)::DOUBLE + 0.0 AS l_quantity_normalized,
  round((l_extendedprice - (SELECT avg(l_extendedprice) FROM f)) / (SELECT stddev_pop(l_extendedprice) FROM f), 6)::DOUBLE + 0.0 AS l_extendedprice_normalized
FROM f""")
def standardize_numbers(t):
    scaled = standardize(t.dirty_lineitem, ["l_quantity", "l_extendedprice"])
    names = ["l_quantity_normalized", "l_extendedprice_normalized"]
    # Adding zero turns a negative zero into zero.
    return scaled.select("l_orderkey", "l_linenumber", *[(F.round(c, 6) + 0.0).alias(c) for c in names])


@query("""
SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS event_type_error, CAST(event_type = 'purchase' AS INTEGER) AS event_type_purchase,
  CAST(event_type = 'signup' AS INTEGER) AS event_type_signup, CAST(event_type = 'view' AS INTEGER) AS event_type_view FROM events""")
def one_hot_columns(t):
    return one_hot(t.events.select("event_id", "event_type"), "event_type").drop("event_type")


# Java and RE2 agree on letters, marks, digits and connectors as word characters.
WORDS = r"len(regexp_extract_all(lower({c}), '[\pL\pM\pN_][\pL\pM\pN_]+'))"


@query(f"""
SELECT doc_id, CAST(512 AS INTEGER) AS width, CASE WHEN {WORDS.format(c='text')} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm,
  true AS non_negative FROM documents""")
def embed_documents(t):
    """Whole texts become vectors of length 1, or the zero vector when there is no word."""
    values = vector_to_array(F.col("emb"))
    square = F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x)
    return embed_text(t.documents, "text", output="emb").select(
        "doc_id",
        F.size(values).alias("width"),
        F.round(F.sqrt(square), 6).alias("norm"),
        (F.array_min(values) >= 0).alias("non_negative"),
    )


@query("""
SELECT count(*) AS texts, count(DISTINCT md5(text)) AS distinct_texts, true AS same_vectors FROM documents""")
def embed_copies(t):
    """Equal texts have equal vectors."""
    embedded = embed_text(t.documents, "text", output="emb").select(
        "text", F.xxhash64(vector_to_array("emb")).alias("print")
    )
    per_text = embedded.groupBy("text").agg(
        F.count(F.lit(1)).alias("n"), (F.min("print") == F.max("print")).alias("same")
    )
    return per_text.agg(
        F.sum("n").alias("texts"), F.count(F.lit(1)).alias("distinct_texts"), F.bool_and("same").alias("same_vectors")
    )


SMALL = ["p_size", "p_type", "p_retailprice"]


@query("""
SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6)::DOUBLE + 0.0 AS size,
  round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6)::DOUBLE + 0.0 AS price,
  CAST(CASE WHEN p_type = (SELECT min(p_type) FROM part) THEN 0 ELSE 1 END AS DOUBLE) AS hot,
  CAST((SELECT count(DISTINCT p_type) - 1 FROM part) + 2 AS INTEGER) AS width FROM part""")
def vectorize_numeric(t):
    """Numbers scaled, a small category one-hot, all in one vector in column order."""
    vectors, _ = vectorize(t.part, "numeric", SMALL)
    cells = vector_to_array("features")
    size = F.size(cells)
    middle = F.slice(cells, F.lit(2), size - 2)
    return vectors.select(
        "p_partkey",
        (F.round(cells[0], 6) + 0.0).alias("size"),
        (F.round(F.element_at(cells, -1), 6) + 0.0).alias("price"),
        F.aggregate(middle, F.lit(0.0), lambda s, x: s + x).alias("hot"),
        size.alias("width"),
    )


@query("""
SELECT l_orderkey, l_linenumber, CAST(is_bulk AS DOUBLE) AS flag, CAST(512 + 2 AS INTEGER) AS width,
  2.0::DOUBLE - 1.0 + 0.0 AS text_norm FROM {flagged_lineitem}""")
def vectorize_hybrid(t):
    """A number, a boolean and an embedded text column."""
    lines = t.flagged_lineitem.withColumn("note", F.concat(F.lit("order "), F.col("l_orderkey").cast("string")))
    vectors, _ = vectorize(lines, "hybrid", ["l_quantity", "is_bulk", "note"])
    vectors = vectors.select("l_orderkey", "l_linenumber", vector_entries(F.col("features")).alias("cells"), vector_width(F.col("features")).alias("width"))
    added = lambda chosen, value: F.aggregate(
        "cells", F.lit(0.0), lambda s, cell: s + F.when(chosen(cell["place"]), value(cell["value"])).otherwise(0.0)
    )
    square = added(lambda place: place >= 2, lambda x: x * x)
    return vectors.select(
        "l_orderkey", "l_linenumber", added(lambda place: place == 1, lambda x: x).alias("flag"), "width",
        F.round(F.sqrt(square), 6).alias("text_norm"),
    )


@query("SELECT p_partkey, CAST(1024 AS INTEGER) AS width FROM part")
def vectorize_text_only(t):
    """Every column is embedded as text."""
    vectors, _ = vectorize(t.part, "text_only", ["p_name", "p_size"])
    return vectors.select("p_partkey", F.size(vector_to_array("features")).alias("width"))


@query("""
SELECT 'p_size' AS column, 'numeric' AS type, CAST(0 AS INTEGER) AS first_feature, CAST(1 AS INTEGER) AS n_features,
  round(avg(p_size), 6)::DOUBLE AS mean, round(stddev_pop(p_size), 6)::DOUBLE AS std, count(*) AS n_samples FROM part
UNION ALL SELECT 'p_name', 'text_embedded', 1, 512, NULL, NULL, count(*) FROM part
UNION ALL SELECT 'p_type', 'categorical_encoded', 513, CAST(count(DISTINCT p_type) - 1 AS INTEGER), NULL, NULL, count(*) FROM part""")
def vector_columns(t):
    """More than ten categories are embedded, fewer are one-hot."""
    _, meta = vectorize(t.part, "numeric", ["p_size", "p_name", "p_type"])
    return meta.select(
        "column", "type", "first_feature", "n_features", F.round("mean", 6).alias("mean"),
        F.round("std", 6).alias("std"), "n_samples",
    )


@query("""
SELECT count(*) AS n_samples, CAST(1 + 512 AS BIGINT) AS n_features, 'hybrid' AS method,
  'p_size_normalized,p_brand_emb_0,p_brand_emb_1' AS first_names FROM part""")
def vector_description(t):
    """Written vectors describe themselves; nothing is fitted again."""
    vectors, meta = vectorize(t.part, "hybrid", ["p_size", "p_brand"])
    write_vectors(vectors, meta, f"{t.scratch}/vectors")
    stored, stored_meta = read_vectors(t.spark, f"{t.scratch}/vectors")
    info = vector_info(stored_meta, 3)
    return info.select(
        "n_samples", "n_features", "method", F.array_join("feature_names", ",").alias("first_names")
    )
