from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from sparkprep.operators.vectors import vector_entries, vector_width


def test_stored_cells_of_sparse_and_dense_vectors(spark):
    """A sparse vector gives what it stores, not its width."""
    rows = [(1, Vectors.sparse(514, [1, 40], [1.0, 0.5])), (2, Vectors.dense([0.0, 3.0])), (3, Vectors.sparse(5, [], []))]
    df = spark.createDataFrame(rows, ["id", "v"]).orderBy("id")
    got = df.select(vector_width(F.col("v")), vector_entries(F.col("v"))).collect()
    assert [(width, [tuple(cell) for cell in cells]) for width, cells in got] == [
        (514, [(1, 1.0), (40, 0.5)]), (2, [(0, 0.0), (1, 3.0)]), (5, []),
    ]
