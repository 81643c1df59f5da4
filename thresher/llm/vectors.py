"""What the two vector operators share: usable rows of an embeddings table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, finite in every component, not all zero."""
    limit = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def clean(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, vector``: one usable vector per id.

    Rows without an id take no part. Of several vectors of one id the smallest counts.
    Only vectors of the most frequent length (the shorter, if even) can be compared.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vector"))
    rows = rows.filter("vec_id is not null").filter(usable("vector"))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = lengths["n"] if lengths else 0
    return rows.filter(F.size("vector") == width).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def sample(rows: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of ``limit`` rows by a hash of the id: the stated bound of a fit."""
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(limit).select("vec_id", "vector").toPandas()
    return drawn["vec_id"].to_numpy(), np.stack(drawn["vector"].to_numpy()).astype(float)
