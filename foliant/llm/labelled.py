"""Training rows: a bounded, repeatable sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for the third of the ids that no model learns from; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_labels(labels: DataFrame, label: str, limit: int, id_col: str = "doc_id") -> DataFrame:
    """``id_col, y``: of each class at most ``limit`` ids that may be learned from,
    those whose ids hash lowest. Null ids and labels are left out; an id with
    several labels counts as 1 if any is. At most ``2 * limit`` rows: safe to broadcast."""
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col))
        .groupBy(id_col)
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(limit) for y in (0, 1)]
    return parts[0].unionByName(parts[1])
