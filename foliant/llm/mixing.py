"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key ``-ln(u) / weight`` with ``u`` from a hash of its id,
so that documents of higher quality tend to come first and reruns agree. A source
is taken in complete epochs as often as its target holds its size; what is left is
filled in key order, by a prefix sum of sizes, and the document in which the
target falls is taken in part. Keys are cut into ranges, so that the prefix sum of
a large source is a sum over its ranges plus one inside a range. The cuts follow the
distribution of the source's keys, which its weights give: a key exceeds k with
probability ``exp(-k * weight)``, so ranges hold about equally many rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, materialize, pick, small

WEIGHTS = (3.0, 1.0, 2.0)
#: Rows that a key range holds on average.
RANGE_ROWS = 4_000
#: Words by which sizes are counted together for the distribution of weights, and the largest number of such classes.
CLASS_WORDS, CLASSES = 25, 61


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACES}]+")).cast("bigint")


def quality_weight(size: Column) -> Column:
    """Longer documents weigh more, up to four times as much as the shortest."""
    return F.lit(1.0) + F.least(size, F.lit(1500)) / F.lit(500.0)


def uniform(id_col: Column) -> Column:
    """A number in (0, 1) from the md5 of the id as text; null counts as the text ''."""
    hexed = F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / float(16**12)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources by code point, null last, weigh ``weights`` in turn. Targets share
    ``share`` times all sizes by weight, stop at ``most`` times their source's size,
    and the excess is shared again by weight among the rest: the sources that stop
    are those with the least size for their weight, so one sorted pass finds them.
    One row for each source: the windows run over that table only."""
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.col("_k") - 1, F.lit(len(weights))) + 1).cast("int"))
    ordered = sizes.withColumn("_k", F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last()))).withColumn("_w", w)
    ordered = ordered.withColumn("_cap", most * F.col("source_size")).withColumn("_full", F.col("_cap") / F.col("_w"))
    up = Window.orderBy("_full", "_k")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    rest_w = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    rest = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = ordered.withColumn("_level", rest / rest_w)
    # The first source that the level doesn't fill sets the level for all after it.
    settled = level.withColumn("_stop", F.min(F.when(F.col("_full") > F.col("_level"), F.struct("_full", "_k", "_level"))).over(everything))
    target = F.when(F.col("_stop").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.col("_stop._level")))
    return settled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """For every row of ``docs``: id, its size in words, its source's size and
    target, and ``taken``, the words that the mix takes of it, repeats counted.

    Null texts have size 0 and nothing is taken of them; a null source is a source
    of its own. Ties of keys are broken by id, then size, so rows that repeat may
    swap but the result is the same; a column ``row_col`` that tells them apart
    breaks ties last and is carried along. Rows of one id have one ``u``, so very many
    of them, or of null ids, fall in one range. Very long texts are counted whole. An
    empty table gives an empty result."""
    row = [] if row_col is None else [row_col]
    rows = pick(docs, [id_col, text_col, source_col, *row]).select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *row)
    rows = materialize(rows, "mix-sizes")
    classes = rows.groupBy("source", F.least(F.floor(F.col("size") / CLASS_WORDS), F.lit(CLASSES - 1)).cast("int").alias("_c")).agg(F.sum("size").alias("_size"), F.count("*").alias("_n"))
    shape = F.sort_array(F.collect_list(F.struct((quality_weight(F.col("_c") * CLASS_WORDS + CLASS_WORDS / 2)).alias("w"), F.col("_n").cast("double").alias("n"))))
    sizes = materialize(classes.groupBy("source").agg(F.sum("_size").alias("source_size"), F.sum("_n").alias("_n"), shape.alias("_shape")), "mix-sources")
    targets = materialize(source_targets(sizes.select("source", "source_size"), weights, share, most).withColumnRenamed("source", "_source"), "mix-targets")
    shapes = small(sizes.select(F.col("source").alias("_of"), "_n", "_shape"))
    keyed = rows.withColumn("_key", -F.log(uniform(F.col("_id"))) / quality_weight(F.col("size")))
    above = F.aggregate("_shape", F.lit(0.0), lambda total, x: total + x.n * F.exp(-F.col("_key") * x.w))
    keyed = keyed.join(shapes, F.col("source").eqNullSafe(F.col("_of"))).withColumn("_range", F.floor((F.col("_n") - above) / RANGE_ROWS).cast("int")).drop("_of", "_n", "_shape")
    sums = keyed.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("source", "_range").orderBy("_key", F.col("_id").asc_nulls_last(), "size", *row).rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    keyed = keyed.join(small(materialize(offsets, "mix-offsets")), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    keyed = keyed.join(small(targets), F.col("source").eqNullSafe(F.col("_source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.floor(F.col("target") - epochs * F.col("source_size")) - F.col("_offset") - F.col("_before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return keyed.select(F.col("_id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("bigint").alias("taken"), *row)


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` of which words are taken, with ``taken`` and ``copies``,
    how often the whole text is taken; the rest of ``taken`` is the text's start.
    Rows are numbered first, so null and repeated ids are rows like any other."""
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    plan = mix(rows, **settings, row_col="_row").where("taken > 0").select("_row", F.col("size").alias("_size"), "taken")
    return rows.join(plan, "_row").select(*docs.columns, "taken", F.floor(F.col("taken") / F.col("_size")).cast("int").alias("copies"))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
k AS (SELECT *, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE)
    / (1.0::DOUBLE + least(size, 1500) / 500.0::DOUBLE) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
o AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS filled FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER up, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0)) AS level
    FROM o WINDOW up AS (ORDER BY filled, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min_by(level, filled) AS level FROM l WHERE filled > level),
t AS (SELECT l.source, l.source_size, least(cap, coalesce(weight * f.level, cap)) AS target FROM l LEFT JOIN f ON true),
p AS (SELECT k.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
    CAST(epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - before)) AS BIGINT) AS taken FROM p"""
