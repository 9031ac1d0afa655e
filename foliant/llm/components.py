"""Connected components of a table of links, and joins to lookup tables with hot keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def thinned(links: DataFrame, most: int = 500_000) -> DataFrame:
    """Other links (columns as in ``links``, the larger node first) that connect the same nodes,
    and no more of them in a task than it meets nodes: each node is linked to the smallest one
    that the links of its task lead to. After ``most`` nodes a task starts anew, which bounds its memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        def stars(schema: pa.Schema) -> pa.RecordBatch:
            nodes = [x for x, above in up.items() if above != x]
            return pa.RecordBatch.from_arrays([pa.array(c, schema.types[0]) for c in (nodes, [root(x) for x in nodes])], names=schema.names)

        for b in batches:
            for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y = root(x), root(y)
                up[max(x, y)] = min(x, y)
            if len(up) > most:
                yield stars(b.schema)
                up.clear()
        if up:
            yield stars(b.schema)

    return links.mapInArrow(run, links.schema)


def connected_components(links: DataFrame, max_rounds: int = 60, one_task: int = 200_000) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b`` of one orderable type);
    ``root`` is the smallest node of its component.

    Links are thinned where they are, so that a dense group whose links many tasks
    found comes down to about a link for each node. Up to ``one_task`` links are then
    settled by one task, without a shuffle. More are settled by alternating large-star
    and small-star rounds: every step is a minimum per node with map-side combine and a
    join back to the links, so no larger component is ever gathered in one task.
    Links with a null end and loops are ignored. Links that Python makes should be written
    before: in one stage with the thinning they would hold two Python workers for each task.
    Each round is written to the shared folder, which also ends its lineage.
    """
    pairs = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    pairs = materialize(thinned(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).distinct(), "links")
    before = None
    for _ in range(max_rounds + 1):
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        if now[0] <= one_task:
            pairs = materialize(thinned(pairs.coalesce(1), 2 * one_task), "links")
            break
        before = now
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted(large, low).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def salted(pairs: DataFrame, low: DataFrame, salts: int = 16) -> DataFrame:
    """``pairs`` joined to ``low`` on ``u``, which may be the centre of a large star: its
    pairs are dealt over ``salts`` parts by ``v``, the row of ``low`` is copied to each."""
    copies = low.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return pairs.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(copies, ["u", "_salt"]).drop("_salt")


def lookup(rows: DataFrame, table: DataFrame, key: str, spread: str, weight: str, salts: int = 32, hot_keys: int = 10_000) -> DataFrame:
    """``rows`` left-joined to ``table`` (one row for each ``key``) where a few keys hold most rows.

    ``weight`` is the column of ``table`` with the number of rows of its key. A
    key is hot beyond ``total / hot_keys`` rows, so that at most ``hot_keys`` of
    them exist, which is what is broadcast. Rows of hot keys are dealt over
    ``salts`` parts by the hash of ``spread``; their table row is copied to each.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    limit = max(1_000, total // hot_keys)
    hot = table.where(F.col(weight) > limit).select(F.col(key).alias("_hot"))
    table = table.withColumn("_salt", F.explode(F.when(F.col(weight) > limit, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    )
    return rows.drop("_hot").join(table.drop(weight), [key, "_salt"], "left").drop("_salt")
