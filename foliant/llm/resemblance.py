"""The SimHash operator for texts of a given similarity: candidates by fingerprints, each verified exactly.

Two texts are linked if the Jaccard similarity of their sets of word shingles reaches
a threshold. Equal sets are merged first. Each set has a fingerprint of 256 bits. The
first 64 are probed by the generalised pigeonhole principle within ``TAU`` bits, and a
hit is joined only if the other 192 differ in at most ``MORE_TAU``, which hardly any
two unrelated texts do. Groups that these links connect are candidates: inside, texts
are compared shingle by shingle, so no link rests on a sketch. Of texts at similarity
0.8 about 15 % of the bits differ; a pair of which more than ``TAU`` of the 64 do is
found only if other links lead from one to the other.

Inside a group members are compared with a few centres and not with each other.
Members that are connected by then need no more comparison. Groups that still
hold several parts get more centres, without the first: those whose shingles are the
commonest in the group, as edits of one text are nearer to it than to each other.
Of those that are then left two are compared if they share a shingle that two
sets of their sizes must share to reach the threshold: the rarest of each, counted in
the group, and as many more as can be missing in the other (prefix filter). No pair
that reaches it is passed over, unless the two are connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialize, pick
from .components import connected_components, lookup
from .simhash import SEED, links, majority, shingle_hashes

#: Bits of 64 and of the further 192 in which texts of similarity 0.8 differ at most, but for a few in a hundred (of the 64) and next to none (of the 192).
TAU, MORE_TAU = 13, 54
MORE = ("more1", "more2", "more3")
#: Numbers of parts to choose from, and the cost of a compared pair next to that of a probed row.
PARTS, PAIR_COST = (4, 5, 6, 7, 8), 0.004
#: Centres of a group in the first two rounds.
CENTRES = (4, 16)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of the different shingles; none for texts without words."""
    return np.unique(shingle_hashes(text, shingle))


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """New bits for each hash: the finalizer of the generator SplitMix64, ``k`` steps on."""
    z = hashes + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def sketched(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``docs`` with a number ``_row`` for each row, ``_node`` of its shingle set and its
    fingerprint in ``_fp`` and ``_more1`` to ``_more3``; written, so that numbers stay."""
    names = ["_node", "_fp", *(f"_{c}" for c in MORE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column(text_col).to_pylist()]
            words = [[xxhash.xxh64_intdigest(s.tobytes(), SEED), majority(s), *(majority(mixed(s, k)) for k in (1, 2, 3))] for s in sets]
            columns = np.array(words, np.uint64).reshape(-1, len(names)).view(np.int64).T
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(np.ascontiguousarray(c)) for c in columns)], names=[*b.schema.names, *names])

    schema = StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in names)])
    return materialize(docs.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "sketches")


def verified(pairs: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """Those of ``pairs`` (``a, b``) whose shingle sets reach ``least``."""
    uses = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    wanted = materialize(texts.join(uses, "node"), "texts")
    for side, other in (("a", "b"), ("b", "a")):
        pairs = lookup(pairs, wanted.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"), "n"), side, other, "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            keep = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for node, text in ((a, ta), (b, tb)):
                    if node not in known:
                        known[node] = shingle_set(text, shingle)
                keep.append(jaccard(known[a], known[b]) >= least)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def shingles_of(members: DataFrame, texts: DataFrame, least: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """``key, node, central``: how many members of its group have a shingle of a member, on the
    average; and ``part, key, node, size, most`` for those of its rarest shingles that another has
    too: ``most`` is the size up to which a partner must share this shingle or a rarer one.

    Shingles are ordered by how many members of the group have them. Two sets of a
    Jaccard similarity of ``least`` share at least ``least / (1 + least)`` of the sum of
    their sizes, so that one of the shingles before the last so many is in both."""
    share = least / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = shingle_set(text, shingle).view(np.int64)
                same = (pa.array(np.full(len(tokens), x, np.int64)) for x in (key, node, len(tokens)))
                yield pa.RecordBatch.from_arrays([*same, pa.array(tokens)], names=["key", "node", "size", "token"])

    tokens = members.join(texts, "node").select("key", "node", "text").mapInArrow(run, "key bigint, node bigint, size bigint, token bigint")
    tokens = materialize(tokens, "tokens")
    ranked = tokens.join(tokens.groupBy("key", "token").agg(F.count("*").alias("n")).hint("merge"), ["key", "token"])
    central = materialize(ranked.groupBy("key", "node").agg(F.avg("n").alias("central")), "central")
    at = F.row_number().over(Window.partitionBy("key", "node").orderBy("n", "token"))
    most = F.floor((F.col("size") - at + 1) / F.lit(share) - F.col("size") + 1e-6)
    rare = ranked.withColumn("most", most).where((F.col("most") >= least * F.col("size") - 1e-6) & (F.col("n") > 1))
    return central, materialize(rare.select(F.xxhash64("key", "token").alias("part"), "key", "node", "size", "most"), "rare")


def sharing(members: DataFrame, rare: DataFrame) -> DataFrame:
    """``a, b``: pairs of unconnected members of a group that share a shingle that their sizes ask for."""
    kept = materialize(members.join(rare.hint("merge"), ["key", "node"]).select("part", "node", "root", "size", "most"), "shared")
    apart = kept.groupBy("part").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("size").alias("least")).where("lo != hi")
    kept = kept.join(apart.hint("merge"), "part").where("most >= least").select("part", "node", "root", "size", "most")
    one, two = (kept.select("part", *(F.col(c).alias(f"{c}{k}") for c in ("node", "root", "size", "most"))) for k in (1, 2))
    met = F.expr("node1 < node2 AND root1 != root2 AND size1 <= most2 AND size2 <= most1")
    return one.join(two.hint("merge"), (one["part"] == two["part"]) & met).select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct()


def resembling(members: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame | None:
    """``node, root`` of the sets that links connect, or None if there are none.
    ``members``: ``key`` of a group of candidates, ``node`` and ``root`` (at first the node)."""
    found_links = roots = compared = rare = None
    members = members.withColumn("central", F.lit(0.0))
    for centres in (*CENTRES, None):
        if not members.limit(1).count():
            break
        if centres is None:
            pairs = sharing(members, rare)
        else:
            first = members.withColumn("_k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("central"), "node"))).where(F.col("_k") <= centres)
            first = first.groupBy("key").agg(F.collect_list(F.struct(F.col("node").alias("c"), F.col("root").alias("r"))).alias("cs"))
            table = materialize(first.join(members.groupBy("key").agg(F.count("*").alias("n")).hint("merge"), "key"), "centres")
            met = lookup(members, table, "key", "node", "n")
            others = F.filter("cs", lambda x: (x.getField("c") != F.col("node")) & (x.getField("r") != F.col("root")))
            near = met.select("node", F.explode(others).alias("x"))
            pairs = near.select(F.least("node", "x.c").alias("a"), F.greatest("node", "x.c").alias("b")).distinct()
        pairs = materialize(pairs if compared is None else pairs.join(compared.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        compared = pairs if compared is None else compared.unionByName(pairs)
        found = materialize(verified(pairs, texts, least, shingle), "resembling")
        found_links = found if found_links is None else found_links.unionByName(found)
        roots = materialize(connected_components(found_links), "roots")
        if centres is None:
            break
        left = met.where(~F.exists("cs", lambda x: x.getField("c") == F.col("node"))).select("key", "node")
        named = materialize(left.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "named")
        # One that is alone beside the centres has met all others of its group; so have those that are one part.
        apart = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
        members = materialize(named.join(apart.hint("merge"), "key", "left_semi"), "members")
        if rare is None and members.limit(1).count():
            central, rare = shingles_of(members, texts, least, shingle)
            members = members.join(central.hint("merge"), ["key", "node"], "left")
    return roots


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each group that links
    of at least ``least`` connect: the one with the smallest id stays, null last.

    Rows are told apart by their place in the table, so null and repeated ids are
    rows like any other. Null and wordless texts have equal, empty sets: one stays.
    Very long texts are hashed whole. An empty table gives an empty result."""
    rows = sketched(docs, text_col, shingle)
    low = F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col("_row").alias("row"))
    sketch = [F.first(f"_{c}").alias(c) for c in ("fp", *MORE)]
    distinct = materialize(rows.groupBy(F.col("_node").alias("node")).agg(F.min(low).alias("low"), F.min("_row").alias("any"), *sketch), "distinct-sets")
    near = links(distinct, TAU, id_col="node", more=MORE, more_tau=MORE_TAU, choices=PARTS, pair_cost=PAIR_COST)
    members = materialize(connected_components(materialize(near, "near-links")).select(F.col("root").alias("key"), "node", F.col("node").alias("root")), "candidates")
    some = pick(distinct, ["node", "any"]).join(members.select("node"), "node", "left_semi").withColumnRenamed("any", "_row")
    texts = materialize(pick(rows, ["_row", text_col]).join(some, "_row").select("node", F.col(text_col).alias("text")), "candidate-texts")
    roots = resembling(members, texts, least, shingle)
    kept = distinct
    if roots is not None:
        kept = distinct.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("low").alias("low"))
    return rows.join(kept.select(F.col("low.row").alias("_row")), "_row", "left_semi").select(*docs.columns)
