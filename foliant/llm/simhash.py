"""Near-duplicates by SimHash fingerprints and the generalised pigeonhole principle.

The 64 bits are grouped into parts, correlated bits together, so that the
entropy of the parts differs. If two fingerprints differ in at most ``tau`` bits
and the parts have thresholds that sum to ``tau - parts + 1``, then some part
differs in no more bits than its own threshold; a threshold of -1 leaves a part
out. Dynamic programming chooses the thresholds, and the number of parts, by the
work they are expected to cause: rows probed plus candidate pairs, estimated
from the number of equal keys over all fingerprints. The choice changes the work
only; every choice finds every link.

A fingerprint is stored under its key in each part that is used and probes the
smaller keys within the part's threshold. Buckets are sorted runs that one task
reads in a stream; inside, distances are computed block-wise and a union-find
keeps one link for each merge, so a dense group gives as many rows as it has
fingerprints and not one for each pair. Rows can carry further bits of a wider
fingerprint, by which a probe's hits are verified before they are joined. Buckets beyond ``block`` rows are split
into blocks that different tasks compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick
from .components import connected_components, lookup

BITS = 64
SEED = 42
#: Shingles hashed at once: bounds the memory that a very long text takes.
CHUNK = 200_000
#: Cells of one block of distances.
CELLS = 4_000_000
#: Cost of a compared pair next to that of a probed row.
PAIR_COST = 0.02


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of the ``shingle``-word shingles of the lower-cased (A-Z) words, split at
    ASCII white space, with repeats. Fewer words are one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, digest, n = b" ".join(words), xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts, ends = np.r_[0, ends[: n - 1] + 1], ends[-n:]
    found = np.empty(n, np.uint64)
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        found[at : at + CHUNK] = [digest(line[a:b], SEED) for a, b in spans]
    return found


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << int(j) for j in np.nonzero(2 * ones > len(hashes))[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """SimHash of the shingles of ``text``; 0 for null and for texts without words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``id_col, fp`` for every row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    slim = pick(docs, [id_col, text_col])
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[id_col].dataType.simpleString()}, fp bigint")


def bit_counts(distinct: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints in which both bits are set, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(v, axis=1, bitorder="little").astype(np.float32)
            total += np.rint(x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "n"])

    out = np.zeros(BITS * BITS, np.int64)
    for cell, n in distinct.select("fp").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out.reshape(BITS, BITS)


def group_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups: each starts with the most skewed free bit and
    takes the free bits most correlated with those it has."""
    mean = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        group = [max(free, key=lambda j: (abs(mean[j] - 0.5), -j))]
        free.remove(group[0])
        while len(group) < width:
            best = max(free, key=lambda j: (corr[j, group].sum(), -j))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def part_key(bits: list[int]) -> F.Column:
    """The chosen bits of ``fp``, packed in their order: runs of neighbours move together."""
    pieces, to, k = [], 0, 0
    while k < len(bits):
        run = 1
        while k + run < len(bits) and bits[k + run] == bits[k] + run:
            run += 1
        pieces.append(f"shiftleft(shiftrightunsigned(fp, {bits[k]}) & {(1 << run) - 1}L, {to})")
        to, k = to + run, k + run
    return F.expr(" | ".join(pieces))


def probe_masks(width: int, threshold: int) -> list[int]:
    return [sum(1 << j for j in c) for t in range(1, threshold + 1) for c in combinations(range(width), t)]


def smaller_keys(key: F.Column, masks: list[int]) -> F.Column:
    """``key`` and those of its neighbours that are smaller: of two fingerprints
    whose keys differ, the one with the larger key probes the other's."""
    near = F.transform(F.expr(f"array({', '.join(f'{m}L' for m in [0, *masks])})"), lambda m: key.bitwiseXOR(m))
    return F.filter(near, lambda k: k <= key)


def allocate(cost: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds, -1 or more, that sum to ``budget`` at the least total cost.
    ``cost[i][t + 1]`` is that of threshold ``t`` in part ``i``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (c, chosen) in best.items():
            for t, more in enumerate(row, -1):
                if total + t not in step or c + more < step[total + t][0]:
                    step[total + t] = (c + more, [*chosen, t])
        best = step
    return best[budget]


def plan(distinct: DataFrame, tau: int, choices: tuple[int, ...] = (3, 4, 5), pair_cost: float = PAIR_COST) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and their thresholds, by counts over all distinct fingerprints."""
    n = distinct.count()
    both = bit_counts(distinct)
    options = {m: group_bits(both, n, m) for m in choices if m <= tau + 1}
    slots = [(m, i) for m, groups in options.items() for i in range(len(groups))]
    keys = F.array(*(F.struct(F.lit(k).alias("slot"), part_key(options[m][i]).alias("key")) for k, (m, i) in enumerate(slots)))
    same = dict(
        distinct.select(F.explode(keys).alias("x")).groupBy("x.slot", "x.key").agg(F.count("*").alias("c"))
        .groupBy("slot").agg(F.sum(F.col("c") * (F.col("c") - 1.0) / 2)).collect()
    )
    mean = np.diag(both) / max(n, 1)
    differ = np.clip(2 * mean * (1 - mean), 1e-9, 0.5)
    best = None
    for m, groups in options.items():
        cost = []
        for i, bits in enumerate(groups):
            near = [1.0] + [0.0] * tau
            for p in differ[bits]:
                near = [near[t] * (1 - p) + (near[t - 1] * p if t else 0.0) for t in range(tau + 1)]
            row = [0.0]
            for t in range(tau + 1):
                rows = n * (1 + sum(comb(len(bits), j) for j in range(1, t + 1)) / 2)
                row.append(rows + pair_cost * same.get(slots.index((m, i)), 0.0) * sum(near[: t + 1]) / near[0])
            cost.append(row)
        found = allocate(cost, tau - m + 1)
        if best is None or found[0] < best[0]:
            best = (found[0], groups, found[1])
    return best[1], best[2]


class Forest:
    """Union-find over positions; keeps the pairs that joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.kept: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.kept.append((a, b))


def bucket_links(fps: np.ndarray, members: int, tau: int, more: np.ndarray | None = None, more_tau: int = 0) -> list[tuple[int, int]]:
    """Positions of links that connect all that is linked: every pair of a member
    (the first ``members`` of ``fps``) and any other is compared, or skipped only
    because the two are connected already. With ``more``, further bits of each, a
    link differs in at most ``more_tau`` of those too."""
    forest, n = Forest(len(fps)), len(fps)
    if more is None and 3 * tau < BITS // 2 and members * n > CELLS:
        return ball_links(fps, members, tau, forest)
    label, at, step = np.arange(n), 0, 8
    while at < members:
        step = max(1, min(2 * step, CELLS // n))
        a, b = np.nonzero(np.bitwise_count(fps[at : min(members, at + step), None] ^ fps[None, :]) <= tau)
        a += at
        at += step
        new = (a < b) & (label[a] != label[b])
        a, b = a[new], b[new]
        if more is not None and len(a):
            near = np.bitwise_count(more[a] ^ more[b]).sum(1, dtype=np.int64) <= more_tau
            a, b = a[near], b[near]
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            forest.join(x, y)
        if len(a):
            old = np.unique(np.r_[label[a], label[b]])
            to = np.arange(n)
            to[old] = [forest.root(x) for x in old.tolist()]
            label = to[label]
    return forest.kept


def ball_links(fps: np.ndarray, members: int, tau: int, forest: Forest) -> list[tuple[int, int]]:
    """``bucket_links`` for large buckets and narrow ``tau``, by pivots: what lies
    within tau of a pivot is linked to it. Two members of different balls link only
    if their pivots are within 3 * tau."""
    n = len(fps)
    ball = np.full(n, -1, np.int64)
    pivots: list[int] = []
    for x in range(members):
        if ball[x] >= 0:
            continue
        near = np.bitwise_count(fps ^ fps[x]) <= tau
        for y in np.nonzero(near)[0].tolist():
            forest.join(x, y)
        ball[near & (ball < 0)] = len(pivots)
        pivots.append(x)
    groups = [np.nonzero(ball == k)[0] for k in range(len(pivots))]
    loose = np.nonzero(ball < 0)[0]
    for k, p in enumerate(pivots):
        mine = groups[k][groups[k] < members]
        reach = np.bitwise_count(fps[pivots] ^ fps[p]) <= 3 * tau
        others = [groups[j] for j in np.nonzero(reach)[0] if j != k and forest.root(pivots[j]) != forest.root(p)]
        for other in (*others, loose[np.bitwise_count(fps[loose] ^ fps[p]) <= 2 * tau]):
            step = max(1, CELLS // max(1, len(other)))
            for at in range(0, len(mine), step):
                rows = mine[at : at + step]
                a, b = np.nonzero(np.bitwise_count(fps[rows, None] ^ fps[None, other]) <= tau)
                for x, y in zip(rows[a].tolist(), other[b].tolist(), strict=True):
                    forest.join(x, y)
    return forest.kept


def links(
    distinct: DataFrame, tau: int = 4, block: int = 100_000, id_col: str = "fp", more: tuple[str, ...] = (), more_tau: int = 0,
    choices: tuple[int, ...] = (3, 4, 5), pair_cost: float = PAIR_COST,
) -> DataFrame:
    """``a, b``: pairs of ``id_col`` whose fingerprints ``fp`` are within ``tau`` bits,
    and within ``more_tau`` over the further words ``more``, enough of them to
    connect all that any such pairs connect."""
    groups, thresholds = plan(distinct, tau, choices, pair_cost)
    rows = []
    for part, (bits, t) in enumerate(zip(groups, thresholds, strict=True)):
        if t < 0:
            continue
        key = part_key(bits)
        rows.append((part, key, smaller_keys(key, probe_masks(len(bits), t))))
    if not rows:
        raise ValueError("no part in use")
    carried = list(dict.fromkeys(["fp", id_col, *more]))
    found = None
    for part, key, all_keys in rows:
        one = distinct.select(*carried, F.lit(part).cast("tinyint").alias("part"), key.alias("own"), F.explode(all_keys).alias("key"))
        one = one.select("part", "key", (F.col("key") != F.col("own")).alias("probe"), *carried)
        found = one if found is None else found.unionByName(one)
    sizes = found.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    big = materialize(sizes.select("part", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "big-buckets")
    if big.limit(1).count():
        found = found.join(big, ["part", "key"], "left").fillna(1, ["blocks"])
        home = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        found = found.withColumn("home", home).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        found = found.where("probe or block >= home").select("part", "key", "block", (F.col("probe") | (F.col("block") != F.col("home"))).alias("probe"), *carried)
        order = ["part", "key", "block"]
    else:
        order = ["part", "key"]
    found = found.select(*order, "probe", *carried).repartition(*order).sortWithinPartitions(*order, "probe")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            last = [c[b.num_rows - 1].as_py() for c in b.columns[: len(order)]]
            first = [c[0].as_py() for c in b.columns[: len(order)]]
            held.append(b)
            if first == last and len(held) > 1 and [c[0].as_py() for c in held[0].columns[: len(order)]] == first:
                continue  # one bucket fills all that is held
            table = pa.Table.from_batches(held).combine_chunks()
            ids = [c.to_numpy() for c in table.columns[: len(order)]]
            cut = np.nonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in ids]))[0] + 1
            done = int(cut[-1]) if len(cut) else 0
            yield from runs(table.slice(0, done), cut[:-1])
            held = table.slice(done).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = [c.to_numpy() for c in table.columns[: len(order)]]
            yield from runs(table, np.nonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in ids]))[0] + 1)

    def runs(table: pa.Table, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        starts, ends = np.r_[0, cut], np.r_[cut, table.num_rows]
        probe = table.column("probe").to_numpy()
        use = (ends - starts > 1) & ~probe[starts]  # probes come after the members of their bucket
        fps, ids = table.column("fp").to_numpy().view(np.uint64), table.column(id_col).to_numpy()
        rest = np.stack([table.column(c).to_numpy().view(np.uint64) for c in more], 1) if more else None
        a, b = [], []
        for s, e in zip(starts[use].tolist(), ends[use].tolist(), strict=True):
            for x, y in bucket_links(fps[s:e], int((~probe[s:e]).sum()), tau, None if rest is None else rest[s:e], more_tau):
                a.append(ids[s + x])
                b.append(ids[s + y])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in (a, b)], names=["a", "b"])

    return found.mapInArrow(scan, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, tau: int = 4, block: int = 100_000) -> DataFrame:
    """One row for each row of ``docs``: id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id that links of at most ``tau`` bits reach.

    Null and wordless texts have fingerprint zero and link like any other.
    Repeated rows give repeated rows. A null id gets a component like any other
    but never names one, unless all ids there are null (then it is null). Other
    columns are not looked at. An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("copies")), "distinct-fingerprints")
    roots = connected_components(materialize(links(distinct, tau, block), "near-links"))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "copies", "low", F.coalesce("root", "fp").alias("root"))
    low = materialize(named.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "component-ids")
    table = materialize(lookup(named, low, "root", "fp", "n").select("fp", "copies", "component_id"), "components")
    return lookup(fps, table, "fp", id_col, "copies").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
