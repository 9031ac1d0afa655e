import numpy as np
import pytest
import xxhash

from foliant.llm import simhash
from foliant.llm.components import connected_components


def plain(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    if not words:
        return 0
    pieces = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = [plain(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
    ids = {}
    for (i, _), g in zip(rows, group):
        ids[g] = min([x for x in (ids.get(g), i) if x is not None], default=None)
    return sorted(((i, f"{f:016x}", ids[g]) for (i, _), f, g in zip(rows, fps, group)), key=str)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{rng.integers(500)}" for _ in range(200)) for _ in range(6)]
    rows = [(None, None), (1, ""), (2, " \t\n"), (3, "Ä B"), (3, "Ä B"), (4, "one TWO three"), (None, "x y"), (5, "a b c d e")]
    for k in range(60):
        words = base[k % 6].split()
        words[int(rng.integers(200))] = "new"
        rows.append((100 - k, " ".join(words)))
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id int, text string, fp int, low string"))
    assert sorted(map(tuple, got.collect()), key=str) == plain_components(rows)


@pytest.mark.parametrize("block", [100_000, 20])
def test_dense_groups_and_split_buckets(spark, block):
    rng = np.random.default_rng(2)
    fps = set()
    for c in rng.integers(0, 2**63, 8):
        fps.add(int(c))
        for _ in range(80):
            x = int(c)
            for j in rng.integers(0, 64, rng.integers(1, 7)):
                x ^= 1 << int(j)
            fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    roots = dict(map(tuple, connected_components(simhash.links(df, 4, block)).collect()))
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None]) <= 4
    seen, want = {}, 0
    for i in range(len(a)):
        if i in seen:
            continue
        todo, seen[i] = [i], i
        while todo:
            for j in np.nonzero(near[todo.pop()])[0].tolist():
                if j not in seen:
                    seen[j] = i
                    todo.append(j)
    pairs = {(seen[i], roots.get(signed[i], signed[i])) for i in range(len(a))}
    assert len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


def test_pivots_agree_with_all_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    c = rng.integers(0, 2**63, 3).astype(np.uint64)
    fps = np.unique(np.concatenate([c[k % 3] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64), keepdims=True) for k in range(300)]))
    rng.shuffle(fps)

    def parts(kept):
        f = simhash.Forest(len(fps))
        for x, y in kept:
            f.join(x, y)
        return [f.root(x) for x in range(len(fps))]

    full = parts(simhash.bucket_links(fps, len(fps), 4))
    monkeypatch.setattr(simhash, "CELLS", 50)
    assert parts(simhash.bucket_links(fps, len(fps), 4)) == full


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_thresholds():
    assert simhash.allocate([[0, 1, 5, 9, 20], [0, 1, 2, 9, 20], [0, 8, 9, 10, 20]], 2)[1] in ([1, 1, 0], [2, 1, -1])
    assert len(simhash.probe_masks(21, 2)) == 21 + 210
