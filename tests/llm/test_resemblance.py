import random

import numpy as np

import corpus_pipeline
from foliant.llm import resemblance, simhash
from foliant.llm.components import connected_components


def plain_set(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_firsts(rows):
    """Numbers of the rows that stay, by comparing each with each."""
    sets, group = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or both and both / len(sets[i] | sets[j]) >= 0.8:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted((min((rows[i][0] is None, rows[i][0] or 0) for i in range(len(rows)) if group[i] == g) for g in set(group)))


def edited(words, n, rng):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_stage_keeps_one_of_each_group(spark):
    rng = random.Random(3)
    rows = [(None, None), (2, ""), (1, " \n"), (3, "one two"), (4, "one two"), (5, "one two three")]
    for g in range(8):
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        rows += [(100 + 20 * g + k, edited(base, k % 5, rng)) for k in range(14)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, source string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == plain_firsts(rows)


def test_bits_apart_but_alike(spark):
    """Texts of Jaccard 0.8 or more differ in more than four bits of a fingerprint as a rule."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(100)]
    docs = spark.createDataFrame([(k, edited(base, k and 1, rng)) for k in range(30)], "doc_id int, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()] == [0]
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_bits_of_alike_sets():
    """At similarity 0.8 nearly all pairs are within the bits that are probed and verified; unrelated sets never."""
    rng = random.Random(1)
    alike = 0
    for _ in range(200):
        a = {rng.getrandbits(64) for _ in range(450)}
        b = set(list(a)[50:]) | {rng.getrandbits(64) for _ in range(50)}  # Jaccard 0.8
        c = {rng.getrandbits(64) for _ in range(450)}
        x, y, z = ([bits(np.array(sorted(s), "u8")) for s in (a, b, c)])
        assert distance(x[1:], y[1:]) <= resemblance.MORE_TAU < distance(x[1:], z[1:])
        alike += distance(x[:1], y[:1]) <= resemblance.TAU
    assert alike >= 160


def bits(s):
    return [resemblance.majority(s), *(resemblance.majority(resemblance.mixed(s, k)) for k in (1, 2, 3))]


def distance(x, y):
    return sum((a ^ b).bit_count() for a, b in zip(x, y))


def test_links_of_wide_distance(spark):
    """All that pairs within 13 and 54 bits connect is connected, by comparison of each with each."""
    rng = random.Random(4)
    flip = lambda x, n: x ^ sum(1 << k for k in rng.sample(range(64), n))
    rows = []
    for _ in range(40):
        base = [rng.getrandbits(64) for _ in range(4)]
        for _ in range(8):
            rows.append([flip(base[0], rng.randrange(9)), *(flip(x, rng.randrange(12)) for x in base[1:])])
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if distance(rows[i][:1], rows[j][:1]) <= 13 and distance(rows[i][1:], rows[j][1:]) <= 54:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    table = spark.createDataFrame([(k, *map(signed, r)) for k, r in enumerate(rows)], "node bigint, fp bigint, more1 bigint, more2 bigint, more3 bigint")
    for block in (100_000, 3):
        near = simhash.links(table, 13, block, "node", resemblance.MORE, 54, (3, 6, 8), 0.004)
        got = {r.node: r.root for r in connected_components(near).collect()}
        assert [got.get(k, k) for k in range(len(rows))] == group


def test_near_texts_under_the_threshold_are_not_all_compared(spark, monkeypatch):
    """Edits of one text, each alike to it and hardly one to another: right parts, and pairs that don't grow with the square."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(300)]
    rows = [(k, edited(base, rng.choice((3, 5, 6, 7, 8, 9)), rng)) for k in range(150)]
    plain = {k: plain_set(t) for k, t in rows}
    table = spark.createDataFrame([(1, k, k) for k, _ in rows], "key bigint, node bigint, root bigint")
    texts = spark.createDataFrame(rows, "node bigint, text string")
    compared = []
    monkeypatch.setattr(resemblance, "verified", lambda pairs, *rest, f=resemblance.verified: (compared.append(pairs.count()), f(pairs, *rest))[1])
    got = {r.node: r.root for r in resemblance.resembling(table, texts, 0.8, 5).collect()}
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(plain[i] & plain[j]) >= 0.8 * len(plain[i] | plain[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    assert [got.get(k, k) for k in range(len(rows))] == group and len(set(group)) > 30
    assert sum(compared) < 6000  # of 11,175 pairs
