import hashlib
import math
import random
import re

import pytest

from foliant.llm import decontamination, rules

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain_hits(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, ids = WORDS.findall(lower(t)), set(), set()
        for k, b in items:
            q = WORDS.findall(lower(b))
            n = min(len(q), window)
            for a in range(len(q) - n + 1) if n and k is not None else ():
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == q[a : a + n]:
                        hit |= set(range(s, s + n))
                        ids.add(str(k))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["the", "Of", "on", "thé", "x1", "ЖЖ"] + [f"w{k}" for k in range(40)]) for _ in range(n))
    items = [(k, say(rng.randint(8, 30))) for k in range(12)] + [(20, "One, two"), (21, ""), (22, None), (23, "the"), (None, say(12)), (3, "the the of the"), (10, "one-TWO")]
    docs = [(i, say(rng.randint(0, 80))) for i in range(30)]
    for i in range(30, 60):
        q = WORDS.findall(items[i % 12][1])
        docs.append((i, say(rng.randint(0, 20)) + "; " + ", ".join(q[rng.randint(0, 4) :]).upper() + ". " + say(5)))
    return docs + [(100, None), (101, ""), (101, "one two"), (30, docs[30][1]), (None, "zzz one.two"), (102, "the " * 300)], items


def test_decontamination(spark, texts):
    docs, items = texts
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id int, text string, item_id int")
    b = spark.createDataFrame([(*x, 2) for x in items], "item_id int, text string, doc_id int")
    got = decontamination.decontaminate(d, b)
    assert sorted(map(tuple, got.collect()), key=str) == plain_hits(docs, items)
    assert decontamination.decontaminate(d.limit(0), b).count() == 0
    assert {r.n_hit for r in decontamination.decontaminate(d, b.limit(0)).collect()} == {0}
    assert decontamination.clean(d, b).columns == d.columns


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a b zeta c d eta e theta f"), (2, "zeta " + "x " * 30 + "eta theta"), (3, "theta zeta eta")], "doc_id int, text string")
    b = spark.createDataFrame([(7, "Zeta eta, theta"), (8, "x")], "item_id int, text string")
    got = sorted(map(tuple, decontamination.proximity_matches(d, b, terms=3, within=10).collect()))
    assert got == [(1, "7", 3), (3, "7", 1)]


def plain_measures(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    seen, hit = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_rules(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x y " * 40, "é\U0001f600 <b> # \x0b z\nq\nq\n q\n\n", "same same same same same same", "w " * 5000]
    for k in range(120):
        words = [rng.choice(["thing", "over", "land", "water."]) + str(rng.randint(0, 90)) for _ in range(rng.randint(12, 90))]
        texts.append(" ".join(w.upper() + "!!" for w in words) if k % 6 == 0 else "*** ".join(words) if k % 6 == 1 else " ".join(words) + ".")
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(1, "", 0)], "doc_id int, text string, n_words int")
    got = rules.judge(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = plain_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
        k = r.doc_id - 8
        if k >= 0 and not r.base_failed:
            assert r.kept == (k % 6 > 1), (r, texts[r.doc_id])
    assert rules.judge(df.limit(0)).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = random.Random(2)
    right = [0.95, 0.9, 0.7, 0.5]
    counts = {}
    for _ in range(20_000):
        good = rng.random() < 0.7
        votes = tuple(0 if rng.random() < 0.2 else (1 if good else -1) * (1 if rng.random() < p else -1) for p in right)
        counts[votes] = counts.get(votes, 0) + 1
    base, weights = rules.em(sorted(counts.items()), trust=0.01)
    assert 0.3 < base < 1.5
    assert min(weights[0][1], weights[1][1]) > weights[2][1] > weights[3][1]
    assert rules.em([]) == (pytest.approx(math.log(4)), [])
