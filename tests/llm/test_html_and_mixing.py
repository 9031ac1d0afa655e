import hashlib
import math
import random
from collections import defaultdict
from itertools import product

import pytest

from foliant.llm import html, mixing

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";x(0);</script></head><body>
<nav><ul><li><a href="/a">Home page</a></li><li><a href='/b'>News &amp; more</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now.</div>
<article><h1>The  title&amp;</h1><p><b>First para.<br><p>Second &lt;b&gt; para&nbsp;here.</p><p>Yes.<div class="advert">Never.</div><p>Last one, <a href="x">with a link</a>.</article>
<section class="comments"><p>I liked this long and thoughtful article very much, thanks for it.</p></section><aside><p>Read this other story, it is good.</p></aside>
<form><p>Your name and address here, please.</p></form><div class="cookie-notice"><p>We use cookies to make it better.</p></div><footer>&copy; me &middot; All is ours."""


def test_main_text():
    assert html.main_text(PAGE) == "The title&\nFirst para.\nSecond <b> para here.\nYes.\nLast one, with a link."
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x") == ""
    assert html.main_text("<body><p>" + "A sentence of text. " * 9) == ("A sentence of text. " * 9).strip()
    deep = "<div>" * 50_000 + "<p>" + "word " * 99 + "end."
    assert html.main_text(deep).endswith("end.")
    assert html.main_text("<a \"" * 20_000 + ">") is not None


def test_cut_decides_against_the_sign():
    """A linked line without full stop in an article, and a long sentence in a menu, look like the other kind by themselves."""
    text = "A full sentence of the article that says a thing or two. " * 3
    page = f"<body><nav><ul><li><a href='/a'>Home</a></li><li>{text}{text}{text}</li><li><a href='/b'>More</a></li></ul></nav><div><p>{text}{text}</p><div><a href='/x'>see the other one</a></div><p>{text}{text}</p></div></body>"
    blocks = html.split_blocks(page)
    signs = [html.evidence(b) > 0 for b in blocks]
    kept = html.main_text(page).split("\n")
    assert signs[4] is False and blocks[4].text in kept
    assert [b.text in kept for b in blocks[3:]] == [True] * 3 and blocks[0].text not in kept


def test_raw_elements_end():
    one, two = "The first paragraph, long enough to count as text.", "The second paragraph, long enough to count as text."
    for between in ('<svg class="icon"/>', "<math/>", "<object>", "<iframe>", "<svg><path d='M0'/></svg>"):
        assert html.main_text(f"<body><article><p>{one}</p>{between}<p>{two}</p></article></body>") == f"{one}\n{two}"


def test_cut_is_cheapest():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 9)
        pull = [rng.randint(-9, 9) for _ in range(n)]
        ties = {(a, b): rng.randint(1, 8) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}

        def cost(x, pull=pull, ties=ties):
            return sum(-p if p < 0 and s else p if p > 0 and not s else 0 for p, s in zip(pull, x)) + sum(c for (a, b), c in ties.items() if x[a] != x[b])

        assert cost(html.min_cut(pull, ties)) == min(map(cost, product((False, True), repeat=n)))


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None)], "page_id int, url string, html string, text string")
    got = html.extract(df).collect()
    assert sorted((r.n_chars, r.text) for r in got) == sorted((len(html.main_text(p)), html.main_text(p)) for p in (PAGE, PAGE, None))
    assert html.extract(df.limit(0)).count() == 0


def plain_mix(rows):
    size = [len((t or "").split()) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, list(names), 1.5 * sum(size)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] >= 2 * total[s]]
        if not over:
            target |= {s: unit * weight[s] for s in free}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        free = [s for s in free if s not in over]
    key = lambda i, n: -math.log((int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:12], 16) + 0.5) / 16**12) / (1 + min(n, 1500) / 500)
    out = []
    for s in names:
        epochs = target[s] // total[s] if total[s] else 0
        left = math.floor(target[s] - epochs * total[s])
        for _, i, n in sorted((key(i, n), i, n) for (i, _, x), n in zip(rows, size) if x == s):
            part = max(0, min(n, left))
            left -= part
            out.append((i, n, total[s], round(target[s], 6), int(epochs * n + part)))
    return sorted(out)


@pytest.mark.parametrize("range_rows", [20_000, 15])
def test_mix_against_plain(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)) if i % 11 else None, rng.choice(["a", "b", "c", "d", "a", "a", "é", None])) for i in range(300)]
    rows += [rows[5], (900, "", "empty"), (901, None, "empty2"), (902, "x\ty\u00a0z  q", "a")]
    plain = [(i, (t or "").replace("\u00a0", "_"), s) for i, t, s in rows]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, source string, size int")
    got = sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(df).collect())
    assert got == plain_mix(plain)
    assert mixing.mix(df.limit(0)).count() == 0
    assert {r.taken >= 1 for r in mixing.mixed(df).collect()} == {True}
