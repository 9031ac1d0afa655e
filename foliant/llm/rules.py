"""Quality rules as weak supervision, in DataFrame operations only.

Each rule votes for good (1) or bad (-1) or abstains (0). Expectation-maximisation
over the counts of vote patterns estimates, without labels, how often each rule
votes what for good and for bad texts; the posterior probability that a text is
good replaces the demand that it passes every rule.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialize, pick, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside ``WINDOW``-word windows that occur twice or more in the text."""

    def count(hashes: Column) -> Column:
        numbered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, k: F.get(s, k).getField("h") == x.getField("h")
            kept = F.filter(s, lambda x, k: F.coalesce((k > 0) & same(x, F.greatest(k - 1, F.lit(0))), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)))
            return F.array_sort(F.transform(kept, lambda x: x.getField("i")))

        def covered(at: Column) -> Column:
            steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, x: total + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(let(let(numbered, twice), covered))

    whole = F.size(words) - (WINDOW - 1)
    hashes = F.transform(F.slice(words, 1, F.greatest(whole, F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, WINDOW))))
    return F.when(whole > 1, let(hashes, count)).otherwise(F.lit(0).cast("bigint"))


def measures(text: Column) -> Column:
    """A struct of the counts that the rules look at; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    length = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("bigint")
    total = F.length(text).cast("bigint")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACES}]"))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("bigint").alias("n_words"), repeated_words(words).alias("n_repeat_words"))

    return F.struct(
        let(words_of(text, SPACES), of_words).alias("w"),
        length(f"[{SPACES}]+").alias("word_chars"),
        (total - length(f"[{SYMBOLS}]+")).alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("twice"))).alias("l"),
        (total - length("[A-Z]+")).alias("n_upper"),
        (total - length("!+")).alias("n_exclaims"),
        (total - length("[.,]+")).alias("n_stops"),
        (total - length(r"\p{L}+")).alias("n_letters"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}](?=[{SPACES}]|$)")).cast("bigint").alias("n_marked"),
    )


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by name, over the columns that ``measured`` gives."""
    c, words = F.col, F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "length": vote(c("n_words") >= 40, c("n_words") < 10),
        "word_length": vote((c("word_chars") >= 3 * words) & (c("word_chars") <= 10 * words), (c("word_chars") < 2 * words) | (c("word_chars") > 14 * words)),
        "symbols": vote(100 * c("n_symbols") <= chars, 100 * c("n_symbols") > 5 * chars),
        "lines": vote(c("n_dup_lines") == 0, (c("n_dup_lines") >= 2) & (4 * c("n_dup_lines") > c("n_lines"))),
        "repeats": vote(100 * c("n_repeat_words") <= 2 * words, 100 * c("n_repeat_words") > 20 * words),
        "capitals": vote(100 * c("n_upper") <= 10 * chars, 100 * c("n_upper") > 25 * chars),
        "exclaims": vote(100 * c("n_exclaims") <= words, 100 * c("n_exclaims") > 10 * words),
        "letters": vote(100 * c("n_letters") >= 85 * chars, 100 * c("n_letters") < 78 * chars),
        "marked": vote(100 * c("n_marked") <= 2 * words, 100 * c("n_marked") > 15 * words),
        "stops": vote((100 * c("n_stops") >= 3 * words) & (100 * c("n_stops") <= 60 * words), (100 * c("n_stops") < words) & (c("n_words") >= 40)),
    }


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and votes of every row, written to the shared folder: a few numbers a document."""
    m = pick(docs, [id_col, text_col]).select(id_col, measures(F.col(text_col)).alias("m"))
    flat = m.select(
        id_col, "m.w.n_words", "m.word_chars", "m.n_symbols", F.col("m.l.twice").alias("n_dup_lines"), "m.w.n_repeat_words",
        F.col("m.l.n").alias("n_lines"), "m.n_upper", "m.n_exclaims", "m.n_stops", "m.n_letters", "m.n_marked",
    )
    flat = materialize(flat, "measures")
    return flat.withColumns({f"vote_{name}": v for name, v in rules().items()})


#: What rules do before any text is seen: how often they vote 1 and -1 for good and
#: for bad texts. A bad text breaks a few of the rules, a good one hardly any.
BEFORE = {1: (0.9, 0.7), -1: (0.005, 0.25)}


def em(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, prior: float = 0.8, trust: float = 0.5) -> tuple[float, list[dict[int, float]]]:
    """Log-odds of good before any vote, and what each vote of each rule adds.

    ``patterns`` are votes and how many texts cast them, at most 3 to the number of
    rules. The maximum is that of the posterior: ``BEFORE`` counts like ``trust``
    times as many texts, without which a fault that comes alone, as most do, would
    seem to say nothing of the text. A rule is taken to be better than chance:
    where the counts say otherwise its vote adds nothing."""
    n_rules = len(patterns[0][0]) if patterns else 0
    weights = [{v: math.log(BEFORE[v][0] / BEFORE[v][1]) for v in (1, -1)} | {0: 0.0} for _ in range(n_rules)]
    base = math.log(prior / (1 - prior))
    total = sum(n for _, n in patterns)
    extra = trust * total * prior, trust * total * (1 - prior)
    for _ in range(rounds if patterns else 0):
        good = [1 / (1 + math.exp(-max(-40.0, min(40.0, base + sum(w[v] for w, v in zip(weights, votes, strict=True)))))) for votes, _ in patterns]
        mass = sum(g * n for g, (_, n) in zip(good, patterns, strict=True))
        new_base = math.log((mass + extra[0]) / (total - mass + extra[1]))
        new = []
        for r in range(n_rules):
            w = {0: 0.0}
            for v in (1, -1):
                on_good = sum(g * n for g, (votes, n) in zip(good, patterns, strict=True) if votes[r] == v) + extra[0] * BEFORE[v][0]
                on_bad = sum((1 - g) * n for g, (votes, n) in zip(good, patterns, strict=True) if votes[r] == v) + extra[1] * BEFORE[v][1]
                odds = math.log(on_good / (mass + extra[0])) - math.log(on_bad / (total - mass + extra[1]))
                w[v] = max(0.0, odds) if v == 1 else min(0.0, odds)
            new.append(w)
        done = abs(new_base - base) + sum(abs(a[v] - b[v]) for a, b in zip(new, weights, strict=True) for v in (1, -1)) < 1e-9
        base, weights = new_base, new
        if done:
            break
    return base, weights


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """For every row of ``docs``: the counts, ``base_failed``, ``posterior`` (that
    the text is good) and ``kept``: not base_failed, and a posterior of ``threshold`` or more.

    Null counts as empty: no words, so base_failed. Repeated rows stay and count
    each in the estimates; other columns are not looked at; an empty table gives an empty result."""
    rows = measured(docs, id_col, text_col)
    names = [f"vote_{n}" for n in rules()]
    patterns = rows.groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 3 ** 10 rows
    base, weights = em(sorted((tuple(r[n] for n in names), r["n"]) for r in patterns))
    odds = F.lit(base)
    for name, w in zip(names, weights or [{1: 0.0, -1: 0.0}] * len(names), strict=True):
        odds = odds + F.when(F.col(name) == 1, w[1]).when(F.col(name) == -1, w[-1]).otherwise(0.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    posterior = 1 / (1 + F.exp(-odds))
    return rows.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (posterior >= threshold)).alias("kept"), posterior.alias("posterior")
    )
