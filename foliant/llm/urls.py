"""URL filters: host and path rules first, then a weighted vocabulary.

An Aho-Corasick automaton finds strict and soft terms in a URL; a term counts if
no letter or digit touches it. One strict term rejects the URL, and so do two or more
different soft ones whose weights (1 unless ``weights`` says otherwise) sum to ``soft_limit``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
STRICT = ("porn", "xxx", "hentai", "viagra", "cialis", "cheap-pills", "spam-farm", "escort", "camgirl", "warez", "phishing")
SOFT = ("adult", "bet", "bonus", "buy", "casino", "cheap", "click", "crack", "deal", "farm", "free", "jackpot", "keygen", "loan", "nude", "pharma", "pills", "poker", "replica", "sex", "slots", "spam", "torrent", "win")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


#: The rules that the query op5_url_filters judges by.
RULES = (rule("block", "com/en/"), rule("allow", "example.com/en/7"), rule("allow", "net/de/"), rule("block", "example.net/de/8"), rule("block", "org/es/"))


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty for null and without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = lambda s, marks: min((k for k in map(s.find, marks) if k >= 0), default=len(s))
    end = cut(rest, "/?#")
    tail = rest[end:]
    return rest[:end].translate(ASCII_LOWER), tail[: cut(tail, "?#")]


@dataclass
class Filter:
    rules: Sequence[Rule] = RULES
    strict: Sequence[str] = STRICT
    soft: Sequence[str] = SOFT
    soft_limit: float = 2
    weights: Mapping[str, float] = field(default_factory=dict)
    _by_host: dict = field(default_factory=dict, repr=False)
    _found: object = field(default=None, repr=False)

    def build(self) -> Filter:
        for r in sorted(self.rules, key=lambda r: (-len(r.text), r.text)):
            self._by_host.setdefault(r.host, []).append(r)
        self._found = ahocorasick.Automaton()
        for term in (*self.strict, *self.soft):
            self._found.add_word(term, term)
        self._found.make_automaton()
        return self

    def rule_for(self, host: str, path: str) -> Rule | None:
        """The longest rule whose host is ``host`` or a domain above it and whose path starts ``path``."""
        best, at = None, 0
        while host and at >= 0:
            for r in self._by_host.get(host[at:], ()):
                if path.startswith(r.path):
                    if best is None or len(r.text) > len(best.text):
                        best = r
                    break
            at = host.find(".", at) + 1 or -1
        return best

    def terms(self, url: str) -> tuple[set[str], set[str]]:
        """Different strict and soft terms in ``url`` that stand on their own."""
        low = url.translate(ASCII_LOWER)
        free = lambda k: not 0 <= k < len(low) or not low[k].isalnum()
        found = {t for end, t in self._found.iter(low) if free(end - len(t)) and free(end + 1)}
        return found.intersection(self.strict), found.intersection(self.soft)

    def weight(self, term: str) -> float:
        return self.weights.get(term, 1.0)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, int]:
        host, path = split_url(url)
        fit = self.rule_for(host, path)
        strict, soft = self.terms(url or "") if url else (set(), set())
        heavy = len(soft) >= 2 and sum(map(self.weight, sorted(soft))) >= self.soft_limit
        verdict = fit.verdict if fit else "block" if strict or heavy else "allow"
        return host, path, fit.text if fit else None, verdict, len(strict), len(soft)


def judge_urls(pages: DataFrame, filter_: Filter | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Host, path, the rule that fits and the verdict for every row of ``pages``.

    A null URL and one without ``://`` have empty host and path, fit no rule and
    are judged by their terms (null: allowed). Very long URLs are searched whole.
    Repeated rows stay; an empty table gives an empty result, and other columns are
    not read, whatever their names."""
    settings = filter_ or Filter()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(settings.rules, settings.strict, settings.soft, settings.soft_limit, dict(settings.weights)).build()
        kinds = [pa.string()] * 4 + [pa.int32()] * 2
        names = [id_col, "host", "path", "rule", "verdict", "strict_hits", "soft_hits"]
        for b in batches:
            out = [own.judge(u) for u in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in out], kinds[k]) for k in range(6))], names=names)

    slim = pick(pages, [id_col, url_col])
    kind = slim.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, strict_hits int, soft_hits int")


def judge_sql(filter_: Filter | None = None) -> str:
    """The same over the table ``pages`` in SQL, built from the same rules and terms."""
    f = filter_ or Filter()
    after = "CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    ruled = sorted(f.rules, key=lambda r: (-len(r.text), r.text))
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    hit = lambda t: rf"CAST(regexp_matches(low, '(^|[^\p{{L}}\p{{N}}]){t}($|[^\p{{L}}\p{{N}}])') AS INT)"
    hits = lambda terms: " + ".join(map(hit, terms))
    weight = " + ".join(f"{f.weight(t)} * {hit(t)}" for t in f.soft)
    lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH rest AS (SELECT page_id, url, {after} AS after FROM pages),
parts AS (SELECT page_id, {lower.format("coalesce(url, '')")} AS low,
    {lower.format("regexp_extract(after, '^[^/?#]*')")} AS host,
    regexp_extract(regexp_replace(after, '^[^/?#]*', ''), '^[^?#]*') AS path FROM rest),
hits AS (SELECT page_id, host, path, CASE {" ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in ruled)} END AS rule,
    CASE {" ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ruled)} END AS ruled,
    CAST({hits(f.strict)} AS INT) AS strict_hits, CAST({hits(f.soft)} AS INT) AS soft_hits, {weight} AS soft_weight FROM parts)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
    coalesce(ruled, CASE WHEN strict_hits > 0 OR soft_hits >= 2 AND soft_weight >= {f.soft_limit} THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_hits
FROM hits"""
