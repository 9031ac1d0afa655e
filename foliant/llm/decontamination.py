"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The index stores postings of training tokens: document and position. Only terms that
a search asks for are stored, which are the rarest of each test phrase by their count
in the corpus. A phrase is found by adjusting the postings of its rarest terms by
their offsets and intersecting the lists of starts; the few places that are left are
compared word for word with the text, read again for the documents that have any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, pick, small, words_of

#: Between words: ASCII that is no lower-case letter (upper case has been lowered) and no digit.
BREAKS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def tokens(text: F.Column) -> F.Column:
    return words_of(ascii_lower(text), BREAKS)


def phrases(items: DataFrame, window: int = 10, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Different windows (``wid, words, n``) and which items have them (``item, wid``).
    An item with fewer words is one window; items without words have none."""
    cut = pick(items, [item_col, text_col])
    cut = cut.select(F.col(item_col).cast("string").alias("item"), tokens(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (window - 1), F.lit(1)))
    cut = materialize(cut.select("item", F.explode(starts).alias("s"), "all").select("item", F.slice("all", F.col("s"), window).alias("words")).distinct(), "phrases")
    different = materialize(cut.groupBy("words").agg(F.size("words").alias("n")).withColumn("wid", F.monotonically_increasing_id()), "windows")
    return different, materialize(cut.join(different, "words").select("item", "wid"), "items")


def document_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, key, words``: the key tells documents apart that share an id."""
    slim = pick(docs, [id_col, text_col])
    return slim.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), tokens(F.col(text_col)).alias("words"))


def term_counts(words: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, freq``: how often each term of ``terms`` stands in all documents. Where
    the terms are too many to broadcast, all are counted first, so that only counts are shuffled."""
    each, wanted = words.select(F.explode("words").alias("term")), small(terms)
    if wanted is terms:
        return each.groupBy("term").agg(F.count("*").alias("freq")).join(terms, "term")
    return each.join(wanted, "term").groupBy("term").agg(F.count("*").alias("freq"))


def build_index(words: DataFrame, terms: DataFrame, salts: int = 32) -> DataFrame:
    """Stored postings of ``terms``: ``id, key, n_words, term, pos`` (from 1). Tokens
    travel without the text they come from; where the terms are too many to
    broadcast, those of one term are dealt over ``salts`` parts."""
    posted = words.select("id", "key", F.size("words").alias("n_words"), F.posexplode("words").alias("at", "term"))
    wanted = small(terms)
    if wanted is terms:
        copies = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        posted = posted.withColumn("_salt", F.pmod(F.xxhash64("key", "at"), F.lit(salts)).cast("int")).join(copies, ["term", "_salt"])
    else:
        posted = posted.join(wanted, "term")
    return materialize(posted.select("id", "key", "n_words", "term", (F.col("at") + 1).alias("pos")), "postings")


def rarest_terms(windows: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """``wid, term, off`` (from 0), ``r`` (1: the rarest) and ``lists``, the number of
    terms taken: for each window the ``k`` places with the rarest terms. Windows
    with a term that no document has are left out, as they occur nowhere."""
    places = windows.select("wid", "n", F.posexplode("words").alias("off", "term")).join(counts, "term", "left")
    order = Window.partitionBy("wid").orderBy("freq", "term", "off")
    places = places.withColumn("known", F.count("freq").over(Window.partitionBy("wid"))).where("known = n")
    places = places.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return places.select("wid", "n", "term", "off", "r", F.least(F.lit(k), F.col("n")).alias("lists"))


def phrase_matches(docs: DataFrame, windows: DataFrame, k: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, key, wid, start, n``: every occurrence of every window in the texts of ``docs``."""
    words = document_words(docs, id_col, text_col)
    vocabulary = materialize(windows.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    counts = materialize(term_counts(words, vocabulary), "term-counts")
    seeds = materialize(rarest_terms(windows, counts, k), "seeds")
    index = build_index(words, materialize(seeds.select("term").distinct(), "seed-terms"))
    lists = index.join(small(seeds), "term").withColumn("start", F.col("pos") - F.col("off")).where("start >= 1 AND start + n - 1 <= n_words")
    both = lists.groupBy("id", "key", "wid", "start").agg(F.bit_or(F.expr("shiftleft(1, r - 1)")).alias("found"), F.max("lists").alias("lists"), F.max("n").alias("n"))
    places = materialize(both.where("found = shiftleft(1, lists) - 1").select(F.col("id").alias("_id"), F.col("key").alias("_key"), "wid", "start", "n"), "places")
    # Equal rows share places, so one of them is read.
    texts = pick(docs, [id_col, text_col]).select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    has = small(places.select("_id", "_key").distinct())
    texts = texts.join(has, F.col("id").eqNullSafe(F.col("_id")) & F.col("key").eqNullSafe(F.col("_key")), "left_semi").dropDuplicates(["id", "key"])
    at = places.groupBy("_id", "_key").agg(F.collect_list(F.struct("wid", "start", "n")).alias("at"))
    found = texts.join(at, F.col("id").eqNullSafe(F.col("_id")) & F.col("key").eqNullSafe(F.col("_key"))).select("id", "key", tokens(F.col("text")).alias("all"), "at")
    cut = F.transform("at", lambda x: F.struct(x.wid.alias("wid"), x.start.alias("start"), x.n.alias("n"), F.slice("all", x.start, x.n).alias("words")))
    found = found.select("id", "key", F.explode(cut).alias("x")).select("id", "key", "x.*")
    return found.join(small(windows.select(F.col("wid").alias("_wid"), F.col("words").alias("_words"))), (F.col("wid") == F.col("_wid")) & (F.col("words") == F.col("_words"))).select(
        "id", "key", "wid", "start", "n"
    )


def proximity_matches(docs: DataFrame, items: DataFrame, terms: int = 3, within: int = 20, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, item, start``: places of ``docs`` from which the ``terms`` rarest different
    terms of an item stand within ``within`` words, in any order. Items with fewer
    different words, or with one that no document has, are not looked for."""
    words = document_words(docs, id_col, text_col)
    own = pick(items, [item_col, text_col]).where(F.col(item_col).isNotNull())
    own = materialize(own.select(F.col(item_col).cast("string").alias("item"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term")).distinct(), "item-terms")
    counts = materialize(term_counts(words, own.select("term").distinct()), "term-counts")
    ranked = own.join(counts, "term").withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy("freq", "term"))).where(F.col("r") <= terms)
    ranked = materialize(ranked.withColumn("lists", F.count("*").over(Window.partitionBy("item"))).where(F.col("lists") == terms).select("item", "term"), "item-seeds")
    index = build_index(words, ranked.select("term").distinct())
    ahead = Window.partitionBy("id", "key", "item").orderBy("pos").rangeBetween(0, within - 1)
    found = index.join(small(ranked), "term").withColumn("near_terms", F.size(F.collect_set("term").over(ahead)))
    return found.where(F.col("near_terms") == terms).select("id", "item", F.col("pos").alias("start"))


def marked(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The columns of ``decontaminate`` and ``_key``, which tells rows apart that share an id."""
    windows, owners = phrases(benchmark, window, item_col, text_col)
    words = document_words(docs, id_col, text_col)
    hits = materialize(phrase_matches(docs, windows, id_col=id_col, text_col=text_col), "hits")
    spans = hits.groupBy("id", "key", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    reach = F.max("end").over(Window.partitionBy("id", "key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.col("reach"), F.lit(0))))
    covered = spans.withColumn("reach", reach).groupBy("id", "key").agg(F.sum(fresh).alias("n_hit"))
    items = hits.select("id", "key", "wid").distinct().join(small(owners), "wid").groupBy("id", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = covered.join(items, covered["id"].eqNullSafe(items["id"]) & covered["key"].eqNullSafe(items["key"])).select(
        covered["id"].alias("_id"), covered["key"].alias("_hit_key"), "n_hit", "items"
    )
    sizes = words.select("id", "key", F.size("words").cast("bigint").alias("n_words"))
    none = F.array().cast("array<string>")
    return sizes.join(found, F.col("id").eqNullSafe(F.col("_id")) & F.col("key").eqNullSafe(F.col("_hit_key")), "left").select(
        F.col("id").alias(id_col),
        F.col("key").alias("_key"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """For every row of ``docs``: id, ``n_words``, ``n_hit`` (words inside any
    occurrence of a window of an item), ``n_items`` and ``items_sha256`` (of the
    items with such windows) and ``contaminated``.

    Null and wordless texts have no words and no hits; items without words are not
    looked for; of items without id the windows are, but such items have no place in
    ``n_items`` and ``items_sha256``. Repeated rows and rows that share an id are told
    apart by their texts; repeated items count once. Very long texts are read whole;
    an empty table gives an empty result, an empty benchmark no hits. Other columns
    are not looked at."""
    return marked(docs, benchmark, window, id_col, text_col, item_col).drop("_key")


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, all columns, that no window of ``benchmark`` occurs in.
    A row goes by its id and text: others that share its id stay."""
    id_col, text_col = settings.get("id_col", "doc_id"), settings.get("text_col", "text")
    bad = marked(docs, benchmark, **settings).where("contaminated").select(F.col(id_col).alias("_bad"), "_key").distinct()
    same = F.col(id_col).eqNullSafe(F.col("_bad")) & (F.xxhash64(F.col(text_col)) == F.col("_key"))
    return docs.join(bad, same, "left_anti")


DECONTAMINATION_SQL = r"""
WITH lower_a AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, row_number() OVER () AS k FROM documents),
d AS (SELECT doc_id, k, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lower_a),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[s : s + 9], ' ') AS p, least(len(w), 10) AS n
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT k, n, s, array_to_string(w[s : s + n - 1], ' ') AS p FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n)),
h AS (SELECT dw.k, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.p = bw.p AND dw.n = bw.n),
c AS (SELECT k, count(DISTINCT x) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS x FROM h) GROUP BY k),
i AS (SELECT k, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM h GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN i USING (k)"""
