"""Registered queries of boxes, line words, furniture and styles, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import geometry as B
from ..operators import layout as L
from ..operators import tables as G
from ..options import Options
from ..sources import pdf
from . import convert, feeds
from .queries import BODY_SQL, CAPTION_SQL, COLLAPSED, KIND_SQL, of_layout, of_lines, query

TWO_BOXES = """SELECT p_partkey, CAST(p_partkey % 50 AS DOUBLE) AS ax0, CAST(p_size AS DOUBLE) AS atop, CAST(p_partkey % 50 + p_size AS DOUBLE) AS ax1, CAST(p_size + p_partkey % 7 AS DOUBLE) AS abottom,
    CAST(p_size AS DOUBLE) AS bx0, CAST(p_partkey % 40 AS DOUBLE) AS btop, CAST(p_size + 10 AS DOUBLE) AS bx1, CAST(p_partkey % 40 + 20 AS DOUBLE) AS bbottom FROM part"""


def two_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    rest = lambda n: F.pmod(k, F.lit(n))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", B.box(rest(50), s, rest(50) + s, s + rest(7)).alias("a"), B.box(s, rest(40), s + 10, rest(40) + 20).alias("b"))


@query(f"""SELECT p_partkey, ax1 - ax0 AS width, abottom - atop AS height, (ax0 + ax1) / 2 AS cx, (atop + abottom) / 2 AS cy, least(ax0, bx0) AS x0, least(atop, btop) AS top, greatest(ax1, bx1) AS x1, greatest(abottom, bbottom) AS bottom,
    least(ax1, bx1) - greatest(ax0, bx0) AS over_x, least(abottom, bbottom) - greatest(atop, btop) AS over_y,
    (bx0 + bx1) / 2 >= ax0 AND (bx0 + bx1) / 2 <= ax1 AND (btop + bbottom) / 2 >= atop AND (btop + bbottom) / 2 <= abottom AS holds FROM ({TWO_BOXES})""")
def box_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    found = two_boxes(spark, sf_dir).withColumn("m", B.merged(a, b))
    return found.select(
        "p_partkey", B.width(a).alias("width"), B.height(a).alias("height"), B.center_x(a).alias("cx"), B.center_y(a).alias("cy"), "m.x0", "m.top", "m.x1", "m.bottom",
        B.overlap_x(a, b).alias("over_x"), B.overlap_y(a, b).alias("over_y"), B.contains(a, B.center_x(b), B.center_y(b)).alias("holds"),
    )


@query("""SELECT c_nationkey, CAST(min(c_custkey) FILTER (c_custkey % 11 = 3) AS DOUBLE) AS x0, CAST(max(c_custkey + length(c_name)) FILTER (c_custkey % 11 = 3) AS DOUBLE) AS x1, count(*) FILTER (c_custkey % 11 = 3) > 0 AS any_box FROM customer GROUP BY c_nationkey""")
def box_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    one = F.when(F.pmod(key, F.lit(11)) == 3, B.box(key, F.lit(0), key + F.length("c_name"), F.lit(9)))
    found = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_nationkey").agg(F.collect_list(one).alias("boxes"))
    around = B.union(F.col("boxes"))
    return found.select("c_nationkey", around.getField("x0").alias("x0"), around.getField("x1").alias("x1"), around.isNotNull().alias("any_box"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS DOUBLE) ELSE CAST(length(o_orderpriority) + 3 AS DOUBLE) END AS length,
    CASE WHEN o_orderkey % 2 = 0 THEN (length(o_orderpriority) + 3) / 2 ELSE o_custkey / 2 END AS place FROM orders""")
def edge_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from the corner 0, 0: as wide as the customer's number, as high as the priority has letters, and three."""
    way = F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "h").otherwise("v")
    sides = (F.lit(0.0), F.lit(0.0), F.col("o_custkey").cast("double"), (F.length("o_orderpriority") + 3).cast("double"))
    edge = F.struct(*(v.alias(name) for name, v in zip(B.SIDES, sides, strict=True)), way.alias("orientation"))
    found = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", edge.alias("edge"))
    return found.select("o_orderkey", B.edge_length(F.col("edge")).alias("length"), B.edge_place(F.col("edge")).alias("place"))


def line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, line_no, words``: words of the lines, each 40 points behind the last and five points wide for each letter, so that long ones run into the next."""
    texts = F.filter(F.split("text", " "), lambda w: w != "")
    x = lambda k: (k * 40).cast("double")
    word = lambda w, k: F.struct(w.alias("text"), x(k).alias("x0"), F.lit(100.0).alias("top"), (x(k) + 5 * F.length(w)).alias("x1"), F.lit(110.0).alias("bottom"))
    return feeds.lines(spark, sf_dir).select("doc_id", "line_no", F.transform(texts, word).alias("words"))


WORDS_SQL = """, words AS (SELECT doc_id, line_no, unnest(w) AS word, unnest(range(len(w))) AS k FROM (SELECT doc_id, line_no, list_filter(string_split(text, ' '), lambda t: t <> '') AS w FROM lines)),
placed AS (SELECT *, 40.0::DOUBLE * k AS x0, 40.0::DOUBLE * k + 5 * length(word) AS x1 FROM words)"""


@query(of_lines("SELECT * FROM lines").replace("\nSELECT * FROM lines", WORDS_SQL + """
SELECT doc_id, line_no, last AS start, x0 AS "end", CAST(k AS INT) AS after FROM (SELECT *, lag(x1) OVER (PARTITION BY doc_id, line_no ORDER BY k) AS last FROM placed) WHERE x0 > last"""))
def line_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_words(spark, sf_dir).select("doc_id", "line_no", F.inline(B.gaps(F.col("words"))))


@query(of_lines("SELECT * FROM lines").replace("\nSELECT * FROM lines", WORDS_SQL + """
SELECT doc_id, line_no, CAST(coalesce(sum(length(word)), 0) AS INT) AS chars, count(word) = 0 AS blank, CAST(count(*) FILTER ((x0 + x1) / 2 >= 100 AND (x0 + x1) / 2 < 300) AS INT) AS inside
FROM lines LEFT JOIN placed USING (doc_id, line_no) GROUP BY doc_id, line_no"""))
def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.col("words")
    return line_words(spark, sf_dir).select("doc_id", "line_no", B.char_count(words).alias("chars"), B.is_blank(words).alias("blank"), F.size(B.words_between(words, F.lit(100.0), F.lit(300.0))).alias("inside"))


@query("""WITH n AS (SELECT CAST(c_nationkey AS BIGINT) AS k, count(*) AS n FROM customer GROUP BY 1) SELECT k, CAST(n AS INT) AS n_rows, CAST(1 + least(n - 1, 6) AS INT) AS n_cols FROM n""")
def grid_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids with a row for each customer of a nation, the k-th with as many cells as k, up to seven."""
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_nationkey").cast("bigint").alias("k")).agg(F.collect_list("c_name").alias("names"))
    rows = names.withColumn("rows", F.transform("names", lambda n, k: F.array_repeat(n, F.least(k + 1, F.lit(7)))))
    return rows.select("k", F.size("rows").alias("n_rows"), G.width(F.col("rows")).alias("n_cols"))


GLYPH_WORDS = """WITH l AS (SELECT doc_id, line_no, list_filter(string_split(trim(regexp_replace(raw, '\\s+', ' ', 'g')), ' '), lambda t: t <> '') AS w FROM (SELECT doc_id, CAST(unnest(range(len(a))) AS INT) AS line_no, unnest(a) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents))),
w AS (SELECT doc_id, line_no, unnest(w) AS word, unnest(range(len(w))) AS k FROM l),
f AS (SELECT *, CASE length(word) % 3 WHEN 0 THEN 'Plain' WHEN 1 THEN 'Plain-Bold' ELSE 'Plain-Italic' END AS font, CASE WHEN length(word) % 2 = 0 THEN 10.0 ELSE 9.5 END AS size FROM w)"""


@query(GLYPH_WORDS + """,
sizes AS (SELECT doc_id, line_no, size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY n DESC, size DESC) AS r FROM (SELECT doc_id, line_no, size, sum(length(word)) AS n FROM f GROUP BY ALL)) WHERE r = 1),
fonts AS (SELECT doc_id, line_no, font FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY n DESC, seen) AS r FROM (SELECT doc_id, line_no, font, sum(length(word)) AS n, min(k) AS seen FROM f GROUP BY ALL)) WHERE r = 1),
shares AS (SELECT doc_id, line_no, round(coalesce(sum(length(word)) FILTER (font = 'Plain-Bold'), 0) / sum(length(word)), 6) AS bold, round(coalesce(sum(length(word)) FILTER (font = 'Plain-Italic'), 0) / sum(length(word)), 6) AS italic FROM f GROUP BY ALL)
SELECT doc_id, line_no AS page, CAST(size AS DOUBLE) AS size, font, bold, italic, bold >= 0.6 AS is_bold, italic >= 0.6 AS is_italic FROM sizes JOIN fonts USING (doc_id, line_no) JOIN shares USING (doc_id, line_no)""")
def glyph_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, font and weights of lines from their glyphs, whose font and size follow from the length of their word."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page", "raw"))
    words = F.filter(F.split(F.trim(F.regexp_replace("raw", r"\s+", " ")), " "), lambda w: w != "")
    x = lambda k: (72 + 5 * k).cast("double")
    starts = F.aggregate("words", F.array(F.lit(0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + F.length(w) + 1)))

    def glyphs(w, k):
        n = F.length(w)
        font = F.when(n % 3 == 0, "Plain").when(n % 3 == 1, "Plain-Bold").otherwise("Plain-Italic")
        at = lambda j: x(F.get("starts", k) + j)
        return F.transform(F.filter(F.split(w, ""), lambda c: c != ""), lambda c, j: F.struct(c.alias("text"), at(j).alias("x0"), at(j + 1).alias("x1"), F.lit(100.0).alias("top"), F.lit(110.0).alias("bottom"), F.when(n % 2 == 0, 10.0).otherwise(9.5).alias("size"), font.alias("fontname"), F.lit(True).alias("upright")))

    pages = docs.withColumn("words", words).withColumn("starts", starts).select(
        F.col("doc_id").cast("string").alias("doc_id"), "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.flatten(F.transform("words", glyphs)).alias("glyphs"), F.array().cast(f"array<{pdf.EDGE}>").alias("edges")
    )
    found = convert.elements(pages.repartition(spark.sparkContext.defaultParallelism, "doc_id", "page"), Options(normalize_unicode=False, detect_columns=False))
    style = F.struct("bold_ratio", "italic_ratio")
    bold, italic = F.round("bold_ratio", 6).alias("bold"), F.round("italic_ratio", 6).alias("italic")
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), "page", "size", "font", bold, italic, B.is_bold(style).alias("is_bold"), B.is_italic(style).alias("is_italic"))


STAMPED = """, stamped AS (SELECT doc_id, page, seq, text, top, size FROM layout UNION ALL
    SELECT DISTINCT doc_id, page, 100000 + page, 'Draft   copy of ' || doc_id, CAST(300 + (page % 2) * (doc_id % 3) * 10 AS DOUBLE), 8.0 FROM layout)"""


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The laid-out lines and a stamp on each page, which in a third of the documents moves too far to be one."""
    lines = feeds.layout(spark, sf_dir)
    top = (F.lit(300) + F.pmod("page", F.lit(2)) * F.pmod("doc_id", F.lit(3)) * 10).cast("double")
    marks = lines.select("doc_id", "page").distinct().select(
        "doc_id", "page", (F.col("page") + 100000).alias("seq"), F.concat(F.lit("Draft   copy of "), F.col("doc_id").cast("string")).alias("text"), F.lit(72.0).alias("x0"), top.alias("top"), (top + 10).alias("bottom"),
        F.lit(8.0).alias("size"), F.lit(False).alias("bold"), F.lit(792.0).alias("height"),
    )
    return lines.unionByName(marks)


@query(of_layout(BODY_SQL + STAMPED + rf""", small AS (SELECT s.*, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS same, trim(text) AS t FROM stamped s JOIN body USING (doc_id) WHERE size <= 0.95 * body),
told AS (SELECT *, regexp_extract(t, '{CAPTION_SQL}', 1) AS word, regexp_replace(t, '{CAPTION_SQL}', '') AS rest, regexp_matches(t, '{CAPTION_SQL}') AS labelled FROM small WHERE length(t) BETWEEN 1 AND 80),
plain AS (SELECT * FROM told WHERE NOT (labelled AND rest <> '' AND CASE {KIND_SQL} END IS NOT NULL)),
firsts AS (SELECT doc_id, same, page, min(seq) AS seq, arg_min(top, seq) AS top FROM plain GROUP BY doc_id, same, page),
pages AS (SELECT doc_id, count(DISTINCT page) AS pages FROM layout GROUP BY doc_id HAVING count(DISTINCT page) >= 2),
spread AS (SELECT *, count(*) OVER w AS n, max(top) OVER w - min(top) OVER w AS spread FROM firsts JOIN pages USING (doc_id) WINDOW w AS (PARTITION BY doc_id, same))
SELECT doc_id, page, seq FROM spread WHERE n >= greatest(3, ceil(0.6 * pages)) AND spread <= 18"""))
def artifact_floating(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stamped(spark, sf_dir)
    return L.floating_repeats(lines, L.body_sizes(feeds.layout(spark, sf_dir)), Options())


@query(of_layout(""", inside AS (SELECT doc_id, page, seq, NOT (top + 10 <= 79.2 OR top >= 0.88 * 792) AS inside FROM layout WHERE seq % 8 IN (0, 7) OR doc_id % 2 = 0)
SELECT doc_id, page, seq FROM inside WHERE inside OR doc_id NOT IN (SELECT doc_id FROM inside WHERE inside)"""))
def artifact_body_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents have lines in the bands only, so all of theirs stay."""
    slot = F.pmod("seq", F.lit(8))
    lines = feeds.layout(spark, sf_dir).where(slot.isin(0, 7) | (F.pmod("doc_id", F.lit(2)) == 0))
    return L.body_zone(lines, Options()).select("doc_id", "page", "seq")


@query(of_lines(rf"SELECT doc_id, line_no, {COLLAPSED.format('x')} AS collapsed FROM (SELECT doc_id, line_no, replace(text, ' ', CASE WHEN line_no % 2 = 0 THEN '  ' ELSE ' ' END) || ' ' AS x FROM lines)"))
def text_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.concat(F.replace("text", F.lit(" "), F.when(F.pmod("line_no", F.lit(2)) == 0, "  ").otherwise(" ")), F.lit(" "))
    return feeds.lines(spark, sf_dir).select("doc_id", "line_no", T.collapse_spaces(wide).alias("collapsed"))
