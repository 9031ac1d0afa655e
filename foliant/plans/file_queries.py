"""Registered queries that make files of the driver's tables and read them back, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import tables as G
from ..operators.layout import reading_order
from ..options import Options
from ..sources import pdf
from ..sources.docx_writer import cell_table, package, paragraph
from ..sources.pdf_writer import grid, text, write
from . import convert, evaluate
from .queries import query


def made(rows: DataFrame, draw: Callable[[dict], bytes]) -> DataFrame:
    """``doc_id, content``: a file drawn from each row, which has a column ``doc_id``.
    Rows are spread over all cores first: a small table is one task, but its files are not small work."""
    rows = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [(str(r["doc_id"]), draw(r)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in drawn], pa.string()), pa.array([c for _, c in drawn], pa.binary())], names=["doc_id", "content"])

    return rows.mapInArrow(run, "doc_id string, content binary")


def table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").withColumn("doc_id", F.col(key))


def part_page(r: dict) -> bytes:
    return write([[text(72, 100, r["p_name"], 16, True), text(72, 130, f"{r['p_brand']} {r['p_type']}"), text(72, 160, f"Size {r['p_size']}", 9, italic=True)]], compress=r["doc_id"] % 2 == 0)


@query("""SELECT p_partkey, 0 AS seq, p_name AS text, true AS bold, 16.0 AS size FROM part
UNION ALL SELECT p_partkey, 1, p_brand || ' ' || p_type, false, 11.0 FROM part UNION ALL SELECT p_partkey, 2, 'Size ' || p_size, false, 9.0 FROM part""")
def pdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = made(table(spark, sf_dir, "part", "p_partkey").select("doc_id", "p_name", "p_brand", "p_type", "p_size"), part_page)
    lines = convert.lines_of(convert.read_pdf(files, Options()))
    return lines.select(F.col("doc_id").cast("bigint").alias("p_partkey"), "seq", "text", "bold", "size")


@query("""SELECT p_partkey, count(*) AS n_glyphs, string_agg(c, '' ORDER BY k) AS chars FROM (SELECT p_partkey, unnest(string_split(t, '')) AS c, unnest(range(length(t))) AS k
    FROM (SELECT p_partkey, p_name || p_brand || ' ' || p_type || 'Size ' || p_size AS t FROM part)) GROUP BY p_partkey""")
def pdf_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = made(table(spark, sf_dir, "part", "p_partkey").select("doc_id", "p_name", "p_brand", "p_type", "p_size"), part_page)
    chars = F.array_join(F.transform("glyphs", lambda g: g.getField("text")), "")
    return pdf.decode(files).select(F.col("doc_id").cast("bigint").alias("p_partkey"), F.size("glyphs").cast("bigint").alias("n_glyphs"), chars.alias("chars"))


def order_grid(r: dict) -> bytes:
    xs, ys = [72.0, 200.0, 420.0], [110.0, 130.0, 150.0, 170.0]
    cells = [("Field", "Value"), ("Status", r["o_orderstatus"]), ("Priority", r["o_orderpriority"])]
    return write([[grid(xs, ys), *[text(xs[c] + 5, ys[k] + 14, cell, 10, k == 0) for k, row in enumerate(cells) for c, cell in enumerate(row)]]])


@query("""SELECT o_orderkey, '| Field | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| Status | ' || o_orderstatus || ' |' || chr(10) || '| Priority | ' || o_orderpriority || ' |' AS grid, true AS has_header, true AS ruled FROM orders""")
def pdf_ruled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = made(table(spark, sf_dir, "orders", "o_orderkey").select("doc_id", "o_orderstatus", "o_orderpriority"), order_grid)
    found = convert.read_pdf(files, Options()).where("kind = 'table'")
    return found.select(F.col("doc_id").cast("bigint").alias("o_orderkey"), G.rendered(F.col("rows"), F.lit(True), "markdown").alias("grid"), "has_header", "ruled")


def customer_grid(r: dict) -> bytes:
    cells = [("Name", "Nation", "Segment"), (r["c_name"], str(r["c_nationkey"]), r["c_mktsegment"]), ("Other", "77", "NONE"), ("Last", "5", "SOME")]
    return write([[text(72 + 180 * c, 150 + 15 * k, cell, 11, k == 0) for k, row in enumerate(cells) for c, cell in enumerate(row)]])


@query("""SELECT c_custkey, 'Name' || chr(9) || 'Nation' || chr(9) || 'Segment' || chr(10) || c_name || chr(9) || c_nationkey || chr(9) || c_mktsegment || chr(10) || 'Other' || chr(9) || '77' || chr(9) || 'NONE' || chr(10) || 'Last' || chr(9) || '5' || chr(9) || 'SOME' AS grid, true AS has_header FROM customer""")
def pdf_aligned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = made(table(spark, sf_dir, "customer", "c_custkey").select("doc_id", "c_name", "c_nationkey", "c_mktsegment"), customer_grid)
    found = convert.read_pdf(files, Options(detect_columns=False)).where("kind != 'page'")
    found = convert.with_aligned_tables(found, Options(detect_columns=False)).where("kind = 'table'")
    return found.select(F.col("doc_id").cast("bigint").alias("c_custkey"), G.rendered(F.col("rows"), F.lit(True), "text").alias("grid"), "has_header")


LEFT = ("Alpha one line of the left column", "Alpha two continues the left", "Alpha three still on the left", "Alpha four keeps going here", "Alpha five is another line", "Alpha six ends the left side.")
RIGHT = tuple(t.replace("Alpha", "Beta").replace("left", "right") for t in LEFT)


def two_columns(r: dict) -> bytes:
    pairs = zip((*LEFT, f"Left {r['c_name']}"), (*RIGHT, f"Right {r['c_name']}"), strict=True)
    return write([[text(60, 80, "A Two Column Paper With A Long Banner Title", 17, True), *[text(x, 130 + 15 * k, t, 10) for k, pair in enumerate(pairs) for x, t in zip((60, 330), pair, strict=True)]]])


@query(f"""SELECT c_custkey, 'A Two Column Paper With A Long Banner Title|{"|".join(LEFT)}|Left ' || c_name || '|{"|".join(RIGHT)}|Right ' || c_name AS read FROM customer""")
def pdf_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = made(table(spark, sf_dir, "customer", "c_custkey").select("doc_id", "c_name"), two_columns)
    lines = reading_order(convert.lines_of(convert.read_pdf(files, Options())))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("order", "text"))), lambda x: x.getField("text"))
    return lines.groupBy(F.col("doc_id").cast("bigint").alias("c_custkey")).agg(F.array_join(texts, "|").alias("read"))


def supplier_report(r: dict) -> bytes:
    pages = []
    for n in (1, 2, 3):
        pages.append([
            text(72, 40, f"Report of {r['s_name']}", 8), text(72, 120, f"Part {n} of the report", 14, True),
            text(72, 150, f"The supplier {r['s_name']} delivers to nation number {r['s_nationkey']} and"), text(430, 145.5, str(n), 7),
            text(72, 164, f"of this page {n} tells a story about the height of moun-"), text(72, 178, "tains in the years that the report covers, as it must."), text(72, 215, "- first point of the list"), text(90, 231, "- nested point of the list"), text(72, 247, "- last point of the list"),
            text(72, 700, f"{n}  Note {n} explains the claim in more depth.", 8), text(300, 760, str(n), 9),
        ])
    return write(pages, r["s_name"])


PAGE_SQL = """'# Part {n} of the report' || e || 'The supplier ' || s_name || ' delivers to nation number ' || s_nationkey || ' and[^{n}] of this page {n} tells a story about the height of mountains in the years that the report covers, as it must.' || e || '[^{n}]: Note {n} explains the claim in more depth.'
    || e || '- first point of the list' || chr(10) || '  - nested point of the list' || chr(10) || '- last point of the list'"""


@query(f"""SELECT s_suppkey, {" || e || ".join(PAGE_SQL.format(n=n) for n in (1, 2, 3))} || chr(10) AS markdown FROM (SELECT *, chr(10) || chr(10) AS e FROM supplier)""")
def pdf_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = made(table(spark, sf_dir, "supplier", "s_suppkey").select("doc_id", "s_name", "s_nationkey"), supplier_report)
    _, blocks = convert.parse_files(files)
    return convert.markdown(blocks).select(F.col("doc_id").cast("bigint").alias("s_suppkey"), "markdown")


@query("""SELECT s_suppkey, 'pdf' AS format, CAST(3 AS INT) AS n_pages, s_name AS title, 'stripped' AS state FROM supplier""")
def pdf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = made(table(spark, sf_dir, "supplier", "s_suppkey").select("doc_id", "s_name", "s_nationkey"), supplier_report)
    documents, blocks = convert.parse_files(files)
    kept = blocks.where(F.col("text").contains("Report of")).select("doc_id").distinct().withColumn("state", F.lit("kept"))
    return documents.join(kept, "doc_id", "left").select(F.col("doc_id").cast("bigint").alias("s_suppkey"), "format", "n_pages", "title", F.coalesce("state", F.lit("stripped")).alias("state"))


@query("""SELECT s_suppkey, unnest([0, 1, 2]) AS k, unnest(['1', '2', '3']) AS marker, unnest(['Note 1 explains the claim in more depth.', 'Note 2 explains the claim in more depth.', 'Note 3 explains the claim in more depth.']) AS note FROM supplier""")
def pdf_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = made(table(spark, sf_dir, "supplier", "s_suppkey").select("doc_id", "s_name", "s_nationkey"), supplier_report)
    _, blocks = convert.parse_files(files)
    return convert.footnotes(blocks).select(F.col("doc_id").cast("bigint").alias("s_suppkey"), (F.col("marker").cast("int") - 1).alias("k"), "marker", F.col("text").alias("note"))


def nation_package(r: dict) -> bytes:
    return package([paragraph(r["n_name"], "Heading1"), paragraph(f"Nation {r['n_nationkey']} lies in region {r['n_regionkey']}."), cell_table([["Key", "Region"], [str(r["n_nationkey"]), str(r["n_regionkey"])]], header=True)])


@query("""SELECT n_nationkey, '# ' || n_name || chr(10) || chr(10) || 'Nation ' || n_nationkey || ' lies in region ' || n_regionkey || '.' || chr(10) || chr(10) || '| Key | Region |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n_nationkey || ' | ' || n_regionkey || ' |' || chr(10) AS markdown FROM nation""")
def docx_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = made(table(spark, sf_dir, "nation", "n_nationkey").select("doc_id", "n_name", "n_nationkey", "n_regionkey"), nation_package)
    _, blocks = convert.parse_files(files)
    return convert.markdown(blocks).select(F.col("doc_id").cast("bigint").alias("n_nationkey"), "markdown")


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'zip' ELSE 'unknown' END AS format FROM nation""")
def source_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.element_at(F.array(*(F.lit(h) for h in ("x%PDF-1.4", "PK\x03\x04word/document.xml", "PK\x03\x04other", "plain"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    files = table(spark, sf_dir, "nation", "n_nationkey").select("doc_id", heads.cast("binary").alias("content"))
    return convert.formats(files).select(F.col("doc_id").alias("n_nationkey"), "format")


@query(r"""SELECT doc_id, line_no AS page, 0 AS seq, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS text FROM (SELECT doc_id, CAST(unnest(range(len(a))) AS INT) AS line_no, unnest(a) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)) WHERE trim(regexp_replace(raw, '\s+', ' ', 'g')) <> ''""")
def glyph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents set glyph by glyph, and clustered to words and lines again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page", "raw"))
    x = lambda k: (72 + 5 * k).cast("double")
    glyph = lambda c, k: F.struct(c.alias("text"), x(k).alias("x0"), x(k + 1).alias("x1"), F.lit(100.0).alias("top"), F.lit(110.0).alias("bottom"), F.lit(10.0).alias("size"), F.lit("Plain").alias("fontname"), F.lit(True).alias("upright"))
    chars = F.filter(F.split("raw", ""), lambda c: c != "")
    pages = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.transform(chars, glyph).alias("glyphs"), F.array().cast(f"array<{pdf.EDGE}>").alias("edges"))
    pages = pages.repartition(spark.sparkContext.defaultParallelism, "doc_id", "page")
    found = convert.elements(pages, Options(normalize_unicode=False, detect_columns=False))
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), "page", "seq", "text")


def survey_page(r: dict) -> bytes:
    xs, ys = [72.0, 200.0, 420.0], [230.0, 250.0, 270.0, 290.0]
    cells = [("Station", "Depth"), ("North", str(r["s_nationkey"])), ("South", "77")]
    return write([[
        text(72, 90, "Survey of the northern", 18, True), text(72, 110, f"rivers by {r['s_name']}", 18, True),
        text(72, 150, f"The first paragraph tells what the survey of {r['s_name']} found and how"),
        text(72, 180, "1. first measured station"), text(72, 196, "2. second measured station"),
        grid(xs, ys), *[text(xs[c] + 5, ys[k] + 14, cell, 10, k == 0) for k, row in enumerate(cells) for c, cell in enumerate(row)],
        text(72, 312, "Table 1. Depths at the stations of the survey.", 9),
    ]])


SURVEY = """SELECT s_suppkey, unnest([0, 1, 2, 3, 4]) AS "order", unnest(['heading', 'paragraph', 'list', 'table', 'caption']) AS type, unnest([1, NULL, 1, NULL, NULL]) AS level,
    unnest(['Survey of the northern rivers by ' || s_name, 'The first paragraph tells what the survey of ' || s_name || ' found and how', '1. first measured station' || chr(10) || '2. second measured station',
        'Station' || chr(9) || 'Depth' || chr(10) || 'North' || chr(9) || s_nationkey || chr(10) || 'South' || chr(9) || '77', 'Table 1. Depths at the stations of the survey.']) AS text,
    unnest([NULL, NULL, NULL, 'Table 1. Depths at the stations of the survey.', NULL]) AS caption, unnest([NULL, NULL, NULL, 'Table 1', 'Table 1']) AS label, unnest([NULL, NULL, NULL, NULL, 3]) AS target FROM supplier"""


@query(SURVEY)
def pdf_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading over two lines, a numbered list, a ruled table and its caption, as blocks."""
    files = made(table(spark, sf_dir, "supplier", "s_suppkey").select("doc_id", "s_name", "s_nationkey"), survey_page)
    _, blocks = convert.parse_files(files)
    return blocks.select(F.col("doc_id").cast("bigint").alias("s_suppkey"), "order", "type", "level", "text", "caption", "label", F.col("target_order").alias("target"))


@query("""SELECT s_suppkey, unnest([1, 2]) AS level_order, unnest([2, 3]) AS page, 'Part ' || unnest([2, 3]) || ' of the report' AS heading FROM supplier""")
def pdf_page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = made(table(spark, sf_dir, "supplier", "s_suppkey").select("doc_id", "s_name", "s_nationkey"), supplier_report)
    _, blocks = convert.parse_files(files, Options(pages=(2, 9)))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("order"))
    return blocks.where("type = 'heading'").select(F.col("doc_id").cast("bigint").alias("s_suppkey"), nth.alias("level_order"), "page", F.col("text").alias("heading"))


@query("""SELECT s_suppkey, unnest(['header', 'page_number']) AS artifact, 3 AS n, unnest(['Report of ' || s_name, '2']) AS second FROM supplier""")
def pdf_kept_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = made(table(spark, sf_dir, "supplier", "s_suppkey").select("doc_id", "s_name", "s_nationkey"), supplier_report)
    _, blocks = convert.parse_files(files, Options(keep_headers=True))
    kept = blocks.where("artifact IS NOT NULL").groupBy("doc_id", "artifact").agg(F.count("*").cast("int").alias("n"), F.max(F.when(F.col("page") == 2, F.col("text"))).alias("second"))
    return kept.select(F.col("doc_id").cast("bigint").alias("s_suppkey"), "artifact", "n", "second")


@query("""SELECT s_suppkey, unnest([1, 2, 3]) AS k, 1 AS level, 'Part ' || unnest([1, 2, 3]) || ' of the report' AS heading FROM supplier""")
def pdf_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = made(table(spark, sf_dir, "supplier", "s_suppkey").select("doc_id", "s_name", "s_nationkey"), supplier_report)
    _, blocks = convert.parse_files(files)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("order"))
    return convert.outline(blocks).select(F.col("doc_id").cast("bigint").alias("s_suppkey"), nth.alias("k"), "level", F.col("text").alias("heading"))


@query("""SELECT s_suppkey, 'pdf' AS format, 1 AS n_pages, 5 AS n_blocks, 'Survey of the northern rivers by ' || s_name AS heading, 'Station' AS first_cell, '2' AS marker, 0 AS n_warnings,
    '# Survey of the northern rivers by ' || s_name AS start FROM supplier""")
def pdf_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = made(table(spark, sf_dir, "supplier", "s_suppkey").select("doc_id", "s_name", "s_nationkey"), survey_page)
    found = convert.as_json(*convert.parse_files(files))
    at = lambda path: F.get_json_object("json", path)
    blocks = F.json_array_length(at("$.blocks"))
    return found.select(
        F.col("doc_id").cast("bigint").alias("s_suppkey"), at("$.source.format").alias("format"), at("$.source.n_pages").cast("int").alias("n_pages"), blocks.alias("n_blocks"), at("$.blocks[0].text").alias("heading"),
        at("$.blocks[3].rows[0][0]").alias("first_cell"), at("$.blocks[2].items[1].marker").alias("marker"), F.json_array_length(at("$.warnings")).alias("n_warnings"), F.substring_index(at("$.markdown"), "\n", 1).alias("start"),
    )


@query("""SELECT s_suppkey, 'Survey of the northern rivers by ' || s_name || e || 'The first paragraph tells what the survey of ' || s_name || ' found and how' || e || '1. first measured station' || chr(10) || '2. second measured station' || e
    || 'Station' || chr(9) || 'Depth' || chr(10) || 'North' || chr(9) || s_nationkey || chr(10) || 'South' || chr(9) || '77' || e || 'Table 1. Depths at the stations of the survey.' AS text FROM (SELECT *, chr(10) || chr(10) AS e FROM supplier)""")
def pdf_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = made(table(spark, sf_dir, "supplier", "s_suppkey").select("doc_id", "s_name", "s_nationkey"), survey_page)
    _, blocks = convert.parse_files(files)
    return convert.plain_text(blocks).select(F.col("doc_id").cast("bigint").alias("s_suppkey"), "text")


def supplier_package(r: dict) -> bytes:
    name = r["s_name"]
    body = [
        paragraph(f"Dossier of {name}", "Title"), paragraph("The supplier answers within two days", note=4), paragraph("Duties", "Heading2"),
        paragraph("ships on time", num=1), paragraph(f"from nation {r['s_nationkey']}", num=1, level=1), paragraph("keeps records", num=1), paragraph("call first", num=2), paragraph("then write", num=2),
        cell_table([["Item", "Weight", "Place"], [("both columns", 2), "hall"], [name, "12", None], ["", "", ""]], header=True), paragraph("Goods and where they lie", "Caption"),
    ]
    return package(body, name, {3: "Never cited.", 4: "Counted in working days."})


@query("""SELECT s_suppkey, '# Dossier of ' || s_name || e || 'The supplier answers within two days[^1]' || e || '[^1]: Counted in working days.' || e || '## Duties' || e || '- ships on time' || chr(10) || '  - from nation ' || s_nationkey || chr(10) || '- keeps records' || e
    || '1. call first' || chr(10) || '2. then write' || e || '| Item | Weight | Place |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| both columns |  | hall |' || chr(10) || '| ' || s_name || ' | 12 |  |' || chr(10) || '|  |  |  |' || e || '*Goods and where they lie*' || chr(10) AS markdown
    FROM (SELECT *, chr(10) || chr(10) AS e FROM supplier)""")
def docx_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, notes, nested and numbered lists, merged cells and captions of packages."""
    files = made(table(spark, sf_dir, "supplier", "s_suppkey").select("doc_id", "s_name", "s_nationkey"), supplier_package)
    _, blocks = convert.parse_files(files)
    return convert.markdown(blocks).select(F.col("doc_id").cast("bigint").alias("s_suppkey"), "markdown")


def unstyled_package(r: dict) -> bytes:
    plain = f"Customer {r['c_name']} buys for the segment {r['c_mktsegment']} and pays when the goods are there"
    return package([paragraph(r["c_name"], size=18, bold=True), paragraph(plain), paragraph("Payment", size=14, bold=True), paragraph(plain), paragraph("Large item", size=18, bold=True, num=1), paragraph("Delivery", size=14, bold=True), paragraph(plain)])


@query("""SELECT c_custkey, unnest(['heading', 'paragraph', 'heading', 'paragraph', 'list', 'heading', 'paragraph']) AS type, unnest([0, 1, 2, 3, 4, 5, 6]) AS "order", unnest([1, NULL, 2, NULL, NULL, 2, NULL]) AS level,
    unnest([round(18 / 11.0, 3), 1.0, round(14 / 11.0, 3), 1.0, round(18 / 11.0, 3), round(14 / 11.0, 3), 1.0])::DOUBLE AS size_ratio FROM customer""")
def docx_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages without heading styles: levels by the rank of size and weight, list items left out."""
    files = made(table(spark, sf_dir, "customer", "c_custkey").select("doc_id", "c_name", "c_mktsegment"), unstyled_package)
    _, blocks = convert.parse_files(files)
    return blocks.select(F.col("doc_id").cast("bigint").alias("c_custkey"), "type", "order", "level", "style.size_ratio")


def audited_report(r: dict) -> bytes:
    name, nation = r["s_name"], r["s_nationkey"]
    return write([[
        text(72, 40, f"Confidential matter of {name}", 8), text(72, 120, f"Chapter {n} of the audit", 14, True),
        text(72, 150, f"On sheet {n} the auditors looked at {name} from nation {nation} and"), text(72, 164, f"found {n * 17} pallets with goods of every kind in the yard"), text(300, 760, str(n), 9),
    ] for n in (1, 2, 3)])


WORDS_OF = r"list_distinct(list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: length(w) > 3 AND w NOT IN ('with', 'were', 'that', 'this') AND NOT regexp_matches(w, '^\d+$')))"
SHEET = "'Chapter {n} of the audit' || {end} || 'On sheet {n} the auditors looked at ' || s_name || ' from nation ' || s_nationkey || ' and' || {gap} || 'found {pallets} pallets with goods of every kind in the yard'"
sheet = lambda n, end, gap: SHEET.format(n=n, pallets=n * 17, end=end, gap=gap)
MEASURED = f"""WITH t AS (SELECT s_suppkey, {" || chr(10) || ".join(f"'Confidential matter of ' || s_name || chr(10) || {sheet(n, 'chr(10)', 'chr(10)')} || chr(10) || '{n}'" for n in (1, 2, 3))} AS base,
    {" || chr(10) || chr(10) || ".join("'# ' || " + sheet(n, "chr(10) || chr(10)", "' '") for n in (1, 2, 3))} || chr(10) AS md FROM supplier),
w AS (SELECT s_suppkey, CAST(greatest(1, round_even(length(base) / 4.0, 0)) AS INT) AS baseline_tokens, CAST(greatest(1, round_even(length(md) / 4.0, 0)) AS INT) AS tokens, {WORDS_OF.format("base")} AS before, {WORDS_OF.format("md")} AS after FROM t),
m AS (SELECT s_suppkey, baseline_tokens, tokens, round(100.0 * (1 - tokens / baseline_tokens), 6) AS reduction, 3 AS headings, 0 AS tables, 0 AS footnotes, 6 AS blocks, round(len(list_intersect(before, after)) / len(before), 6) AS content_kept FROM w)"""


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.measured(made(table(spark, sf_dir, "supplier", "s_suppkey").select("doc_id", "s_name", "s_nationkey"), audited_report))


@query(MEASURED + "\nSELECT * FROM m")
def eval_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audited(spark, sf_dir)
    counts = [F.col(c).cast("int").alias(c) for c in ("headings", "tables", "footnotes", "blocks")]
    return found.select(F.col("doc_id").cast("bigint").alias("s_suppkey"), "baseline_tokens", "tokens", F.round("reduction", 6).alias("reduction"), *counts, F.round("content_kept", 6).alias("content_kept"))


@query(MEASURED + """\nSELECT CAST(sum(baseline_tokens) AS BIGINT) AS baseline_tokens, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(headings) AS BIGINT) AS headings, CAST(sum(blocks) AS BIGINT) AS blocks, round(median(reduction), 4) AS median_reduction,
    round(median(content_kept), 4) AS median_kept, round(min(content_kept), 4) AS worst_kept, round(100.0 * (1 - sum(tokens) / sum(baseline_tokens)), 4) AS corpus_reduction FROM m""")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = evaluate.report(audited(spark, sf_dir))
    return told.select("baseline_tokens", "tokens", "headings", "blocks", *(F.round(c, 4).alias(c) for c in ("median_reduction", "median_kept", "worst_kept", "corpus_reduction")))
