"""From files to blocks: PDF pages through page operators and document-wide plans; DOCX packages; both together.

Page-wide work runs in three Arrow steps (lines and ruled grids, aligned grids,
grouping to blocks); everything that looks at a document is a DataFrame plan
between them, keyed by doc_id. The lines are written once, as six plans read
different columns of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators import layout as L
from ..operators import pages as P
from ..options import Options
from ..sources import docx, pdf
from .render import block_markdown, document_markdown
from .storage import stored

WORD = "struct<text:string,x0:double,top:double,x1:double,bottom:double,size:double,font:string,bold:boolean,italic:boolean,sup:boolean>"
BODY = (
    "kind string, x0 double, top double, x1 double, bottom double, column int, n_columns int, text string, size double, font string, bold_ratio double, italic_ratio double, "
    f"words array<{WORD}>, rows array<array<string>>, has_header boolean, ruled boolean, artifact string"
)
ELEMENT = f"doc_id string, page int, seq int, width double, height double, {BODY}"
ABOUT = "n_pages int, n_glyphs int, title string, author string, producer string, error string, warning string"
UNIT = "doc_id string, page int, pos int, unit int, kind string, item int"
KEY = ["doc_id", "page", "seq"]


def arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def elements(pages: DataFrame, options: Options) -> DataFrame:
    """Lines and ruled tables from page rows; no page needs another, so nothing is shuffled."""
    schema = arrow(ELEMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (page,) = batch.slice(k, 1).to_pylist()
                same = {c: page[c] for c in ("doc_id", "page", "width", "height")}
                found = P.page_elements(page["glyphs"], page["edges"], page["width"], options)
                if found:
                    yield pa.RecordBatch.from_pylist([same | {"seq": n} | r for n, r in enumerate(found)], schema=schema)

    return pages.where("page IS NOT NULL AND width IS NOT NULL").select("doc_id", "page", "width", "height", "glyphs", "edges").mapInArrow(run, ELEMENT)


def read_pdf(files: DataFrame, options: Options) -> DataFrame:
    """Elements straight from files (doc_id, content), and a row of kind ``page`` for
    each page and each file without pages. Glyphs stay in the worker that decodes
    their page: they are a hundred times the lines and nothing else needs them."""
    schema = arrow(f"{ELEMENT}, {ABOUT}")

    def rows_of(page: dict) -> Iterator[dict]:
        about = {k: page.get(k) for k in ("doc_id", "page", "width", "height")}
        yield about | {"kind": "page", "n_glyphs": len(page.get("glyphs") or ())} | {k: page.get(k) for k in ("n_pages", "title", "author", "producer", "error", "warning")}
        for n, r in enumerate(P.page_elements(page.get("glyphs"), page.get("edges"), page.get("width") or 0.0, options)):
            yield about | {"seq": n} | r

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for doc_id, content in zip(batch.column(0), batch.column(1), strict=True):
                for page in pdf.page_rows(doc_id.as_py(), content.as_py(), options.pages, options.password):
                    held += rows_of(page)
                    if len(held) >= 1000:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return files.select("doc_id", "content").mapInArrow(run, f"{ELEMENT}, {ABOUT}")


def lines_of(found: DataFrame) -> DataFrame:
    return found.where("kind = 'line'").withColumn("bold", F.coalesce(F.col("bold_ratio") >= 0.6, F.lit(False)))


def with_aligned_tables(found: DataFrame, options: Options) -> DataFrame:
    """Elements of all pages once aligned lines have become tables, numbered anew."""
    schema = arrow(ELEMENT)
    columns = [f.name for f in schema]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
        same = {c: rows[0][c] for c in ("doc_id", "page", "width", "height")}
        out = P.second_look(rows, same["height"], options)
        return pa.Table.from_pylist([{c: None for c in columns} | r | same | {"seq": n} for n, r in enumerate(out)], schema=schema)

    return found.select(*columns).groupBy("doc_id", "page").applyInArrow(run, ELEMENT)


def grouped(ordered: DataFrame, options: Options) -> DataFrame:
    """The block of each element; only measures go to Python, no texts."""
    schema = arrow(UNIT)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["pos"])
        grouping = P.Grouping(options)
        out = []
        for r in rows:
            unit, kind, item = grouping.add(r)
            out.append({"doc_id": r["doc_id"], "page": r["page"], "pos": r["pos"], "unit": unit, "kind": kind, "item": item})
        return pa.Table.from_pylist(out, schema=schema)

    return ordered.groupBy("doc_id", "page").applyInArrow(run, UNIT)


def joined_lines(texts: Column, options: Options) -> Column:
    """Lines to one text, words that are broken at a line end made whole."""

    def add(out: Column, line: Column) -> Column:
        whole = T.join_hyphenated(out, line) if options.dehyphenate else F.lit(None).cast("string")
        return F.when(line == "", out).when(out == "", line).otherwise(F.coalesce(whole, F.concat_ws(" ", out, line)))

    return F.aggregate(F.transform(texts, T.strip), F.lit(""), add)


def list_items(lines: Column) -> Column:
    """Items of a list from its lines (pos, item, x0, marker, ordered, text): levels
    by indents that are over six points apart, empty items left out."""
    heads = F.filter(lines, lambda x: x.getField("marker").isNotNull())
    indents = F.array_sort(F.transform(heads, lambda x: x.getField("x0")))
    far = lambda stops, x: (F.size(stops) == 0) | (x > F.element_at(stops, -1) + 6.0)
    stops = F.aggregate(indents, F.array().cast("array<double>"), lambda s, x: F.when(far(s, x), F.concat(s, F.array(x))).otherwise(s))
    level = lambda x: F.size(F.filter(stops, lambda s: s + 6.0 < x))
    items = F.transform(
        heads,
        lambda h: F.struct(
            T.strip(F.array_join(F.transform(F.filter(lines, lambda x: x.getField("item") == h.getField("item")), lambda x: x.getField("text")), " ")).alias("text"),
            F.least(level(h.getField("x0")), F.size(stops) - 1).alias("level"), h.getField("marker").alias("marker"), h.getField("ordered").alias("ordered"),
        ),
    )
    return F.filter(items, lambda x: x.getField("text") != "")


def pdf_blocks(pages: DataFrame, options: Options | None = None) -> DataFrame:
    """Blocks of PDF documents from page rows with glyphs. Null and empty pages give
    no blocks; repeated doc_ids count as one document."""
    options = options or Options()
    whole = pages.where("page IS NOT NULL AND width IS NOT NULL")
    return element_blocks(stored(elements(pages, options), "elements"), whole.groupBy("doc_id").agg(F.count_distinct("page").alias("_pages")), options)[0]


def element_blocks(found: DataFrame, counts: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """Blocks from the elements of pages and the number of pages of each document;
    and ``doc_id, stripped``, how many running lines were left out of them."""
    c = F.col
    lines = lines_of(found)
    bodies = L.body_sizes(L.body_zone(lines, options))
    notes, rest = None, found
    if options.detect_footnotes:
        note_rows = stored(L.note_lines(lines, bodies, options), "notes")
        notes = L.page_notes(note_rows)
        rest = rest.join(note_rows.select(*KEY), KEY, "left_anti")
    tagged = stored(L.furniture(lines_of(rest), bodies, options, counts), "furniture")
    stripped = tagged.groupBy("doc_id").agg(F.count("*").alias("stripped"))
    if options.keep_headers:
        stripped = stripped.limit(0)
    if options.keep_headers:
        rest = rest.drop("artifact").join(tagged, KEY, "left")
    else:
        rest = rest.join(tagged, KEY, "left_anti")
    rest = stored(with_aligned_tables(rest, options), "grids")

    lines = lines_of(rest)
    bodies = L.body_sizes(L.body_zone(lines, options))
    if options.detect_headings:
        rest = rest.join(L.heading_model(lines, bodies, options), KEY, "left")
    else:
        rest = rest.withColumn("level", F.lit(None).cast("int"))
    if notes is not None:
        known = notes.groupBy("doc_id", "page").agg(F.collect_set("marker").alias("_markers"))
        rest = rest.join(known, ["doc_id", "page"], "left")
        cited = L.text_with_references(c("words"), F.coalesce("_markers", F.array().cast("array<string>")))
        rest = rest.withColumn("text", F.when(c("kind") == "line", cited))
    marker = T.list_marker(c("text"))
    ordered = L.reading_order(rest).withColumnRenamed("order", "pos").withColumn("bold", F.coalesce(c("bold_ratio") >= 0.6, F.lit(False)))
    ends = F.when(c("level").isNotNull(), T.strip(c("text")).rlike("[.!?:]$")).otherwise(T.strip(c("text")).rlike("[.!?\"”’)]$"))
    ordered = ordered.withColumn("_mark", marker).withColumn("is_item", c("_mark").isNotNull() & F.lit(options.detect_lists))
    ordered = ordered.where((c("kind") == "table") | (T.strip(c("text")) != ""))
    ordered = stored(ordered.withColumn("closes", F.coalesce(ends, F.lit(False))), "ordered")
    units = grouped(ordered.select("doc_id", "page", "pos", "kind", "artifact", "level", c("is_item").alias("item"), "x0", "x1", "top", "bottom", "column", "size", "bold", "closes"), options)
    both = ordered.drop("kind").join(units, ["doc_id", "page", "pos"])
    line = F.struct(
        "pos", "item", "x0", F.when(c("is_item"), c("_mark.marker")).alias("marker"), c("_mark.ordered").alias("ordered"),
        F.when((c("kind") == "list") & c("is_item"), c("_mark.rest")).otherwise(c("text")).alias("text"),
    )
    first = lambda name: F.min_by(name, "pos").alias(name)
    blocks = both.groupBy("doc_id", "page", "unit").agg(
        first("kind"), first("level"), first("artifact"), first("size"), first("bold_ratio"), first("italic_ratio"), first("font"), first("rows"), first("has_header"), first("ruled"),
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.array_sort(F.collect_list(line)).alias("_lines"),
    )
    texts = F.transform("_lines", lambda x: x.getField("text"))
    blocks = blocks.withColumn("items", F.when(c("kind") == "list", list_items(c("_lines"))))
    listed = F.transform("items", lambda x: F.concat(F.repeat(F.lit("  "), x.getField("level")), F.when(x.getField("ordered"), F.concat(x.getField("marker"), F.lit(". "))).otherwise("- "), x.getField("text")))
    text = F.when(c("kind") == "list", F.array_join(listed, "\n")).when(c("kind") == "table", F.array_join(F.transform("rows", lambda r: F.array_join(r, "\t")), "\n")).otherwise(joined_lines(texts, options))
    blocks = blocks.withColumn("text", text).where((c("text") != "") | (c("kind") == "table"))
    label = T.caption_label(c("text")) if options.detect_captions else F.lit(None).cast("struct<kind:string,label:string>")
    blocks = blocks.withColumn("_label", F.when(c("kind") == "paragraph", label))
    blocks = blocks.withColumn("type", F.when(c("_label").isNotNull(), "caption").when(c("kind") == "artifact", "paragraph").otherwise(c("kind")))
    if options.normalize_heading_levels:
        rank = F.dense_rank().over(Window.partitionBy("doc_id", c("type") == "heading").orderBy("level"))
        blocks = blocks.withColumn("level", F.when(c("type") == "heading", rank))
    level = F.when(c("type") == "heading", c("level")).when(c("type") == "list", F.array_max(F.transform("items", lambda x: x.getField("level"))) + 1)
    blocks = blocks.withColumn("order", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "unit")) - 1)
    blocks = blocks.join(bodies, "doc_id", "left").select(
        "doc_id", "order", "page", "type", level.cast("int").alias("level"), "text", "x0", "top", "x1", "bottom",
        F.when(c("size").isNotNull(), F.struct("size", F.round(c("size") / c("body"), 3).alias("size_ratio"), "bold_ratio", "italic_ratio", "font")).alias("style"),
        "rows", "has_header", "ruled", "items", "artifact", c("_label.kind").alias("caption_kind"), c("_label.label").alias("label"),
    )
    return with_captions(with_notes(stored(blocks, "blocks"), notes)).withColumn("source_style", F.lit(None).cast("string")), stripped


NOTES = "array<struct<marker:string,text:string>>"


def with_notes(blocks: DataFrame, notes: DataFrame | None) -> DataFrame:
    """``notes`` and ``orphan_footnotes`` of each block, in the order of its references."""
    if notes is None:
        return blocks.withColumn("notes", F.lit(None).cast(NOTES)).withColumn("orphan_footnotes", F.lit(None).cast("array<string>"))
    attached = L.attach_notes(blocks.select("doc_id", "page", "order", "text"), notes).select("doc_id", "order", "marker", F.col("text").alias("note"), "orphan")
    entry = F.struct("orphan", F.position(F.concat(F.lit("[^"), "marker", F.lit("]")), "text").alias("at"), "marker", "note")
    own = attached.join(blocks.select("doc_id", "order", "text").hint("merge"), ["doc_id", "order"]).groupBy("doc_id", "order").agg(F.array_sort(F.collect_list(entry)).alias("_notes"))
    pairs = F.transform("_notes", lambda n: F.struct(n.getField("marker").alias("marker"), n.getField("note").alias("text")))
    lost = F.transform(F.filter("_notes", lambda n: n.getField("orphan")), lambda n: n.getField("marker"))
    return blocks.join(own.hint("merge"), ["doc_id", "order"], "left").withColumn("notes", pairs).withColumn("orphan_footnotes", F.when(F.size(lost) > 0, lost)).drop("_notes")


def with_captions(blocks: DataFrame) -> DataFrame:
    """``target_order`` of captions, and ``caption`` and ``label`` of the tables they belong to: the last caption's text, the first one's label."""
    captions = blocks.where("caption_kind = 'table'").select("doc_id", "page", "order", "top", "bottom", "text", "label")
    links = L.nearest_tables(captions.select("doc_id", "page", "order", "top", "bottom"), blocks.where("type = 'table'").select("doc_id", "page", "order", "top", "bottom"))
    named = links.join(captions.select("doc_id", F.col("order").alias("caption_order"), "text", F.col("label").alias("_label")).hint("merge"), ["doc_id", "caption_order"])
    told = named.groupBy("doc_id", F.col("table_order").alias("order")).agg(F.max_by("text", "caption_order").alias("caption"), F.min_by("_label", "caption_order").alias("_label"))
    targets = links.select("doc_id", F.col("caption_order").alias("order"), F.col("table_order").alias("target_order"))
    out = blocks.join(told.hint("merge"), ["doc_id", "order"], "left").join(targets.hint("merge"), ["doc_id", "order"], "left")
    return out.withColumn("label", F.coalesce("label", "_label")).drop("_label")


COMMON = ("doc_id", "order", "page", "type", "level", "text", "rows", "has_header", "items", "notes", "style", "ruled", "artifact", "caption_kind", "label", "caption", "target_order", "orphan_footnotes", "source_style")


def formats(files: DataFrame) -> DataFrame:
    """``format`` of each file by its content: pdf, docx, zip or unknown. Only the
    head and, for archives, whether the part name occurs are looked at, in the JVM."""
    head = F.substring("content", 1, 2048)
    is_zip = F.startswith(head, F.lit(b"PK\x03\x04"))
    docx_part = F.contains("content", F.lit(b"word/document.xml"))
    kind = F.when(F.contains(head, F.lit(b"%PDF")), "pdf").when(is_zip & docx_part, "docx").when(is_zip, "zip").otherwise("unknown")
    return files.withColumn("format", kind)


def parse_files(files: DataFrame, options: Options | None = None, format: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(documents, blocks)`` of files (doc_id, content) by their content, or all as
    ``format``. Documents that can't be read have an ``error`` and no blocks."""
    options = options or Options()
    known = files.select(F.col("doc_id").cast("string").alias("doc_id"), "content")
    known = formats(known) if format is None else known.withColumn("format", F.lit(format.lower().lstrip(".")))
    found = stored(read_pdf(known.where("format = 'pdf'"), options), "elements")
    pages = found.where("kind = 'page'")
    packages = stored(docx.decode(known.where("format = 'docx'")), "packages")
    own = docx.blocks_of(packages, options).withColumn("caption_kind", F.col("caption.kind")).withColumn("label", F.col("caption.label")).drop("caption")
    made, stripped = element_blocks(found.where("kind != 'page'"), pages.where("width IS NOT NULL").groupBy("doc_id").agg(F.count_distinct("page").alias("_pages")), options)
    blocks = made.unionByName(own, allowMissingColumns=True).select(*COMMON)
    with_lines = found.where("kind != 'page'").groupBy("doc_id", "page").agg(F.lit(True).alias("filled"))
    empty = F.col("width").isNotNull() & F.col("filled").isNull()
    blank = F.array_sort(F.collect_list(F.when(empty, F.col("page"))))
    tail = F.concat(F.array_join(F.slice(blank, 1, 8), ", "), F.when(F.size(blank) > 8, ", ...").otherwise(""))
    told = F.when(F.size(blank) > 0, F.concat(F.size(blank).cast("string"), F.lit(" pages with no extractable text: "), tail))
    about = pages.join(with_lines, ["doc_id", "page"], "left").groupBy("doc_id").agg(
        F.max("n_pages").alias("n_pages"), F.max("title").alias("title"), F.max("author").alias("author"), F.max("producer").alias("producer"),
        F.array_compact(F.concat(F.array_sort(F.collect_list("warning")), F.array(told))).alias("warnings"), F.max("error").alias("error"),
    )
    failed = packages.where("error IS NOT NULL").select("doc_id", F.concat(F.lit("ParseError: "), "error").alias("docx_error"))
    told_by = [F.get(F.get("rows", F.lit(0)), F.lit(k)).alias(f"_{name}") for k, name in enumerate(("title", "author", "producer"))]
    core = packages.where("kind = 'about'").select("doc_id", *told_by, F.get("rows", F.lit(1)).alias("_warnings"))
    running = F.concat(F.lit("stripped "), F.col("stripped").cast("string"), F.lit(" running header/footer line(s); pass keep_headers=True to retain them"))
    stripped = stripped.select("doc_id", running.alias("_running"))
    none = F.array().cast("array<string>")
    other = F.when(~F.col("format").isin("pdf", "docx"), F.concat(F.lit("UnsupportedFormatError: "), "format"))
    documents = known.select("doc_id", "format")
    for known_of in (about, failed, core, stripped):
        documents = documents.join(known_of.hint("merge"), "doc_id", "left")
    told_of = F.array_compact(F.concat(F.coalesce("warnings", none), F.coalesce("_warnings", none), F.array("_running")))
    documents = documents.withColumn("warnings", told_of).drop("_warnings", "_running")
    for name in ("title", "author", "producer"):
        documents = documents.withColumn(name, F.coalesce(name, f"_{name}")).drop(f"_{name}")
    return documents.withColumn("error", F.coalesce("error", "docx_error", other)).drop("docx_error"), blocks


def parse(spark: SparkSession, path: str, options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """``(documents, blocks)`` of all files under a path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return parse_files(found.where(F.lower("path").rlike(r"\.(pdf|docx)$")).select(F.col("path").alias("doc_id"), "content"), options)


def markdown(blocks: DataFrame, options: Options | None = None) -> DataFrame:
    return document_markdown(blocks, options)


def outline(blocks: DataFrame) -> DataFrame:
    """``doc_id, order, level, text`` of headings."""
    return blocks.where("type = 'heading'").select("doc_id", "order", F.coalesce("level", F.lit(1)).alias("level"), "text")


def plain_text(blocks: DataFrame) -> DataFrame:
    """``doc_id, text``: texts of blocks that are not empty, a blank line between them."""
    pieces = F.array_sort(F.collect_list(F.when(T.strip(F.col("text")) != "", F.struct("order", "text"))))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(pieces, lambda x: x.getField("text")), "\n\n").alias("text"))


def footnotes(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "order", F.posexplode("notes").alias("k", "note")).select("doc_id", "order", "k", "note.marker", "note.text")


def as_json(documents: DataFrame, blocks: DataFrame, options: Options | None = None) -> DataFrame:
    """``doc_id, json``: a document with its Markdown and all its blocks, each with its own in default options."""
    told = [c for c in COMMON if c not in ("doc_id", "order")]
    own = blocks.withColumn("markdown", block_markdown(Options())).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("order", *told, "markdown"))).alias("blocks"))
    both = documents.join(markdown(blocks, options), "doc_id", "left").join(own, "doc_id", "left")
    return both.select("doc_id", F.to_json(F.struct("markdown", F.struct("format", "n_pages", "title", "author", "producer").alias("source"), "warnings", "error", "blocks"), {"ignoreNullFields": "false"}).alias("json"))
