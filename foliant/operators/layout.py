"""Page furniture, headings, reading order, captions and notes over tables of lines and blocks.

``lines``: doc_id, page, seq, text, x0, x1, top, bottom, size, bold and, where
named, height (of the page). Every operator keys by doc_id, so a corpus is one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..options import Options


def zone(options: Options) -> Column:
    """header or footer band that a line lies in, else null."""
    return F.when(F.col("bottom") <= options.header_band * F.col("height"), "header").when(F.col("top") >= (1 - options.footer_band) * F.col("height"), "footer")


def page_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("doc_id").agg(F.count_distinct("page").alias("_pages"))


def repeated_lines(lines: DataFrame, options: Options, pages: DataFrame | None = None) -> DataFrame:
    """``doc_id, zone, signature, n_pages`` of band lines that repeat on enough pages.
    ``pages`` (doc_id, _pages) counts pages without lines too, where they are known."""
    pages = page_counts(lines) if pages is None else pages
    banded = lines.select("doc_id", "page", zone(options).alias("zone"), T.repeat_signature(F.col("text")).alias("signature")).where("zone IS NOT NULL AND signature != ''")
    counted = banded.groupBy("doc_id", "zone", "signature").agg(F.count_distinct("page").alias("n_pages"))
    limit = F.greatest(F.lit(options.artifact_min_pages), F.ceil(options.artifact_page_ratio * F.col("_pages")))
    return counted.join(pages.where("_pages >= 2"), "doc_id").where(F.col("n_pages") >= limit).drop("_pages")


def page_numbers(lines: DataFrame, options: Options, pages: DataFrame | None = None) -> DataFrame:
    """``doc_id, page, seq`` of band lines that are page numbers: numbers that
    advance by one to three from each to the next, or enough that carry no plain number."""
    pages = page_counts(lines) if pages is None else pages
    found = lines.withColumn("zone", zone(options)).where(F.col("zone").isNotNull() & T.looks_like_page_number(F.col("text")))
    found = found.withColumn("value", F.regexp_extract("text", r"^\D*(\d{1,4})\D*$", 1).try_cast("int"))
    band, kind = Window.partitionBy("doc_id", "zone"), Window.partitionBy("doc_id", "zone", F.col("value").isNull())
    delta = F.col("value") - F.lag("value").over(kind.orderBy("page", "value"))
    found = found.withColumn("_n", F.count("*").over(band)).withColumn("_delta", delta).join(pages.where("_pages >= 2"), "doc_id").where("_n >= 2")
    found = found.withColumn("_of_kind", F.count("*").over(kind)).withColumn("_low", F.min("_delta").over(kind)).withColumn("_high", F.max("_delta").over(kind))
    advances = F.col("value").isNotNull() & (F.col("_of_kind") >= 2) & (F.col("_low") >= 1) & (F.col("_high") <= 3)
    plain = F.col("value").isNull() & (F.col("_of_kind") >= F.greatest(F.lit(2), F.floor(F.col("_pages") / 2)))
    return found.where(advances | plain).select("doc_id", "page", "seq")


def floating_repeats(lines: DataFrame, bodies: DataFrame, options: Options, pages: DataFrame | None = None) -> DataFrame:
    """``doc_id, page, seq`` of small print that repeats word for word at one height
    on enough pages, wherever it stands; the first copy of each page."""
    pages = page_counts(lines) if pages is None else pages
    same = T.strip(F.lower(T.one_line(F.col("text"))))
    small = lines.join(bodies, "doc_id").where((F.col("body") > 0) & (F.col("size") <= 0.95 * F.col("body")) & (F.length(T.strip(F.col("text"))).between(1, 80)) & T.caption_label(F.col("text")).isNull())
    first = small.withColumn("_same", same).groupBy("doc_id", "_same", "page").agg(F.min("seq").alias("seq"), F.min_by("top", "seq").alias("top"))
    of = Window.partitionBy("doc_id", "_same")
    first = first.select("*", F.count("*").over(of).alias("_n"), (F.max("top").over(of) - F.min("top").over(of)).alias("_spread")).join(pages.where("_pages >= 2"), "doc_id")
    limit = F.greatest(F.lit(options.artifact_min_pages), F.ceil(options.artifact_page_ratio * F.col("_pages")))
    return first.where((F.col("_n") >= limit) & (F.col("_spread") <= 18)).select("doc_id", "page", "seq")


def furniture(lines: DataFrame, bodies: DataFrame, options: Options, pages: DataFrame | None = None) -> DataFrame:
    """``doc_id, page, seq, artifact`` of lines that are running headers, footers or
    page numbers; repeated lines first, then numbers, then floating small print.
    Each step has rows of every document, so none is broadcast to the next."""
    key = ["doc_id", "page", "seq"]
    signed = lines.withColumn("zone", zone(options)).withColumn("signature", T.repeat_signature(F.col("text")))
    repeated = signed.join(repeated_lines(lines, options, pages).hint("merge"), ["doc_id", "zone", "signature"]).select(*key, F.col("zone").alias("artifact"))
    rest = lines.join(repeated.hint("merge"), key, "left_anti")
    numbers = page_numbers(rest, options, pages).withColumn("artifact", F.lit("page_number"))
    floating = floating_repeats(rest.join(numbers.hint("merge"), key, "left_anti"), bodies, options, pages).withColumn("artifact", F.lit("header"))
    return repeated.unionByName(numbers).unionByName(floating)


def body_zone(lines: DataFrame, options: Options) -> DataFrame:
    """Lines outside the bands for headers and footers; all lines of documents that have none."""
    inside = zone(options).isNull()
    return lines.withColumn("_any", F.max(inside).over(Window.partitionBy("doc_id"))).where(inside | ~F.col("_any")).drop("_any")


def note_lines(lines: DataFrame, bodies: DataFrame, options: Options) -> DataFrame:
    """``doc_id, page, seq, note, marker, rest`` of lines that are footnotes: small
    print below all lines of body size, in the lower part of the page, of which the first opens
    with a marker. ``note`` numbers the notes of a page, ``rest`` is the line's text."""
    page = Window.partitionBy("doc_id", "page")
    down = page.orderBy("top", "x0", "seq")
    small = F.col("size") <= 0.94 * F.col("body")
    lowest = F.greatest(F.coalesce(F.max(F.when(~small, F.col("bottom"))).over(page), F.lit(0.0)), 0.55 * F.col("height"))
    found = lines.join(bodies, "doc_id").withColumn("_from", lowest)
    found = found.where((F.col("top") >= F.col("_from") - 1) & small & (T.strip(F.col("text")) != "") & ~T.looks_like_page_number(F.col("text")))
    found = found.withColumn("_open", note_opener(F.col("words"), F.col("text")))
    found = found.withColumn("note", F.sum(F.col("_open").isNotNull().cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_head", F.first(F.col("_open").isNotNull()).over(down))
    return found.where("_head").select("doc_id", "page", "seq", "top", "x0", "note", F.col("_open.marker").alias("marker"), F.coalesce("_open.rest", T.strip(F.col("text"))).alias("rest"))


NOTE_MARK = r"\d{1,3}|[*†‡§¶#]{1,3}"


def marker_of(text: Column) -> Column:
    """The note that a superscript refers to, without punctuation around it, else null."""
    bare = F.regexp_replace(F.regexp_replace(T.strip(text), r"^[.,;:)\]]+", ""), r"[.,;:)\]]+$", "")
    return F.when((F.length(bare) <= 3) & bare.rlike(f"^(?:{NOTE_MARK})$"), bare)


def note_opener(words: Column, text: Column) -> Column:
    """``marker, rest`` of a line that opens a note: a raised first word, or a marker before text; else null."""
    first = F.get(words, F.lit(0))
    raised = F.when(first.getField("sup"), marker_of(first.getField("text")))
    after = T.strip(F.array_join(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: w.getField("text")), " "))
    plain = rf"(?s)^\s*({NOTE_MARK})[.)\]]?\s+(\S.*)$"
    by_text = F.when(text.rlike(plain), F.struct(F.regexp_extract(text, plain, 1).alias("marker"), T.strip(F.regexp_extract(text, plain, 2)).alias("rest")))
    return F.when(raised.isNotNull(), F.when(after != "", F.struct(raised.alias("marker"), after.alias("rest")))).otherwise(by_text)


def page_notes(note_rows: DataFrame) -> DataFrame:
    """``doc_id, page, marker, text, seq``: notes from their lines."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "seq", "rest"))), lambda x: x.getField("rest"))
    notes = note_rows.groupBy("doc_id", "page", "note").agg(F.max("marker").alias("marker"), T.strip(F.array_join(texts, " ")).alias("text"))
    return notes.where("text != ''").select("doc_id", "page", "marker", "text", F.col("note").alias("seq"))


def text_with_references(words: Column, markers: Column) -> Column:
    """Words of a line, raised ones that name a note of the page as ``[^n]`` behind the word before."""

    def add(out: Column, w: Column) -> Column:
        marker = F.when(w.getField("sup"), marker_of(w.getField("text")))
        cited = F.coalesce(F.array_contains(markers, marker), F.lit(False))
        return F.when(cited, F.concat(out, F.lit("[^"), marker, F.lit("]"))).when(out == "", w.getField("text")).otherwise(F.concat_ws(" ", out, w.getField("text")))

    return F.aggregate(words, F.lit(""), add)


def body_sizes(lines: DataFrame, least_chars: int = 25, spaces: bool = False, default: float = 10.0) -> DataFrame:
    """``doc_id, body``: the size that most characters (with ``spaces`` or without)
    have, of lines long enough if there are any; the smaller one on a tie."""
    n = F.length("text") if spaces else F.length(F.regexp_replace("text", " ", ""))
    voting = lines.select("doc_id", F.round("size", 1).alias("size"), n.alias("n"), (n >= least_chars).alias("long"))
    votes = voting.groupBy("doc_id", "size").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("long"), F.col("n"))).alias("some"))
    best = lambda w: F.max_by("size", F.struct(F.col(w), -F.col("size")))
    return votes.groupBy("doc_id").agg(F.coalesce(F.when(F.max("some").isNotNull(), F.max_by("size", F.when(F.col("some").isNotNull(), F.struct("some", -F.col("size"))))), best("all"), F.lit(default)).alias("body"))


def heading_candidate(options: Options, small_numbers: bool = True) -> Column:
    """Whether a line may be a heading, by its text, size, weight and the ``body`` size; ``saturated``: bold is common.
    With ``small_numbers`` bold lines with a section number may be, however small they are."""
    c, s = F.col, T.strip(F.col("text"))
    ratio = c("size") / c("body")
    marker = T.list_marker(c("text"))
    numbered = T.number_depth(c("text")).isNotNull()
    bold = c("bold") & ~c("saturated")
    distinct = bold | (ratio >= options.min_heading_ratio)
    caps = (s == F.upper(s)) & s.rlike(r"\p{L}") & (F.length(s) <= 90) & (ratio >= 0.98)
    return (
        F.when((s == "") | (F.length(s) > options.max_heading_chars), False)
        .when(marker.isNotNull() & ~marker.getField("ordered"), False)
        .when(marker.isNotNull() & ~distinct, False)
        .when(T.is_sentence_like(c("text")) & (ratio < 1.45), False)
        .when(ratio >= options.min_heading_ratio, True)
        .when(bold & (ratio >= 0.98), True)
        .when(numbered & distinct & F.lit(small_numbers), True)
        .otherwise(caps)
    )


def heading_model(lines: DataFrame, bodies: DataFrame, options: Options, numbers: bool = True, small_numbers: bool = True) -> DataFrame:
    """``doc_id, page, seq, level`` of headings, with the body size given: the rank of
    their style, larger and bold first, among the styles of the document's candidates.
    With ``numbers`` section numbers are trusted where enough of the candidates carry
    them. Lines with a true ``listed`` have a say in what is common, but are no candidates.
    ``small_numbers`` as in ``heading_candidate``."""
    doc = Window.partitionBy("doc_id")
    judged = lines.withColumn("saturated", F.avg(F.col("bold").cast("int")).over(doc) > 0.55).join(bodies, "doc_id").where(heading_candidate(options, small_numbers))
    if "listed" in lines.columns:
        judged = judged.where(~F.col("listed"))
    depth = T.number_depth(F.col("text"))
    rank = F.dense_rank().over(doc.orderBy(F.round("size", 1).desc(), F.col("bold").desc()))
    numbered = F.count(depth).over(doc)
    trust = (numbered >= 2) & (numbered >= 0.4 * F.count("*").over(doc)) if numbers else F.lit(False)
    judged = judged.withColumn("_rank", rank).withColumn("_trust", trust)
    level = F.when(F.col("_trust") & depth.isNotNull(), depth).otherwise(F.col("_rank"))
    return judged.select("doc_id", "page", "seq", F.least(level, F.lit(options.max_heading_level)).cast("int").alias("level"))


def normalized_levels(headings: DataFrame) -> DataFrame:
    """Levels without gaps: the rank of each among those that the document uses."""
    return headings.withColumn("level", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("level")))


def reading_order(items: DataFrame) -> DataFrame:
    """``order`` within a page of columns: items that span the page (column -1) cut
    it into bands, and within a band columns are read one after the other."""
    down = Window.partitionBy("doc_id", "page").orderBy("top", "x0", "seq")
    full = (F.col("column") < 0).cast("int")
    band = F.coalesce(F.sum(full).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    final = Window.partitionBy("doc_id", "page").orderBy("_band", "_full", "column", "top", "x0", "seq")
    return items.withColumn("_band", band).withColumn("_full", full).withColumn("order", F.row_number().over(final) - 1).drop("_band", "_full")


def nearest_tables(captions: DataFrame, tables: DataFrame, reach: float = 72.0) -> DataFrame:
    """``doc_id, caption_order, table_order``: for each caption the table of its page
    whose edge is nearest, under ``reach`` points; the earlier one on a tie."""
    distance = F.least(F.abs(F.col("c.top") - F.col("t.bottom")), F.abs(F.col("t.top") - F.col("c.bottom")))
    pairs = captions.alias("c").join(tables.alias("t").hint("merge"), ["doc_id", "page"]).select("doc_id", F.col("c.order").alias("caption_order"), F.col("t.order").alias("table_order"), distance.alias("distance"))
    return pairs.where(F.col("distance") < reach).groupBy("doc_id", "caption_order").agg(F.min_by("table_order", F.struct("distance", "table_order")).alias("table_order"))


def attach_notes(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """``doc_id, page, marker, text, order, orphan``: each note with the first block of
    its page that refers to it, or else the page's last block. Of repeated markers
    the last text counts; notes of pages without blocks are lost."""
    marks = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\^([^\]]{1,3})\]"), F.lit(1))))
    cited = blocks.select("doc_id", "page", "order", marks.alias("marker")).groupBy("doc_id", "page", "marker").agg(F.min("order").alias("cited"))
    last = blocks.groupBy("doc_id", "page").agg(F.max("order").alias("last"))
    own = notes.groupBy("doc_id", "page", "marker").agg(F.max_by("text", "seq").alias("text"))
    both = own.join(last.hint("merge"), ["doc_id", "page"]).join(cited.hint("merge"), ["doc_id", "page", "marker"], "left")
    return both.select("doc_id", "page", "marker", "text", F.coalesce("cited", "last").alias("order"), F.col("cited").isNull().alias("orphan"))
