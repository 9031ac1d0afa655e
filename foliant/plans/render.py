"""Markdown of blocks and documents.

``blocks``: doc_id, order, type, level, text, rows, has_header, items, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import tables
from ..options import Options


def list_lines(items: Column, options: Options) -> Column:
    """Items by nesting level; ordered ones are counted anew for each level, and an
    ordered item ends the counts of deeper levels."""
    start = F.struct(F.lit("").alias("out"), F.array_repeat(F.lit(0), 32).alias("counts"))

    def add(state: Column, item: Column) -> Column:
        text = T.one_line(T.escape_markdown(item.getField("text")) if options.escape_markdown else item.getField("text"))
        level, counts = item.getField("level"), state.getField("counts")
        number = F.get(counts, level) + 1
        kept = F.transform(counts, lambda c, k: F.when(k == level, number).when(k > level, 0).otherwise(c))
        bullet = F.when(item.getField("ordered"), F.concat(number.cast("string"), F.lit("."))).otherwise("-")
        line = F.concat(F.repeat(F.lit("  "), level), bullet, F.lit(" "), text)
        out = F.concat(state.getField("out"), F.when(state.getField("out") == "", "").otherwise("\n"), line)
        new = F.struct(out.alias("out"), F.when(item.getField("ordered"), kept).otherwise(counts).alias("counts"))
        return F.when(text == "", state).otherwise(new)

    return F.aggregate(items, start, add, lambda state: state.getField("out"))


def note_lines(notes: Column) -> Column:
    return F.array_join(F.transform(notes, lambda n: F.concat(F.lit("[^"), n.getField("marker"), F.lit("]: "), T.one_line(n.getField("text")))), "\n")


def block_markdown(options: Options) -> Column:
    c = F.col
    plain = T.escape_markdown(c("text")) if options.escape_markdown else c("text")
    flat, caption = T.one_line(c("text")), T.one_line(plain)
    body = (
        F.when(c("type") == "heading", F.when(flat != "", F.concat(F.repeat(F.lit("#"), F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(6))), F.lit(" "), flat)).otherwise(""))
        .when(c("type") == "table", F.when(c("rows").isNotNull(), tables.rendered(c("rows"), c("has_header"), options.table_mode)).otherwise("" if options.table_mode == "drop" else plain))
        .when((c("type") == "list") & (F.size("items") > 0), list_lines(c("items"), options))
        .when(c("type") == "caption", F.when(caption != "", F.concat(F.lit("*"), caption, F.lit("*"))).otherwise(""))
        .when(c("type") == "code", F.concat(F.lit("```\n"), F.regexp_replace("text", r"\s+$", ""), F.lit("\n```")))
        .when(c("type") == "footnote", F.coalesce(note_lines(c("notes")), F.lit("")))
        .otherwise(plain)
    )
    if options.footnote_mode == "drop":
        return T.strip(F.regexp_replace(body, r"\[\^[^\]]{1,3}\]", ""))
    if options.footnote_mode == "inline":
        with_notes = (c("type") != "footnote") & (F.size("notes") > 0)
        return F.when(with_notes, F.concat_ws("\n\n", F.when(body != "", body), note_lines(c("notes")))).otherwise(body)
    return body


def document_markdown(blocks: DataFrame, options: Options | None = None) -> DataFrame:
    """``doc_id, markdown``: the blocks that are not empty, a blank line between them, one line end at the end."""
    options = options or Options()
    made = blocks.withColumn("_md", block_markdown(options))
    pieces = F.transform(F.array_sort(F.collect_list(F.when(T.strip(F.col("_md")) != "", F.struct("order", F.col("_md").alias("md"))))), lambda x: x.getField("md"))
    if options.footnote_mode == "end":
        notes = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("order", note_lines(F.col("notes")).alias("md")))), lambda x: x.getField("md")), lambda m: m != "")
        joined = made.groupBy("doc_id").agg(F.array_join(F.concat(pieces, F.when(F.size(notes) > 0, F.array(F.array_join(notes, "\n"))).otherwise(F.array().cast("array<string>"))), "\n\n").alias("markdown"))
    else:
        joined = made.groupBy("doc_id").agg(F.array_join(pieces, "\n\n").alias("markdown"))
    text = T.strip(F.col("markdown"))
    return joined.select("doc_id", F.when(text == "", "").otherwise(F.concat(text, F.lit("\n"))).alias("markdown"))
