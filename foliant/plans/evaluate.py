"""How conversion compares with plain extraction of text, over a corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..options import Options
from ..sources import docx
from . import convert
from .storage import stored


def plain_extraction(files: DataFrame) -> DataFrame:
    """``doc_id, text``: page texts line by line, paragraph texts of packages (their tables are lost)."""
    known = convert.formats(files)
    lines = convert.lines_of(convert.read_pdf(known.where("format = 'pdf'"), Options())).select("doc_id", F.struct("page", "seq").alias("at"), "text")
    paragraphs = docx.decode(known.where("format = 'docx'")).where("kind = 'p'").select("doc_id", F.struct(F.lit(0).alias("page"), F.col("pos").alias("seq")).alias("at"), "text")
    both = lines.unionByName(paragraphs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("all"))
    return both.select("doc_id", F.array_join(F.transform("all", lambda x: x.getField("text")), "\n").alias("text"))


def reduction(before: Column, after: Column) -> Column:
    """Per cent saved; 0 where there was nothing."""
    return F.when(before == 0, 0.0).otherwise(100.0 * (1 - after / before))


def token_counter(vocabulary: str | None = None) -> Callable[[Column], Column]:
    """Tokens of a text: by the tokenizers JSON file that ``vocabulary`` names, which the
    driver reads and workers get with the function, or else a token for four characters."""
    if vocabulary is None:
        return T.token_estimate
    with open(vocabulary, encoding="utf-8") as file:
        made = file.read()

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(made)
        own.encode_special_tokens = True
        for texts in batches:
            yield pd.Series([len(e.ids) for e in own.encode_batch(texts.tolist(), add_special_tokens=False)], dtype="int32")

    return count


def measured(files: DataFrame, options: Options | None = None, vocabulary: str | None = None) -> DataFrame:
    """Per document: tokens both ways, structure counts, and ``content_kept``, the
    share of different words, of those that plain extraction and conversion with
    headers both have, that the output has too (1 where there are none)."""
    options = options or Options()
    files = files.select(F.col("doc_id").cast("string").alias("doc_id"), "content")
    _, blocks = convert.parse_files(files, options)
    blocks = stored(blocks, "evaluated")
    _, whole = convert.parse_files(files, options.with_(keep_headers=True))
    count = lambda kind: F.count_if(F.col("type") == kind).alias(f"{kind}s")
    notes = F.sum(F.greatest(F.coalesce(F.size("notes"), F.lit(0)), F.lit(0))).alias("footnotes")
    counts = blocks.groupBy("doc_id").agg(count("heading"), count("table"), count("list"), notes, F.count("*").alias("blocks"))
    texts = plain_extraction(files).join(convert.markdown(blocks, options), "doc_id").join(convert.markdown(whole, options).withColumnRenamed("markdown", "whole"), "doc_id")
    base = F.array_intersect(T.content_words(F.col("text")), T.content_words(F.col("whole")))
    kept = F.size(F.array_intersect(base, T.content_words(F.col("markdown")))) / F.size(base)
    tokens = token_counter(vocabulary)
    texts = texts.withColumn("baseline_tokens", tokens(F.col("text"))).withColumn("tokens", tokens(F.col("markdown")))
    before, after = F.col("baseline_tokens"), F.col("tokens")
    return texts.join(counts, "doc_id").select(
        "doc_id", before, after, reduction(before, after).alias("reduction"), "headings", "tables", "lists", "footnotes", "blocks", F.when(F.size(base) == 0, 1.0).otherwise(kept).alias("content_kept")
    )


def report(results: DataFrame) -> DataFrame:
    """One row: totals, medians and the worst content kept."""
    totals = [F.sum(c).alias(c) for c in ("baseline_tokens", "tokens", "headings", "tables", "lists", "footnotes", "blocks")]
    made = results.agg(*totals, F.median("reduction").alias("median_reduction"), F.median("content_kept").alias("median_kept"), F.min("content_kept").alias("worst_kept"))
    return made.withColumn("corpus_reduction", reduction(F.col("baseline_tokens"), F.col("tokens")))
