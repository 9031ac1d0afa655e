"""``python -m foliant.evaluation``: conversion against plain extraction of text, document by document."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .api import session
from .options import TABLE_MODES, Options
from .plans import evaluate
from .plans.storage import stored
from .sources import samples

#: The least share of content words that every document has to keep.
LEAST_KEPT = 0.9
COUNTS = ("headings", "tables", "lists", "footnotes")
HEAD = ("Document", "Plain tokens", "Tokens", "Reduction", "Headings", "Tables", "Lists", "Footnotes")


def files_of(spark: SparkSession, folder: str | None) -> DataFrame:
    """``doc_id, content`` of all PDF and DOCX files of a folder, or of the sample corpus."""
    if folder is None:
        return spark.createDataFrame([(name, bytearray(data)) for name, data in samples.corpus().items()], "doc_id string, content binary")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.where(F.lower("path").rlike(r"\.(pdf|docx)$")).select(F.col("path").alias("doc_id"), "content")


def line(cells: Iterable) -> str:
    return f"| {' | '.join(map(str, cells))} |"


def table(results: DataFrame, total: Row) -> Iterable[str]:
    """Lines of a Markdown table; rows come to the driver one partition at a time."""
    yield line(HEAD)
    yield line(["---"] + ["---:"] * (len(HEAD) - 1))
    for r in results.orderBy("doc_id").toLocalIterator():
        yield line([f"`{os.path.basename(r['doc_id'])}`", f"{r['baseline_tokens']:,}", f"{r['tokens']:,}", f"{r['reduction']:.1f}%", *(r[c] for c in COUNTS)])
    yield line(["**Total / median**", f"{total['baseline_tokens']:,}", f"{total['tokens']:,}", f"{total['median_reduction']:.1f}%", *(total[c] for c in COUNTS)])


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    asked = argparse.ArgumentParser(prog="foliant.evaluation", description=__doc__)
    asked.add_argument("--docs", help="folder of files; a sample corpus if left out")
    asked.add_argument("--out", help="file for the table, besides standard output")
    asked.add_argument("--json", help="file for one JSON object a line, one for each document")
    asked.add_argument("--encoding", metavar="FILE", help="tokenizers JSON file to count tokens by; else four characters count as one")
    asked.add_argument("--table-mode", choices=TABLE_MODES, default="markdown")
    asked.add_argument("--check-content", action="store_true", help=f"fail where a document keeps less than {LEAST_KEPT:.0%} of its content words")
    args = asked.parse_args(argv)
    if args.docs and not os.path.isdir(args.docs):
        print(f"evaluation: no such folder: {args.docs}", file=sys.stderr)
        return 2
    began = time.monotonic()
    results = stored(evaluate.measured(files_of(session(spark), args.docs), Options(table_mode=args.table_mode), args.encoding), "evaluation")
    total = evaluate.report(results).first()
    if total["tokens"] is None:
        print("evaluation: no PDF or DOCX file could be read", file=sys.stderr)
        return 2
    lines = list(table(results, total))
    print("\n".join(lines))
    print(f"evaluation: {len(lines) - 3} documents in {time.monotonic() - began:.1f} s; {total['median_kept']:.0%} of content words kept in the middle, {total['worst_kept']:.0%} at worst", file=sys.stderr)
    if args.out:
        with open(args.out, "w", encoding="utf-8") as file:
            file.write("\n".join(lines) + "\n")
    if args.json:
        with open(args.json, "w", encoding="utf-8") as file:
            file.writelines(json.dumps(r.asDict(), ensure_ascii=False) + "\n" for r in results.toLocalIterator())
    if args.check_content and total["worst_kept"] < LEAST_KEPT:
        worst = results.orderBy("content_kept", "doc_id").first()
        print(f"evaluation: {worst['doc_id']} keeps only {worst['content_kept']:.0%}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
