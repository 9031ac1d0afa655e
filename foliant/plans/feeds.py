"""Inputs for the registered queries, derived from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What lines are prefixed with, by (doc_id + line number) mod 12, so that rules for markers have work to do.
PREFIXES = ("", "• ", "3.2 ", "Table 4. ", "1) ", "- ", "# ", "Fig. 2: ", "(iv) ", "A. ", "ﬁ­`", "12 ")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, line_no, text``: the lines of all documents, with prefixes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), (F.pmod(F.col("doc_id") + F.col("line_no"), F.lit(12)) + 1).cast("int"))
    return docs.select("doc_id", "line_no", F.concat(prefix, "raw").alias("text"))


LINES_SQL = f"""lines AS (SELECT doc_id, line_no, ([{", ".join("'" + p + "'" for p in PREFIXES)}])[CAST((doc_id + line_no) % 12 AS INT) + 1] || raw AS text
    FROM (SELECT doc_id, CAST(unnest(range(len(a))) AS INT) AS line_no, unnest(a) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)))"""


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines laid out on pages of eight, with a running header, page
    numbers, and sizes and weights by arithmetic on ids."""
    slot, page = F.pmod("line_no", F.lit(8)), (F.floor(F.col("line_no") / 8) + 1).cast("int")
    top = F.when(slot == 0, 40).when(slot == 7, 705).otherwise(100 + 80 * slot).cast("double")
    n = F.col("doc_id") + F.col("line_no")
    text = F.when(slot == 0, F.concat(F.lit("Report "), page.cast("string"), F.lit(" of 9"))).when(slot == 7, page.cast("string")).otherwise(F.col("text"))
    return lines(spark, sf_dir).select(
        "doc_id", page.alias("page"), F.col("line_no").alias("seq"), text.alias("text"), F.lit(72.0).alias("x0"), top.alias("top"), (top + 10).alias("bottom"),
        (F.lit(10.0) + F.pmod(n * 7, F.lit(3)) * F.when(F.pmod(n, F.lit(5)) == 0, 2).otherwise(0)).alias("size"), (F.pmod(n, F.lit(7)) == 0).alias("bold"), F.lit(792.0).alias("height"),
    )


LAYOUT_SQL = LINES_SQL + """,
layout AS (SELECT doc_id, CAST(line_no // 8 + 1 AS INT) AS page, line_no AS seq,
    CASE line_no % 8 WHEN 0 THEN 'Report ' || (line_no // 8 + 1) || ' of 9' WHEN 7 THEN CAST(line_no // 8 + 1 AS VARCHAR) ELSE text END AS text,
    CAST(CASE line_no % 8 WHEN 0 THEN 40 WHEN 7 THEN 705 ELSE 100 + 80 * (line_no % 8) END AS DOUBLE) AS top,
    CAST(10 + (((doc_id + line_no) * 7) % 3) * CASE WHEN (doc_id + line_no) % 5 = 0 THEN 2 ELSE 0 END AS DOUBLE) AS size, (doc_id + line_no) % 7 = 0 AS bold FROM lines)"""
