"""A folder that files arrive in, converted as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..options import Options
from ..plans import convert

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream(spark: SparkSession, source: str, target: str, checkpoint: str, options: Options | None = None, files_per_batch: int = 1000) -> StreamingQuery:
    """Each new file under ``source`` goes once to ``target``/documents and
    ``target``/blocks. Decisions look at one document, so batches are independent;
    a batch that is run again replaces its own part."""
    options = options or Options()
    arriving = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(source)
    files = arriving.where(F.lower("path").rlike(r"\.(pdf|docx)$")).select(F.col("path").alias("doc_id"), "content")

    def convert_batch(batch: DataFrame, number: int) -> None:
        documents, blocks = convert.parse_files(batch, options)
        blocks.write.mode("overwrite").parquet(f"{target}/blocks/batch={number}")
        documents.write.mode("overwrite").parquet(f"{target}/documents/batch={number}")

    return files.writeStream.foreachBatch(convert_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
