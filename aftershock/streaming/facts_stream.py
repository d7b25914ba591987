"""Incremental ingestion of landed company-facts documents.

The reference fetches one company-facts document per filer in a loop; here
the documents land as files and a Structured Streaming file source picks up
new files.  A micro-batch only parses: parsed documents and failures are written
to the partition of its epoch, which a retried batch overwrites, so each file
counts once.  The rules that look at all documents of a filer (tag fallback,
preferred form, first row of a year) run when the series is read, over all
epochs: two filings of one filer in two batches give what one batch gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.operators.facts import annual_series
from aftershock.session import checkpoint_dir
from aftershock.sources.json_facts import parse_company_facts


def _batch_writer(output_dir: str):
    def write(batch: DataFrame, epoch: int) -> None:
        docs = batch.select(F.col("doc"), F.col("json"))
        for kind, rows in zip(("parsed", "failures"), parse_company_facts(docs)):
            rows.write.mode("overwrite").parquet(f"{output_dir}/{kind}/batch={epoch}")
    return write


def landed_series(spark: SparkSession, output_dir: str) -> DataFrame:
    """The annual series over all documents that have been ingested so far."""
    return annual_series(spark.read.parquet(f"{output_dir}/parsed").drop("batch"))


def landed_failures(spark: SparkSession, output_dir: str) -> DataFrame:
    """Documents that could not be parsed, with the batch that met them."""
    return spark.read.parquet(f"{output_dir}/failures")


def ingest_company_facts(spark: SparkSession, landing_dir: str, output_dir: str,
                         files_per_batch: int = 1000, available_now: bool = True, name: str = "company-facts"):
    """Start the ingestion query; with ``available_now`` it processes every
    file present and stops (call ``awaitTermination``)."""
    stream = (spark.readStream.format("text").option("wholetext", True)
              .option("maxFilesPerTrigger", files_per_batch).load(landing_dir))
    docs = stream.select(F.input_file_name().alias("doc"), F.col("value").alias("json"))
    w = (docs.writeStream.foreachBatch(_batch_writer(output_dir))
         .option("checkpointLocation", f"{checkpoint_dir(spark)}/stream-{name}"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
