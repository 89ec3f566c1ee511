"""Streams: frozen cleaning of new rows, and folders of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabsmith.plans.params import apply_params
from tabsmith.sources.readers import read_many


def apply_params_stream(stream: DataFrame, params: dict, output: str, checkpoint: str) -> None:
    """Serve a stream with frozen parameters, as far as it has come.

    The rules are row-wise, so the stream keeps no state and the result equals
    that of a batch.
    """
    served = apply_params(stream, params)
    query = (
        served.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )
    query.awaitTermination()


def ingest_stream(
    spark: SparkSession, folder: str, schema: str, params: dict, output: str, reports: str, checkpoint: str, **options
) -> None:
    """Clean files as they arrive and append a report row per file.

    The stream carries the paths of new files; their rows are read by each
    file's own header. Each batch takes one pass for the rows and one grouped
    pass for the reports. Rows that cannot be parsed are counted and left out; a
    file of such rows or of another header is reported as failed.
    """
    pace = {k: options.pop(k) for k in ("maxFilesPerTrigger", "latestFirst") if k in options}
    listing = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(listing).options(**pace).load(folder).select("path")

    def clean(batch: DataFrame, number: int) -> None:
        files = [r["path"] for r in batch.collect()]  # new files of one batch
        if not files:
            return
        rows, report = read_many(spark, files, schema, keep_bad=False, **options)
        # A batch that is run again overwrites its own folder.
        apply_params(rows, params).write.mode("overwrite").parquet(f"{output}/batch={number}")
        report.write.mode("overwrite").json(f"{reports}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(clean).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
