"""Streaming forms of the two append-only flows (STR-1, STR-2).

Rows are handled inside the row. The checkpoint makes each file be read once; the order stream besides keeps the requests it
has answered, so that a request that is delivered again gets no second result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from freightdocs.operators import audit, orders
from freightdocs.sources.logs import decode_lines, stamped
from freightdocs.sources.requests import checked_requests, envelope

ORDER_OUTPUT = "roomId string, payload string, missing_fields array<string>, error_code string"
#: How often a running log stream looks for new lines.
REFRESH = "10 seconds"


def order_results(lines: DataFrame) -> DataFrame:
    """Request lines (batch or stream) to one result row each: a payload, or what is wrong."""
    requests = orders.extract(checked_requests(lines))
    missing = orders.missing_fields(F.col("extracted"))
    rows = requests.withColumn("missing_fields", F.when(F.col("error_code").isNull(), missing))
    error = F.coalesce("error_code", F.when(F.size("missing_fields") > 0, "order_not_ready"))
    payload = envelope(orders.order_data(F.col("extracted")), F.col("roomId"))
    return rows.withColumn("error_code", error).select(
        "roomId", F.when(F.col("error_code").isNull(), payload).alias("payload"), "missing_fields", "error_code")


def request_key(line: Column) -> Column:
    """What makes two deliveries the same request: its text and its room, or the whole line where these can't be read."""
    content, room = F.get_json_object(line, "$.content"), F.get_json_object(line, "$.roomId")
    return F.when(content.isNotNull() & room.isNotNull(), F.sha2(F.to_json(F.struct(content, room)), 256)).otherwise(F.sha2(line, 256))


def stream_orders(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, once: bool = True, remember: str = "7 days") -> StreamingQuery:
    """STR-1: request files in, result files out; one attempt for each request, none is sent twice.

    A file is read once, also over restarts from the same checkpoint. The key of an answered request stays in the state
    store for ``remember`` after its file's time; a second delivery in another file, in the same batch or in a later
    one, is dropped. Blank lines are no requests.
    """
    lines = spark.readStream.schema("value string").text(in_dir).select("value", F.col("_metadata.file_modification_time").alias("at"))
    lines = lines.filter(F.trim("value") != "").withColumn("key", request_key(F.col("value")))
    fresh = lines.withWatermark("at", remember).dropDuplicatesWithinWatermark(["key"])
    writer = order_results(fresh.select("value")).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out_dir)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their number in their part of a file; a task reads the lines of a part in order."""
    last, line = None, 0
    for b in batches:
        numbers = []
        for place in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), strict=True):
            line = line + 1 if place == last else 0
            last = place
            numbers.append(line)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64())], [*b.schema.names, "line"])


def stream_log(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, once: bool = True, by_name: bool = False,
               files_at_once: int | None = None, refresh: str = REFRESH) -> StreamingQuery:
    """STR-2: log lines in, search table by date out.

    A line's place in the log is the time and name of its file, the start of the part of it that a task reads, and its
    number there; files are read line by line. ``by_name``: the files are in the order of their names, whatever their times,
    as the parts of one write are. Without ``once`` the stream runs on and takes in new files every ``refresh``;
    ``files_at_once`` bounds a batch. A restart from the same checkpoint goes on behind the last whole batch, and readers of
    the table see whole batches only.
    """
    reader = spark.readStream.schema("value string")
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", str(files_at_once))
    lines = reader.text(in_dir).select(
        F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), "value")
    lines = lines.mapInArrow(_numbered, "at timestamp, file string, block bigint, value string, line bigint")
    place = ("file", "block", "line") if by_name else ("at", "file", "block", "line")
    entries = decode_lines(lines.select("value", F.struct(*place).alias("seq")))
    rows = audit.logged(stamped(entries)).withColumn("error", audit.error_default(F.col("status"), F.col("error")))
    writer = (rows.withColumn("log_date", F.to_date("ts")).writeStream.format("parquet")
              .partitionBy("log_date").option("checkpointLocation", checkpoint).option("path", out_dir))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=refresh)).start()


def search_table(spark: SparkSession, out_dir: str) -> DataFrame:
    """The table of ``stream_log`` as it is now: the files of the batches that are done."""
    return spark.read.parquet(out_dir)
