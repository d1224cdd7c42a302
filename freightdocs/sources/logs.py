"""Request-log source and sinks (SRC-3, SNK-1, SNK-2, SNK-4, SNK-5)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freightdocs.schemas import LOG_FIELDS
from freightdocs.session import cut_lineage


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines in append order; blank and undecodable lines are skipped.

    ``seq`` orders by file time, then place in the file, then line; it is a plain
    struct, so no global sort is needed to read.
    """
    lines = spark.read.text(path).withColumn("seq", F.struct(
        F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")))
    return decode_lines(lines)


def decode_lines(lines: DataFrame) -> DataFrame:
    parsed = lines.withColumn("entry", F.from_json("value", LOG_FIELDS, {"mode": "PERMISSIVE"}))
    whole = F.try_parse_json("value").isNotNull() & F.rlike("value", F.lit(r"^\s*\{"))
    return parsed.filter(whole).select("seq", "entry.*")


def stamped(df: DataFrame) -> DataFrame:
    """SNK-1: an entry without a time gets the current one, in milliseconds."""
    return df.withColumn("ts", F.coalesce("ts", F.date_trunc("millisecond", F.current_timestamp())))


def append_log(df: DataFrame, path: str) -> None:
    stamped(df).withColumn("log_date", F.to_date("ts")).write.mode("append").partitionBy("log_date").json(path)


def keep_since(now: Column, keep_hours: int) -> Column:
    return now - F.make_interval(hours=F.lit(max(keep_hours, 1)))


def retained(df: DataFrame, now: Column, keep_hours: int) -> DataFrame:
    """SNK-2: entries not older than the kept hours; the date column prunes whole partitions."""
    limit = keep_since(now, keep_hours)
    out = df.filter(F.col("ts") >= limit)
    return out.filter(F.col("log_date") >= F.to_date(limit)) if "log_date" in df.columns else out


def rewrite_retained(spark: SparkSession, path: str, now: Column, keep_hours: int) -> dict[str, int]:
    """SNK-2 on a written log, in place: whole dates before the limit go, the date that the limit cuts is written anew.

    Files of later dates are not touched, or even read. The border date is replaced by a dynamic
    partition overwrite, whose job commits before the old files go, and its kept rows are written aside first, since a job must not
    read what it replaces. Dates come from the folders, one for each day of the log. Returns how many dates were dropped
    and rewritten.
    """
    limit = keep_since(now, keep_hours)
    border = spark.range(1).select(F.to_date(limit).alias("day"), F.unix_micros(limit).alias("at")).first()
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    dropped = rewritten = 0
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if not name.startswith("log_date=") or name.endswith("__HIVE_DEFAULT_PARTITION__"):
            continue
        day = date.fromisoformat(name.removeprefix("log_date="))
        if day < border.day:
            files.delete(status.getPath(), True)
            dropped += 1
        elif day == border.day:
            own = spark.read.schema(LOG_FIELDS).json(status.getPath().toString())
            kept = cut_lineage(own.filter(F.col("ts") >= F.timestamp_micros(F.lit(border["at"]))).withColumn("log_date", F.lit(day)), "log-border")
            if kept.isEmpty():
                files.delete(status.getPath(), True)
            else:
                kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_date").json(path)
            rewritten += 1
    return {"dropped": dropped, "rewritten": rewritten}


def export_all(df: DataFrame) -> DataFrame:
    """SNK-4: rows of the current search with the export time and their total.

    The total is a scalar subquery, the items stay distributed rows.
    """
    return df.withColumns({"total": df.agg(F.count("*")).scalar(), "exported_at": F.current_timestamp()})


def write_export(df: DataFrame, path: str) -> None:
    """SNK-4: the export as JSON lines."""
    export_all(df).write.mode("overwrite").json(path)


def export_one(df: DataFrame, request_id: str) -> DataFrame:
    """SNK-5: one entry as JSON text with its error lifted to the top."""
    return df.filter(F.col("request_id") == request_id).select(F.to_json(F.struct(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("exported_at"),
        F.struct(*[F.col(c) for c in df.columns]).alias("request"), F.col("error").alias("error")),
        {"ignoreNullFields": "false"}).alias("entry"))
