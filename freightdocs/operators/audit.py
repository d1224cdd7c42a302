"""Request-log analytics over the append-only log table.

``seq`` is the append order given at ingest; time stamps never decide the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightdocs import dictionaries as D
from freightdocs.functions import text as t


# ---- LOG-1
def search(df: DataFrame, path: str | None = None, file: str | None = None, status: int | None = None,
           request_id: str | None = None, ip: str | None = None) -> DataFrame:
    """All given filters at once: case-blind substrings, exact status, exact request id."""
    for name, needle in (("path", path), ("file", file), ("ip", ip)):
        if needle and needle.strip():
            df = df.filter(F.contains(F.lower(name), F.lit(needle.strip().lower())))
    if status is not None:
        df = df.filter(F.col("status") == status)
    if request_id:
        df = df.filter(F.col("request_id") == request_id)
    return df


# ---- LOG-2
def page(df: DataFrame, limit: int = 200, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(items newest first, total before paging); a page is a top-k, the total one row."""
    return df.orderBy(F.col("seq").desc()).offset(offset).limit(limit), df.agg(F.count("*").alias("total"))


def page_before(df: DataFrame, last_seen: Column, limit: int = 200) -> DataFrame:
    """The next page of deep paging: entries older than the last one seen; no task holds the pages before."""
    return df.filter(F.col("seq") < last_seen).orderBy(F.col("seq").desc()).limit(limit)


# ---- LOG-3
def latest(df: DataFrame, n: int = D.LOG_WINDOW) -> DataFrame:
    return df.orderBy(F.col("seq").desc()).limit(n)


# ---- LOG-4
def client_ip(forwarded: Column, real_ip: Column, peer: Column, trust_proxy: bool = True) -> Column:
    if not trust_proxy:
        return peer
    return F.when(F.coalesce(forwarded, F.lit("")) != "", t.strip(F.get(F.split(forwarded, ","), F.lit(0)))).when(
        F.coalesce(real_ip, F.lit("")) != "", t.strip(real_ip)).otherwise(peer)


# ---- LOG-5
def captured_body(content_type: Column, content_length: Column, body: Column,
                  max_bytes: int = D.MAX_UPLOAD_BYTES, max_chars: int = D.LOG_BODY_CHARS) -> Column:
    """``struct(body, body_truncated)``: only JSON of a declared, allowed length; cut to the cap."""
    readable = F.startswith(F.lower(content_type), F.lit("application/json")) & (content_length > 0) & (
        content_length <= max_bytes)
    kept = F.when(F.coalesce(readable, F.lit(False)), body)
    long = (F.length(kept) > max_chars) if max_chars > 0 else F.lit(False)
    return F.struct(
        F.when(long, F.substring(kept, 1, max_chars)).otherwise(kept).alias("body"),
        F.coalesce(long, F.lit(False)).alias("body_truncated"))


# ---- LOG-6
def error_default(status: Column, error: Column) -> Column:
    number = status.cast("string")
    return F.when(error.isNull() & (status >= 400), F.struct(
        F.concat(F.lit("http_"), number).alias("code"), F.concat(F.lit("HTTP "), number).alias("message"),
        F.lit(None).cast("string").alias("details"))).otherwise(error)


# ---- LOG-7
def logged(df: DataFrame) -> DataFrame:
    """Requests that are logged at all, each with an id (made from its place and time if absent)."""
    made = F.left(F.md5(F.concat_ws("|", F.col("seq").cast("string"), F.col("ts").cast("string"))), F.lit(12))
    return df.filter(~F.col("path").isin(*D.UNLOGGED_PATHS)).withColumn(
        "request_id", F.coalesce(F.nullif("request_id", F.lit("")), made))


# ---- LOG-8
def status_counts(df: DataFrame) -> DataFrame:
    status = F.col("status")
    return df.agg(F.count("*").alias("total"), F.count_if(status < 400).alias("ok"),
                  F.count_if((status >= 400) & (status < 500)).alias("client_error"),
                  F.count_if(~(status < 500)).alias("server_error"))


def badge(status: Column) -> Column:
    return F.when(status < 300, "ok").when(status < 500, "warn").otherwise("err")
