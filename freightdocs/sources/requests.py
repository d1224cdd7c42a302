"""Order-text requests and order payloads (SRC-5, SNK-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freightdocs import dictionaries as D
from freightdocs.functions import text as t


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of requests; every line becomes a row with its error, if any."""
    return checked_requests(spark.read.text(path))


def checked_columns() -> list[Column]:
    """SRC-5: ``content`` and ``roomId`` must be there, non-empty, and nothing else."""
    keys = F.json_object_keys("value")
    content, room = F.get_json_object("value", "$.content"), F.get_json_object("value", "$.roomId")
    stripped = t.strip(content)
    parsed = F.try_parse_json("value")
    text = [F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant")) == "STRING", F.lit(False)) for k in ("content", "roomId")]
    bad = (keys.isNull() | ~(text[0] & text[1]) | (F.coalesce(content, F.lit("")) == "") | (F.coalesce(room, F.lit("")) == "")
           | (F.size(F.array_except(keys, F.array(F.lit("content"), F.lit("roomId")))) > 0))
    return [stripped.alias("content"), room.alias("roomId"),
            F.when(F.coalesce(bad, F.lit(True)), "invalid_request")
            .when(F.octet_length(stripped) > D.MAX_UPLOAD_BYTES, "text_too_large").alias("error_code")]


def checked_requests(lines: DataFrame) -> DataFrame:
    """Request lines ``value`` to requests; every other column stays."""
    return lines.select(*[c for c in lines.columns if c != "value"], *checked_columns())


def envelope(data: Column, room_id: Column, app_id: str = "", user_id: str = "", open_id: str = "",
             order_user_id: str = "") -> Column:
    """SNK-3: the wrapper object around one order payload, as JSON text."""
    return F.to_json(F.struct(
        F.struct(F.lit(app_id).alias("ext_app_id"), F.lit(user_id).alias("ext_user_id"),
                 F.lit(open_id).alias("jxt_open_id")).alias("apiKeyInfo"),
        data.alias("data"), F.lit(order_user_id).alias("userId"), room_id.alias("roomId")))


def write_payloads(df: DataFrame, path: str) -> None:
    """One JSON line per ready order (``df`` has the text column ``payload``)."""
    df.select("payload").write.mode("append").text(path)
