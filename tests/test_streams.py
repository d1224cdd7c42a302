"""Retention in place, and streams that are stopped and started again."""

import os
import time

from pyspark.sql import functions as F

from freightdocs.session import working_dir
from freightdocs.sources import logs
from freightdocs.streaming import flows


def test_retention_leaves_later_dates_alone(spark):
    path = working_dir(spark, "kept-log").removeprefix("file:")
    rows = [(f"r{d}-{h}", f"2026-03-{d:02d}T{h:02d}:00:00Z") for d in range(1, 6) for h in (1, 13, 23)]
    frame = spark.createDataFrame(rows, "request_id string, t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    logs.append_log(frame, path)
    days = {d: {f: os.stat(f"{path}/{d}/{f}").st_mtime_ns for f in os.listdir(f"{path}/{d}")} for d in os.listdir(path) if d.startswith("log_date")}
    time.sleep(0.05)
    assert logs.rewrite_retained(spark, path, F.lit("2026-03-05T12:00:00Z").cast("timestamp"), 48) == {"dropped": 2, "rewritten": 1}
    left = sorted(d for d in os.listdir(path) if d.startswith("log_date"))
    assert left == ["log_date=2026-03-03", "log_date=2026-03-04", "log_date=2026-03-05"]
    for d in left[1:]:
        assert {f: os.stat(f"{path}/{d}/{f}").st_mtime_ns for f in os.listdir(f"{path}/{d}")} == days[d]
    ids = {r.request_id for r in logs.read_log(spark, path).collect()}
    assert ids == {"r3-13", "r3-23", *(f"r{d}-{h}" for d in (4, 5) for h in (1, 13, 23))}
    # nothing of the border date is left: its folder goes too
    logs.rewrite_retained(spark, path, F.lit("2026-03-03T23:30:00Z").cast("timestamp") + F.expr("interval 1 hour"), 1)
    assert sorted(d for d in os.listdir(path) if d.startswith("log_date")) == left[1:]


def test_a_request_is_answered_once(spark, tmp_path):
    folder, base = tmp_path / "in", working_dir(spark, "once")
    folder.mkdir()
    one, two, bad = '{"content": "a：b", "roomId": "r"}', '{"roomId":"r","content":"a：b"}', "no json"

    def run():
        flows.stream_orders(spark, str(folder), f"{base}/out", f"{base}/state").awaitTermination()
        return sorted((r.roomId or "", r.error_code) for r in spark.read.schema(flows.ORDER_OUTPUT).parquet(f"{base}/out").collect())

    (folder / "1").write_text(f"{one}\n\n{one}\n{bad}\n")
    first = run()
    assert first == [("", "invalid_request"), ("r", "order_not_ready")]
    (folder / "2").write_text(f"{two}\n{bad}\n" + '{"content": "a：b", "roomId": "s"}\n')  # the same request in other spelling, and one for another room
    assert run() == sorted([*first, ("s", "order_not_ready")]) == run()
