"""The streamed log reads a file in several parts, line by line, and keeps the order of its lines."""

import json

from freightdocs.session import working_dir
from freightdocs.streaming import flows


def test_one_file_in_parts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    entry = {"path": "/api/x", "method": "POST", "status": 200, "ts": "2026-01-02T03:04:05.000Z"}
    for name in ("a.log", "b.log"):
        (folder / name).write_text("".join(json.dumps(entry | {"request_id": f"{name}-{k}"}) + "\n" for k in range(3000)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        base = working_dir(spark, "log-test")
        flows.stream_log(spark, str(folder), f"{base}/out", f"{base}/state", by_name=True).awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    rows = spark.read.parquet(f"{base}/out").select("seq", "request_id").orderBy("seq").collect()
    assert [r.request_id for r in rows] == [f"{n}-{k}" for n in ("a.log", "b.log") for k in range(3000)]
    assert len({(r.seq.file, r.seq.block) for r in rows}) > 4
