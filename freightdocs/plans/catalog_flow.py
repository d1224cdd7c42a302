"""Queries of sources and sinks (SRC, SNK), free-text orders (ORD), request log (LOG), streams (STR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from freightdocs import dictionaries as D
from freightdocs.operators import audit, orders, triage
from freightdocs.plans import extract
from freightdocs.plans.catalog import keyed, register, values_sql, with_facts
from freightdocs.session import cut_lineage, read_table, working_dir
from freightdocs.sources import corpus, documents, logs, requests
from freightdocs.streaming import flows

# ------------------------------------------------------------------ sources
FILES_SQL = """
files AS (SELECT doc_id, text, 'doc' || CAST(doc_id AS VARCHAR) ||
  CASE doc_id % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.txt' WHEN 3 THEN '.Doc' WHEN 4 THEN '.jpeg' ELSE '' END AS file,
  CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.txt' WHEN 3 THEN '.doc' WHEN 4 THEN '.jpeg' ELSE '' END AS suffix
  FROM documents)"""


def files(spark, sf):
    """Documents as files: name and content made from the document table."""
    return read_table(spark, sf, "documents").select(
        "doc_id", "text", F.expr("'doc' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.txt' "
                                 "WHEN 3 THEN '.Doc' WHEN 4 THEN '.jpeg' ELSE '' END").alias("file"))


@register("src_1_suffix_split", f"""
WITH {FILES_SQL} SELECT doc_id, suffix, CASE WHEN suffix IN ('.txt', '') THEN 'bad_request' END AS error_code FROM files""")
def _(spark, sf):
    good, bad = triage.split_by_suffix(files(spark, sf))
    return good.select("doc_id", "suffix", F.lit(None).cast("string").alias("error_code")).unionByName(
        bad.select("doc_id", "suffix", "error_code"))


@register("src_1_binary_scan")
def _(spark, sf):
    # the given tables themselves, read as files: none has an accepted suffix, and no content is asked for
    good, bad = documents.binary_documents(spark, sf, "*.parquet")
    return good.select("file", "n_bytes", F.lit(None).cast("string").alias("error_code")).unionByName(
        bad.select("file", "n_bytes", "error_code"))


@register("src_1_accepted_files", f"""
WITH {FILES_SQL} SELECT file, octet_length(encode(coalesce(text, ''))) AS n_bytes, sha256(coalesce(text, '')) AS content_sha256
FROM files WHERE suffix NOT IN ('.txt', '')""")
def _(spark, sf):
    # documents written as files with accepted and other suffixes, and scanned
    base = working_dir(spark, "files")
    documents.write_documents(files(spark, sf).select("file", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")), base)
    return documents.accepted_documents(spark, base).select("file", "n_bytes", F.sha2("content", 256).alias("content_sha256"))


@register("src_2_text_corpus", f"""
WITH {FILES_SQL} SELECT doc_id, length(file || chr(10) || text) AS chars, sha256(file || chr(10) || text) AS route_sha FROM files""")
def _(spark, sf):
    df = documents.text_corpus(files(spark, sf))
    return df.select("doc_id", F.length("route_text").alias("chars"), F.sha2(F.col("route_text"), 256).alias("route_sha"))


LOG_SQL = """
log AS (SELECT event_id AS seq, CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'req-' || CAST(event_id AS VARCHAR) END AS request_id,
  '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.1' AS ip,
  CASE WHEN event_id % 3 = 0 THEN '192.168.0.' || CAST(user_id % 100 AS VARCHAR) END AS first_hop,
  CASE WHEN event_id % 50 = 0 THEN '/api/logs' ELSE '/Skills/' || event_type END AS path,
  CASE WHEN event_id % 2 = 0 THEN 'File_' || event_type || '.PDF' END AS file, props AS body,
  (ARRAY[200, 201, 302, 404, 422, 500])[event_id % 6 + 1] AS status, ts, value FROM events)"""


@register("src_3_log_scan", f"""
WITH {LOG_SQL} SELECT request_id, path, CAST(status AS BIGINT) AS status, body FROM log WHERE status > 201""")
def _(spark, sf):
    entries = corpus.request_log(spark, sf)
    line = F.to_json(F.struct(*[c for c in entries.columns if c != "seq"]))
    # blank, cut and non-object lines take the place of some entries
    lines = entries.select("seq", F.when(F.col("status") == 200, F.lit("  ")).when(
        F.col("status") == 201, F.substring(line, 1, 20)).otherwise(line).alias("value"))
    return logs.decode_lines(lines).select("request_id", "path", "status", "body")


@register("src_4_dictionaries", f"""
SELECT c_nationkey, count(*) AS customers, any_value(p.carrier) AS carrier FROM customer
JOIN {values_sql([(i, p, c) for i, (p, c) in enumerate(D.CARRIER_PREFIXES.items())], 'i, prefix, carrier')} p
  ON CAST(p.i AS INTEGER) = c_nationkey GROUP BY c_nationkey""")
def _(spark, sf):
    # dictionary entries looked up from a table through a broadcast join
    prefix = F.substring(F.lit(corpus.PREFIX_STRIP), F.col("c_nationkey") * 4 + 1, F.lit(4))
    named = read_table(spark, sf, "customer").withColumn("prefix", prefix)
    joined = named.join(F.broadcast(D.carrier_prefix_table(spark)), "prefix")
    return joined.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.first("carrier").alias("carrier"))


@register("src_5_order_requests", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 5 IN (1, 2, 3) OR k % 10 IN (4, 9) THEN NULL ELSE nation END AS content,
  CASE WHEN k % 5 IN (1, 2, 3) OR k % 10 IN (4, 9) THEN 'invalid_request' END AS error_code FROM f"""))
def _(spark, sf):
    df = keyed(spark, sf, nation="nation", room="room").withColumn("value", F.expr(
        "CASE WHEN doc_id % 5 = 1 THEN '{\"content\": \"\", \"roomId\": \"r\"}' WHEN doc_id % 5 = 2 THEN "
        "'{\"content\": \"x\", \"roomId\": \"r\", \"more\": 1}' WHEN doc_id % 5 = 3 THEN 'no json' "
        "WHEN doc_id % 10 = 4 THEN '{\"content\": 5, \"roomId\": \"r\"}' WHEN doc_id % 10 = 9 THEN '{\"content\": \"x\", \"roomId\": {\"r\": 1}}' "
        "ELSE '{\"content\": \" ' || nation || '\\\\n\", \"roomId\": \"' || room || '\"}' END"))
    return requests.checked_requests(df.select("doc_id", "value")).select(
        "doc_id", F.when(F.col("error_code").isNull(), F.col("content")).alias("content"), "error_code")


# ------------------------------------------------------------------ orders
@register("ord_1_label_fields", with_facts(f"""
SELECT k AS doc_id, bill AS order_num1, CASE WHEN title IS NOT NULL THEN title WHEN k % 17 = 0 THEN c_name END AS c_title,
  vessel || ' V.' || voyage AS vessel_voyage, {corpus.BOX_TEXT} AS box_text, region AS b_end_dock, CAST(NULL AS VARCHAR) AS c_note FROM f"""))
def _(spark, sf):
    df = corpus.order_texts(spark, sf)
    from freightdocs.operators.segments import label_values
    fields = df.select("doc_id", orders.field_values(label_values(F.col("content"))).alias("x"))
    return fields.select("doc_id", *[F.col(f"x.{n}") for n in ("order_num1", "c_title", "vessel_voyage", "box_text", "b_end_dock", "c_note")])


@register("ord_2_vessel_voyage", with_facts("""
SELECT k AS doc_id, CASE WHEN k % 4 = 1 THEN 'A' ELSE vessel END AS vessel,
  CASE WHEN k % 4 = 0 THEN voyage WHEN k % 4 = 1 THEN 'B/' || voyage WHEN k % 4 = 2 THEN voyage END AS voyage FROM f"""))
def _(spark, sf):
    from freightdocs.functions.values import split_order_vessel_voyage
    df = keyed(spark, sf, raw="CASE WHEN k % 4 = 0 THEN vessel || ' VOY. ' || voyage WHEN k % 4 = 1 THEN 'A / B/' || voyage "
               "WHEN k % 4 = 2 THEN vessel || '／' || voyage ELSE vessel END")
    return df.select("doc_id", split_order_vessel_voyage(F.col("raw")).alias("x")).select("doc_id", "x.*")


BOX_ROWS = """
  SELECT k, type1 AS b_type, q1 AS n, 0 AS p FROM f WHERE n_lines > 0
  UNION ALL SELECT k, CASE WHEN k % 5 = 0 THEN type1 ELSE type2 END, q2, 1 FROM f WHERE n_lines > 1"""


@register("ord_3_box_quantities", with_facts(f"""
SELECT k AS doc_id, b_type, CAST(sum(n) AS BIGINT) AS box_num, row_number() OVER (PARTITION BY k ORDER BY min(p)) - 1 AS pos
FROM ({BOX_ROWS}) u GROUP BY k, b_type"""))
def _(spark, sf):
    df = orders.extract(corpus.order_texts(spark, sf))
    return df.select("doc_id", F.posexplode("extracted.box").alias("pos", "b")).select("doc_id", "pos", "b.b_type", "b.box_num")


@register("ord_4_order_record", with_facts("""
SELECT k AS doc_id, bill AS order_num1, vessel AS b_ship_name, voyage AS b_ship_num, packages AS j, weight AS m, date_text AS b_date,
  CAST(1 AS BIGINT) AS cargo_rows FROM f"""))
def _(spark, sf):
    df = orders.extract(corpus.order_texts(spark, sf))
    row = F.get(F.col("extracted.data"), F.lit(0))
    return df.select("doc_id", "extracted.order_num1", "extracted.b_ship_name", "extracted.b_ship_num", row["j"].alias("j"), row["m"].alias("m"),
                     F.get(F.col("extracted.driver"), F.lit(0))["b_date"].alias("b_date"), F.size("extracted.data").alias("cargo_rows"))


TITLE = "CASE WHEN title IS NOT NULL THEN title WHEN k % 17 = 0 THEN c_name END"


@register("ord_5_readiness_gate", with_facts(f"""
SELECT k AS doc_id, bill IS NOT NULL AND ({TITLE}) IS NOT NULL AS ready,
  concat_ws('|', CASE WHEN bill IS NULL THEN 'order_num1' END, CASE WHEN ({TITLE}) IS NULL THEN 'c_title' END) AS missing_fields FROM f"""))
def _(spark, sf):
    # both sides of the gate are read, so the texts are parsed once into a table of what it looks at
    asked = F.struct("extracted.order_num1", "extracted.c_title").alias("extracted")
    extracted = orders.extract(corpus.order_texts(spark, sf)).select("doc_id", asked)
    ready, rejected = orders.gate(cut_lineage(extracted, "extracted-orders"))
    return ready.select("doc_id", F.lit(True).alias("ready"), F.lit("").alias("missing_fields")).unionByName(
        rejected.select("doc_id", F.lit(False).alias("ready"), F.array_join("missing_fields", "|").alias("missing_fields")))


BOX_JSON = ("CASE WHEN n_lines = 0 THEN '[]' WHEN n_lines = 1 THEN '[{\"b_type\":\"' || type1 || '\",\"box_num\":' || CAST(q1 AS VARCHAR) || '}]' "
            "WHEN k % 5 = 0 OR type1 = type2 THEN '[{\"b_type\":\"' || type1 || '\",\"box_num\":' || CAST(q1 + q2 AS VARCHAR) || '}]' "
            "ELSE '[{\"b_type\":\"' || type1 || '\",\"box_num\":' || CAST(q1 AS VARCHAR) || '},{\"b_type\":\"' || type2 || '\",\"box_num\":' || CAST(q2 AS VARCHAR) || '}]' END")
PAYLOAD_SQL = (f"'{{\"order_num1\":\"' || bill || '\",\"c_title\":\"' || {TITLE} || '\",\"b_ship_name\":\"' || vessel || '\",\"b_ship_num\":\"' || voyage || "
               f"'\",\"b_end_dock\":\"' || region || '\",\"data\":[{{\"b_order_num\":\"' || bill || '\",\"j\":\"' || packages || '\",\"m\":\"' || weight || '\"}}],\"box\":' || {BOX_JSON} || "
               f"',\"driver\":[{{\"b_date\":\"' || date_text || '\"}}],\"type\":1,\"c_id\":\"C1\"}}'")


@register("ord_6_payload", with_facts(f"""
SELECT k AS doc_id, {PAYLOAD_SQL} AS payload FROM f WHERE bill IS NOT NULL AND ({TITLE}) IS NOT NULL"""))
def _(spark, sf):
    ready, _ = extract.order_payloads(corpus.order_texts(spark, sf), customer_id="C1")
    return ready.select("doc_id", orders.payload_json(F.col("order_data")).alias("payload"))


@register("ord_7_batch_summary", with_facts(f"""
SELECT k % 1000 AS batch_id, count(*) AS total, count(*) FILTER (bill IS NOT NULL AND ({TITLE}) IS NOT NULL) AS success,
  count(*) FILTER (bill IS NULL OR ({TITLE}) IS NULL) AS failed FROM f GROUP BY 1"""))
def _(spark, sf):
    df = orders.extract(corpus.order_texts(spark, sf))
    error = F.when(F.size(orders.missing_fields(F.col("extracted"))) > 0, "order_not_ready")
    return orders.batch_summary(df.select((F.col("doc_id") % 1000).alias("batch_id"), error.alias("error_code")))


# ------------------------------------------------------------------ request log
@register("log_1_search", f"""
WITH {LOG_SQL} SELECT seq, path, file FROM log
WHERE lower(path) LIKE '%skills%' AND lower(file) LIKE '%file_c%' AND status = 422 AND ip LIKE '%10.0.%'""")
def _(spark, sf):
    return audit.search(corpus.request_log(spark, sf), path=" SKILLS", file="file_C ", status=422, ip="10.0.").select("seq", "path", "file")


@register("log_2_newest_page", f"""
WITH {LOG_SQL}, hit AS (SELECT * FROM log WHERE status >= 404) SELECT seq, (SELECT count(*) FROM hit) AS total FROM hit
ORDER BY seq DESC LIMIT 100 OFFSET 50""")
def _(spark, sf):
    items, total = audit.page(corpus.request_log(spark, sf).filter("status >= 404"), limit=100, offset=50)
    return items.select("seq").withColumn("total", total.scalar())


@register("log_2_next_page", f"""
WITH {LOG_SQL}, hit AS (SELECT * FROM log WHERE status >= 404) SELECT seq FROM hit
WHERE seq < (SELECT seq FROM hit ORDER BY seq DESC LIMIT 1 OFFSET 149) ORDER BY seq DESC LIMIT 100""")
def _(spark, sf):
    entries = corpus.request_log(spark, sf).filter("status >= 404")
    items, _ = audit.page(entries, limit=100, offset=50)
    return audit.page_before(entries, items.agg(F.min("seq")).scalar(), limit=100).select("seq")


@register("log_3_last_window", f"WITH {LOG_SQL} SELECT seq, path FROM log ORDER BY seq DESC LIMIT 5000")
def _(spark, sf):
    return audit.latest(corpus.request_log(spark, sf)).select("seq", "path")


@register("log_4_client_address", f"""
WITH {LOG_SQL} SELECT seq, coalesce(first_hop, CASE WHEN seq % 5 = 0 THEN '172.16.0.9' END, ip) AS trusted, ip AS untrusted FROM log""")
def _(spark, sf):
    df = corpus.request_log(spark, sf).withColumn("real_ip", F.when(F.col("seq") % 5 == 0, " 172.16.0.9 "))
    args = (F.col("x_forwarded_for"), F.col("real_ip"), F.col("ip"))
    return df.select("seq", audit.client_ip(*args).alias("trusted"), audit.client_ip(*args, trust_proxy=False).alias("untrusted"))


@register("log_5_body_capture", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE length(text[1:4096]) END AS kept_chars,
  doc_id % 3 <> 0 AND length(text) > 4096 AS body_truncated FROM documents""")
def _(spark, sf):
    df = read_table(spark, sf, "documents")
    kind = F.when(F.col("doc_id") % 3 == 0, "multipart/form-data").otherwise("Application/JSON; charset=utf-8")
    kept = audit.captured_body(kind, F.octet_length("text"), F.col("text"))
    return df.select("doc_id", F.length(kept["body"]).alias("kept_chars"), kept["body_truncated"].alias("body_truncated"))


@register("log_6_error_default", f"""
WITH {LOG_SQL} SELECT seq, CASE WHEN status >= 400 THEN 'http_' || CAST(status AS VARCHAR) END AS code,
  CASE WHEN status >= 400 THEN 'HTTP ' || CAST(status AS VARCHAR) END AS message FROM log""")
def _(spark, sf):
    df = corpus.request_log(spark, sf).withColumn("error", audit.error_default(F.col("status"), F.col("error")))
    return df.select("seq", "error.code", "error.message")


@register("log_7_exclusion_and_id", f"""
WITH {LOG_SQL} SELECT seq, request_id IS NULL AS made, CAST(CASE WHEN request_id IS NULL THEN 12 ELSE length(request_id) END AS BIGINT) AS id_chars
FROM log WHERE path <> '/api/logs'""")
def _(spark, sf):
    entries = corpus.request_log(spark, sf)
    return audit.logged(entries).select("seq", (F.col("seq") % 10 == 0).alias("made"), F.length("request_id").alias("id_chars"))


@register("log_8_status_classes", f"""
WITH {LOG_SQL} SELECT count(*) AS total, count(*) FILTER (status < 400) AS ok, count(*) FILTER (status >= 400 AND status < 500) AS client_error,
  count(*) FILTER (status >= 500) AS server_error FROM log""")
def _(spark, sf):
    return audit.status_counts(corpus.request_log(spark, sf))


@register("log_8_badges", f"""
WITH {LOG_SQL} SELECT CASE WHEN status < 300 THEN 'ok' WHEN status < 500 THEN 'warn' ELSE 'err' END AS badge, count(*) AS n FROM log GROUP BY 1""")
def _(spark, sf):
    return corpus.request_log(spark, sf).groupBy(audit.badge(F.col("status")).alias("badge")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ sinks
@register("snk_1_log_append", f"WITH {LOG_SQL} SELECT request_id, path, CAST(status AS BIGINT) AS status, ts FROM log".replace(
    "path, CAST(status AS BIGINT) AS status, ts FROM log", "path, CAST(status AS BIGINT) AS status, date_trunc('millisecond', ts) AS ts FROM log"))
def _(spark, sf):
    out = working_dir(spark, "log")
    logs.append_log(corpus.request_log(spark, sf).drop("seq"), out)
    return logs.read_log(spark, out).select("request_id", "path", "status", "ts")


@register("snk_2_log_retention", f"""
WITH {LOG_SQL}, t AS (SELECT seq, date_trunc('millisecond', ts) AS ts FROM log)
SELECT seq, ts FROM t WHERE ts >= (SELECT max(ts) FROM t) - INTERVAL 24 HOUR""")
def _(spark, sf):
    # "now" is the newest entry, so that old test data keeps something
    base, entries = working_dir(spark, "retention"), corpus.request_log(spark, sf)
    logs.append_log(entries.withColumn("request_id", F.col("seq").cast("string")).drop("seq"), f"{base}/log")
    logs.rewrite_retained(spark, f"{base}/log", entries.agg(F.date_trunc("millisecond", F.max("ts"))).scalar(), 24)
    return logs.read_log(spark, f"{base}/log").select(F.col("request_id").cast("bigint").alias("seq"), "ts")


@register("snk_3_order_payloads", with_facts(f"""
SELECT '{{"apiKeyInfo":{{"ext_app_id":"A","ext_user_id":"U","jxt_open_id":"C1"}},"data":' || {PAYLOAD_SQL} || ',"userId":"O","roomId":"' || room || '"}}' AS payload
FROM f WHERE bill IS NOT NULL AND ({TITLE}) IS NOT NULL"""))
def _(spark, sf):
    ready, _ = extract.order_payloads(corpus.order_texts(spark, sf), customer_id="C1")
    out = working_dir(spark, "payloads")
    requests.write_payloads(ready.select(requests.envelope(F.col("order_data"), F.col("roomId"), "A", "U", "C1", "O").alias("payload")), out)
    return spark.read.text(out).withColumnRenamed("value", "payload")


@register("snk_4_log_export", f"""
WITH {LOG_SQL}, hit AS (SELECT seq FROM log WHERE status = 500) SELECT seq, (SELECT count(*) FROM hit) AS total FROM hit""")
def _(spark, sf):
    out = working_dir(spark, "export")
    logs.write_export(audit.search(corpus.request_log(spark, sf), status=500), out)
    return spark.read.schema("seq bigint, total bigint, exported_at timestamp").json(out).filter("exported_at IS NOT NULL").select("seq", "total")


@register("snk_5_single_entry_export", f"""
WITH {LOG_SQL} SELECT 'req-7' AS request_id, CAST(status AS BIGINT) AS status, CASE WHEN status >= 400 THEN 'http_' || CAST(status AS VARCHAR) END AS error_code
FROM log WHERE request_id = 'req-7'""")
def _(spark, sf):
    entries = corpus.request_log(spark, sf)
    entries = entries.withColumn("error", audit.error_default(F.col("status"), F.col("error")))
    one = logs.export_one(entries, "req-7")
    return one.select(F.get_json_object("entry", "$.request.request_id").alias("request_id"),
                      F.get_json_object("entry", "$.request.status").cast("bigint").alias("status"),
                      F.get_json_object("entry", "$.error.code").alias("error_code"))


# ------------------------------------------------------------------ streams
@register("str_1_streaming_orders", with_facts(f"""
SELECT room AS "roomId", count(*) AS n, count(*) FILTER (bill IS NOT NULL AND ({TITLE}) IS NOT NULL) AS ready,
  count(*) FILTER (bill IS NULL OR ({TITLE}) IS NULL) AS rejected FROM f GROUP BY room"""))
def _(spark, sf):
    base = working_dir(spark, "orders")
    corpus.order_texts(spark, sf).select(F.to_json(F.struct("content", "roomId")).alias("value")).write.text(f"{base}/in")
    flows.stream_orders(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    out = spark.read.schema(flows.ORDER_OUTPUT).parquet(f"{base}/out")
    return out.groupBy("roomId").agg(F.count("*").alias("n"), F.count_if(F.col("payload").isNotNull()).alias("ready"),
                                     F.count_if(F.col("error_code") == "order_not_ready").alias("rejected"))


@register("str_1_answered_once", with_facts(f"""
SELECT room AS "roomId", CASE WHEN bill IS NOT NULL AND ({TITLE}) IS NOT NULL THEN
    '{{"apiKeyInfo":{{"ext_app_id":"","ext_user_id":"","jxt_open_id":""}},"data":' || replace({PAYLOAD_SQL}, '"c_id":"C1"', '"c_id":""') || ',"userId":"","roomId":"' || room || '"}}' END AS payload,
  concat_ws('|', CASE WHEN bill IS NULL THEN 'order_num1' END, CASE WHEN ({TITLE}) IS NULL THEN 'c_title' END) AS missing_fields,
  CASE WHEN bill IS NULL OR ({TITLE}) IS NULL THEN 'order_not_ready' END AS error_code FROM f"""))
def _(spark, sf):
    # the stream is stopped and started again; the second delivery holds requests of the first one, and some of its own twice
    base, texts = working_dir(spark, "orders"), corpus.order_texts(spark, sf)
    line = F.to_json(F.struct("content", "roomId")).alias("value")
    texts.filter("doc_id % 2 = 0").select(line).write.mode("append").text(f"{base}/in")
    flows.stream_orders(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    again = texts.filter("doc_id % 2 = 1 OR doc_id % 4 = 0").unionByName(texts.filter("doc_id % 6 = 1"))
    again.select(line).write.mode("append").text(f"{base}/in")
    for _ in range(2):  # the last start finds nothing new
        flows.stream_orders(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema(flows.ORDER_OUTPUT).parquet(f"{base}/out")


ROUNDS = 3


@register("str_2_refreshed_pages", f"""
WITH {LOG_SQL}, cut AS (SELECT seq, path, status, ntile({ROUNDS}) OVER (ORDER BY seq) - 1 AS part FROM log WHERE path <> '/api/logs')
SELECT round, seq, path, CAST(status AS BIGINT) AS status FROM cut, (SELECT unnest(range({ROUNDS})) AS round) r
WHERE part <= round QUALIFY row_number() OVER (PARTITION BY round ORDER BY seq DESC) <= 50""")
def _(spark, sf):
    # a running stream takes in what is appended, and a second one goes on from its checkpoint; the newest page after each part
    base = working_dir(spark, "log-refresh")
    entries = corpus.request_log(spark, sf).filter("path <> '/api/logs'").withColumn("request_id", F.col("seq").cast("string"))
    cuts = entries.stat.approxQuantile("seq", [k / ROUNDS for k in range(1, ROUNDS)], 0.0)
    out, query = None, None
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = entries.filter((F.lit(True) if low is None else F.col("seq") > low) & (F.lit(True) if high is None else F.col("seq") <= high))
        newest = part.orderBy(F.desc("seq")).limit(200)  # the end of the part, in a file of its own that is the last one
        edge = newest.agg(F.min("seq")).first()[0]
        line = F.to_json(F.struct(*[c for c in entries.columns if c != "seq"])).alias("value")
        part.filter(F.col("seq") < edge).select(line).write.mode("append").text(f"{base}/in")
        newest.coalesce(1).sortWithinPartitions("seq").select(line).write.mode("append").text(f"{base}/in")
        if query is None:
            query = flows.stream_log(spark, f"{base}/in", f"{base}/out", f"{base}/state", once=False, refresh="1 second")
        query.processAllAvailable()
        items, _ = audit.page(flows.search_table(spark, f"{base}/out"), limit=50)
        page = cut_lineage(items.select(F.lit(k).alias("round"), F.col("request_id").cast("bigint").alias("seq"), "path", "status"), "page")
        out = page if out is None else out.unionByName(page)
        if k == ROUNDS - 2:
            query.stop()
            query = None
    query.stop()
    return out


def streamed_log(spark, sf):
    """The search table that the stream makes from a log, written in ranges of entries, whose file names have their order."""
    base = working_dir(spark, "log-stream")
    lines = corpus.request_log(spark, sf).repartitionByRange("seq").sortWithinPartitions("seq").drop("seq").select(F.to_json(F.struct("*")).alias("value"))
    lines.write.text(f"{base}/in")
    flows.stream_log(spark, f"{base}/in", f"{base}/out", f"{base}/state", by_name=True).awaitTermination()
    return spark.read.parquet(f"{base}/out")


@register("str_2_newest_page", f"""
WITH {LOG_SQL} SELECT path, CAST(status AS BIGINT) AS status, file, request_id FROM log
WHERE path <> '/api/logs' AND request_id IS NOT NULL ORDER BY seq DESC LIMIT 100 OFFSET 50""")
def _(spark, sf):
    items, _ = audit.page(streamed_log(spark, sf).filter("request_id LIKE 'req-%'"), limit=100, offset=50)
    return items.select("path", "status", "file", "request_id")


@register("str_2_streaming_log", f"""
WITH {LOG_SQL} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS log_date, count(*) AS n, count(*) FILTER (status >= 400) AS errors
FROM log WHERE path <> '/api/logs' GROUP BY 1""")
def _(spark, sf):
    return streamed_log(spark, sf).groupBy(F.col("log_date").cast("string").alias("log_date")).agg(
        F.count("*").alias("n"), F.count_if(F.col("error.code").isNotNull()).alias("errors"))
