"""Files below a folder: what is accepted, and that the driver does not list them."""

from pyspark.sql import functions as F

from freightdocs.sources import documents


def scanned(spark, path):
    rows = documents.accepted_documents(spark, str(path)).select("doc_id", "file", "content", "n_bytes", "suffix").collect()
    return sorted((r.doc_id, r.file, bytes(r.content), r.n_bytes, r.suffix) for r in rows)


def test_scan_equals_the_binary_reader(spark, tmp_path):
    deep = tmp_path / "a b" / "_x=1" / "ü"
    deep.mkdir(parents=True)
    (tmp_path / "_hidden").mkdir()
    (tmp_path / ".trash").mkdir()
    for folder in (tmp_path, deep, tmp_path / "_hidden", tmp_path / ".trash"):
        for k, name in enumerate(("one.pdf", "two.PDF", "dré i.docx", "no.txt", "none", ".pdf", "_x.pdf", "_x=1.pdf", "x.pdf.txt", "empty.tif", "xtif")):
            (folder / name).write_bytes(b"" if name == "empty.tif" else f"{folder} {k}".encode() * k)
    theirs = documents.binary_documents(spark, str(tmp_path))[0].select("doc_id", "file", "content", "n_bytes", "suffix").collect()
    assert scanned(spark, tmp_path) == sorted((r.doc_id, r.file, bytes(r.content), r.n_bytes, r.suffix) for r in theirs) != []


def test_written_files_are_read_by_tasks(spark, tmp_path):
    path = f"{tmp_path}/files"
    df = spark.range(300).select(F.concat("id", F.when(F.col("id") % 3 == 0, ".txt").otherwise(".Pdf")).alias("file"),
                                 F.encode(F.concat(F.lit("text "), "id"), "UTF-8").alias("content"))
    documents.write_documents(df, path)
    found = documents.accepted_documents(spark, path)
    # a scan of the files themselves would hold all their names in the driver
    assert "binaryFile" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.file, bytes(r.content)) for r in found.orderBy("file").collect()] == sorted(
        (f"{k}.Pdf", f"text {k}".encode()) for k in range(300) if k % 3)
