"""Document sources: binary files and converted text (SRC-1, SRC-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightdocs import dictionaries as D
from freightdocs.operators import routing, triage
from freightdocs.session import cut_lineage

#: Folders that written documents are dealt to, rows of a listing in one batch, files and bytes of a task that reads, bytes of its batches.
FOLDERS, LISTED_ROWS, TASK_FILES, TASK_BYTES, BATCH_BYTES = 256, 10_000, 50_000, 128_000_000, 16_000_000


def file_name(path):
    return F.element_at(F.split(path, "/"), -1)


def accepted_documents(spark: SparkSession, path: str) -> DataFrame:
    """Only the files with an accepted suffix: the others are left out while the folders are listed and never opened.

    As in Spark's own reader, names that begin with ``.`` or ``_`` and empty files are left out. Tasks list the folders and read the files,
    so the driver holds neither names nor contents, however many there are.
    """
    files = _read(_listed(spark, path)).select(
        F.xxhash64("path").alias("doc_id"), file_name(F.col("path")).alias("file"), "content", F.col("length").alias("n_bytes"))
    return triage.split_by_suffix(files)[0]


def _opened(path: str) -> tuple:
    """The file system of a path, its folder there, and what Spark writes before the folder in a path."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        root = "/" + path.removeprefix("file:").strip("/")
        return fs.LocalFileSystem(), root, f"file:{root}"
    store, root = fs.FileSystem.from_uri(path)
    return store, root.rstrip("/"), path.rstrip("/")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of the accepted files below a folder, listed level by level and written to the shared folder."""
    suffixes = tuple(D.ACCEPTED_SUFFIXES)

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root, base = _opened(path)
        for b in batches:
            for folder in b.column("folder").to_pylist():
                rows = []
                for x in store.get_file_info(fs.FileSelector(f"{root}{folder}")):
                    name = x.path.rsplit("/", 1)[-1]
                    hidden = name.startswith(".") or name.endswith("._COPYING_") or (
                        name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))
                    if hidden:
                        continue
                    if x.type == fs.FileType.Directory:
                        rows.append((f"{folder}/{name}", None, None))
                    elif name.lower().endswith(suffixes) and x.size != 0:
                        rows.append((None, f"{base}{folder}/{name}", x.size))
                for k in range(0, len(rows), LISTED_ROWS):
                    columns = zip(*rows[k : k + LISTED_ROWS], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)],
                                                     names=["folder", "path", "length"])

    found = None
    level = spark.createDataFrame([("",)], "folder string")
    while level is not None:
        entries = cut_lineage(level.mapInArrow(run, "folder string, path string, length long"), "listed")
        files, n = entries.filter("path IS NOT NULL").select("path", "length"), entries.filter("folder IS NOT NULL").count()
        found = files if found is None else found.unionByName(files)
        # a folder may hold many files, so each task lists a few
        tasks = min(n, max(spark.sparkContext.defaultParallelism, n // 16))
        level = entries.filter("folder IS NOT NULL").select("folder").repartition(tasks, "folder") if n else None
    return found


def _read(files: DataFrame) -> DataFrame:
    """``path, length`` with the ``content`` of each file; a task reads about ``TASK_FILES`` of them or ``TASK_BYTES``."""
    def run(batches):
        import pyarrow as pa

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)],
                                              names=["path", "length", "content"])

        rows, size, stores = [], 0, {}
        for b in batches:
            for path in b.column("path").to_pylist():
                folder, file = path.rsplit("/", 1)
                if folder not in stores:
                    stores[folder] = _opened(folder)
                store, root, _ = stores[folder]
                with store.open_input_stream(f"{root}/{file}") as source:
                    content = source.read()
                rows.append((path, len(content), content))
                size += len(content)
                if size > BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, n // TASK_FILES, size // TASK_BYTES)
    return files.repartition(int(tasks), "path").mapInArrow(run, "path string, length long, content binary")


def write_documents(df: DataFrame, path: str) -> None:
    """Contents ``(file, content)`` as files below a folder of any file system that Arrow knows; a task writes its rows one by one.

    Files are dealt to ``FOLDERS`` folders by a hash of their names, so that no folder has to be listed as a whole.
    """
    def run(batches):
        from zlib import crc32

        store, root, _ = _opened(path)
        store.create_dir(root)
        made = set()
        for b in batches:
            for file, content in zip(b.column("file").to_pylist(), b.column("content").to_pylist(), strict=True):
                folder = f"{root}/{crc32(str(file).encode()) % FOLDERS:03x}"
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                with store.open_output_stream(f"{folder}/{file}") as out:
                    out.write(content)
            yield b.select(["file"])
    df.select("file", "content").mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()


def binary_documents(spark: SparkSession, path: str, glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Files below a folder as (accepted, rejected) rows; content is read only where it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select(
        F.xxhash64("path").alias("doc_id"), file_name(F.col("path")).alias("file"), "content",
        F.col("length").alias("n_bytes"))
    return triage.split_by_suffix(files)


def text_corpus(df: DataFrame) -> DataFrame:
    """SRC-2: converted texts ``(doc_id, file, text)`` with their routing text."""
    return df.withColumn("route_text", routing.route_text(F.col("file"), F.col("text")))
