"""Line dedup on content-defined chunks of lines.

A text's lines are hashed, and a rolling hash over the line hashes is the key of every two neighbouring lines that hold a word
(``line_pairs``). Over the whole corpus each key gets its first occurrence (smallest id, then text hash, then place). A chunk
is a longest run of such windows that stood before in the same order in one document: it begins and ends where the rolling
hash stops to occur again, or goes on elsewhere. So boundaries depend on lines alone, move with them, and no repeated run of
two or more lines is missed. A chunk is compared byte by byte, as a whole, with the lines of its first occurrence, and cut out
where the bytes are equal.

``chunks`` are the coarser form: boundaries are lines where the rolling hash over ``WINDOW`` line hashes is divisible by
``SPREAD``, at least ``MIN_LINES`` apart. They take fewer keys, and miss short repeated blocks without two borders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightdocs.llm.common import mixed, narrow, release, shuffled, small_batches, word_codes, written

WINDOW = 2
SPREAD = 4
MIN_LINES = 2
#: Factor and width of the rolling hash; odd, so that no line hash loses bits.
ROLL, LOW = 0x9E3779B97F4A7C15F39CC0605CEDC835, 2**128 - 1
#: Bytes of chunks that one Arrow batch of them may hold, beyond its first row.
BATCH_BYTES = 1 << 24


def boundaries(lines: list[bytes], spread: int = SPREAD) -> list[int]:
    """Line numbers after which a chunk ends; the last is the number of lines."""
    codes = word_codes(lines)
    roll = np.zeros(len(codes), np.uint64)
    for i in range(WINDOW):
        roll[i:] += codes[: len(codes) - i] * np.uint64(2 * i + 3) ** np.uint64(7)
    at = np.flatnonzero(mixed(roll) % np.uint64(spread) == 0) + 1
    ends, last = [], 0
    for x in at.tolist():
        if x - last >= MIN_LINES:
            ends.append(x)
            last = x
    if last < len(lines):
        ends.append(len(lines))
    return ends


def _rolled(codes: list[int], start: int, end: int) -> bytes:
    """128-bit rolling hash of the line hashes ``start`` to ``end``."""
    roll = 0
    for x in codes[start:end]:
        roll = (roll * ROLL + x) & LOW
    return roll.to_bytes(16, "little")


def _coded(text: str) -> tuple[list[bytes], list[int]]:
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    return lines, [xxhash.xxh3_128_intdigest(x) for x in lines]


def chunks(text: str) -> list[tuple[int, int, bytes]]:
    """``(first line, end line, key)`` of the chunks with at least two lines that hold a word."""
    lines, codes = _coded(text)
    out, start = [], 0
    for end in boundaries(lines):
        if end - start >= 2 and sum(bool(x.strip()) for x in lines[start:end]) >= 2:
            out.append((start, end, _rolled(codes, start, end)))
        start = end
    return out


def line_pairs(text: str) -> list[tuple[int, int, bytes]]:
    """``(first line, end line, key)`` of every two neighbouring lines that hold a word, with the blank lines between them."""
    lines, codes = _coded(text)
    at = [k for k, x in enumerate(lines) if x.strip()]
    return [(s, e + 1, _rolled(codes, s, e + 1)) for s, e in zip(at, at[1:])]


Cutter = Callable[[str], list[tuple[int, int, bytes]]]


def _tagged(docs: DataFrame) -> DataFrame:
    """Rows are told apart by id and text: rows that repeat both count as one document and come out alike."""
    return docs.withColumns({"__row_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")), "__row_tag": F.xxhash64("text")})


def repeated_chunks(docs: DataFrame, cutter: Cutter = line_pairs) -> DataFrame:
    """``__row_id, __row_tag, start, end`` of every chunk whose bytes occurred before, in another document or higher up in the same.

    A window that shares lines with the first occurrence itself is none. Windows that overlap and whose first occurrences
    overlap alike, one after the other in one document, are one chunk.
    """
    small_batches(docs.sparkSession)
    texts = _tagged(narrow(docs, "doc_id", "text")).select("__row_id", "__row_tag", "text").filter("text IS NOT NULL")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for b in batches:
            yield pd.DataFrame(
                [(i, t, k, s, e, key) for i, t, text in zip(b["__row_id"], b["__row_tag"], b["text"], strict=True)
                 for k, (s, e, key) in enumerate(cutter(text))],
                columns=["__row_id", "__row_tag", "no", "start", "end", "key"])

    found = written(texts.mapInPandas(cut, "__row_id long, __row_tag long, no int, start int, end int, key binary"), "line-windows")
    place = F.struct("__row_id", "__row_tag", "no", "start", "end")
    again = found.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    later = found.join(shuffled(again.select("key", "first")), "key").drop("key").filter(~place.eqNullSafe(F.col("first")) & ~(
        (F.col("__row_id") == F.col("first.__row_id")) & (F.col("__row_tag") == F.col("first.__row_tag"))
        & (F.col("start") < F.col("first.end")))).distinct()

    # a chunk goes on while both sides go on: windows of one document only, in their order
    doc = ["__row_id", "__row_tag"]
    ordered = Window.partitionBy(*doc).orderBy("no")
    before = F.lag(F.struct("no", "end", "first")).over(ordered)
    goes_on = ((F.col("before.no") + 1 == F.col("no")) & (F.col("start") < F.col("before.end"))
               & (F.col("before.first.__row_id") == F.col("first.__row_id")) & (F.col("before.first.__row_tag") == F.col("first.__row_tag"))
               & (F.col("before.first.no") + 1 == F.col("first.no")))
    numbered = later.withColumn("before", before).withColumn("chunk", F.sum(F.when(goes_on, 0).otherwise(1)).over(ordered))
    source = F.struct(F.min("first.__row_id").alias("id"), F.min("first.__row_tag").alias("tag"), F.min("first.start").alias("start"), F.max("first.end").alias("end"))
    runs = written(numbered.groupBy(*doc, "chunk").agg(F.min("start").alias("start"), F.max("end").alias("end"), source.alias("source")).drop("chunk"), "line-runs")

    # bytes of the chunks and of the places they are compared with; all of them together are no longer than the documents
    firsts = runs.select(F.col("source.id").alias("__row_id"), F.col("source.tag").alias("__row_tag"), F.col("source.start").alias("start"),
                         F.col("source.end").alias("end"), "source").distinct().withColumn("is_first", F.lit(True))
    wanted = runs.withColumn("is_first", F.lit(False)).unionByName(firsts)
    per_doc = wanted.groupBy(*doc).agg(F.collect_list(F.struct("start", "end", "source", "is_first")).alias("at"))
    columns = ["__row_id", "__row_tag", "start", "end", "id", "tag", "from", "to", "is_first", "body"]

    def bytes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, size = [], 0
            for i, t, text, at in zip(b["__row_id"], b["__row_tag"], b["text"], b["at"], strict=True):
                lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                for x in at:
                    body, source = b"\n".join(lines[x["start"] : x["end"]]), x["source"]
                    rows.append((i, t, x["start"], x["end"], source["id"], source["tag"], source["start"], source["end"], x["is_first"], body))
                    size += len(body)
                    if size > BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=columns)

    bodies = written(texts.join(shuffled(per_doc), doc).mapInPandas(
        bytes_of, "__row_id long, __row_tag long, start int, end int, id long, tag long, from int, to int, is_first boolean, body binary"), "line-bodies")
    key = ["id", "tag", "from", "to"]
    first_bodies = bodies.filter("is_first").groupBy(*key).agg(F.min("body").alias("first_body"))
    return bodies.filter("NOT is_first").join(shuffled(first_bodies), key).filter("body = first_body").select(*doc, "start", "end").distinct()


def deduplicated(docs: DataFrame, cutter: Cutter = line_pairs) -> DataFrame:
    """All columns of ``docs``, with ``text`` cut, and ``n_lines, cut_lines, cut_chunks`` (long).

    The first occurrence of a chunk stays: the one with the smallest id (a null id comes first), then text hash, then place.
    A null text stays null with 0 lines, an empty one is one line and stays. An empty table gives an empty table. A column
    of ``docs`` that is named like one of the three counts gives way to it. Chunks that overlap are cut and counted as one.
    """
    repeats = repeated_chunks(docs, cutter).groupBy("__row_id", "__row_tag").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cut"))
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "cut_lines", "cut_chunks")]

    @F.pandas_udf("text string, n_lines long, cut_lines long, cut_chunks long")
    def without(texts: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        rows = []
        for text, cut in zip(texts, cuts, strict=True):
            if text is None:
                rows.append((None, 0, 0, 0))
                continue
            lines = text.split("\n")
            n, gone = len(lines), []
            for x in () if cut is None else cut:
                if gone and x["start"] < gone[-1][1]:
                    gone[-1] = (gone[-1][0], max(gone[-1][1], x["end"]))
                else:
                    gone.append((x["start"], x["end"]))
            for s, e in reversed(gone):
                del lines[s:e]
            rows.append(("\n".join(lines), n, n - len(lines), len(gone)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "cut_lines", "cut_chunks"])

    joined = _tagged(docs.select(*[F.col(f"`{c}`") for c in keep])).join(shuffled(repeats), ["__row_id", "__row_tag"], "left")
    out = joined.withColumn("__new", without("text", "__cut"))
    return out.select(*[F.col("__new.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in keep],
                      "__new.n_lines", "__new.cut_lines", "__new.cut_chunks")
