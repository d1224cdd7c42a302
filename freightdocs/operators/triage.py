"""File triage: format by content, suffix check, upload limits, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightdocs import dictionaries as D


def suffix_of(file: Column) -> Column:
    """Lower-cased suffix of a file name with its dot; empty without one."""
    return F.lower(F.regexp_extract(file, r"(?s)[^/]+?(\.[^./]*[^./])\z", 1))


def _begins(content: Column, *magic: bytes) -> Column:
    out = F.lit(False)
    for m in magic:
        out = out | F.startswith(content, F.lit(bytearray(m)))
    return out


def image_format(content: Column) -> Column:
    """Raster format by signature, else null (fixed values: the magic bytes)."""
    webp = _begins(content, b"RIFF") & (F.substring(content, 9, 4) == F.lit(bytearray(b"WEBP")))
    return (F.when(_begins(content, b"\xff\xd8\xff"), "jpeg")
            .when(_begins(content, b"\x89PNG\r\n\x1a\n"), "png")
            .when(_begins(content, b"GIF87a", b"GIF89a"), "gif")
            .when(_begins(content, b"BM"), "bmp")
            .when(_begins(content, b"II*\x00", b"MM\x00*"), "tiff")
            .when(webp, "webp"))


def detect_format(content: Column) -> Column:
    """DOC-1: container format by content, never by name (fixed values: the marks)."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    prefix = F.regexp_replace(head, r"^[ \t\n\r\x0b\x0c]+", "")
    lowered = F.lower(prefix)

    def starts(c: Column, *marks: str) -> Column:
        out = F.lit(False)
        for m in marks:
            out = out | F.startswith(c, F.lit(m))
        return out

    word_xml = starts(prefix, "<?xml", "<pkg:package", "<w:wordDocument") & (
        F.contains(prefix, F.lit("schemas.microsoft.com/office/word/2003/wordml"))
        | F.contains(prefix, F.lit("schemas.microsoft.com/office/2006/xmlPackage")))
    is_zip = _begins(content, b"PK\x03\x04")
    return (F.when(F.length(content) == 0, "empty")
            .when(image_format(content).isNotNull(), image_format(content))
            .when(F.contains(F.substring(content, 1, 1024), F.lit(bytearray(b"%PDF-"))), "pdf")
            .when(_begins(content, b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), "ole")
            .when(starts(prefix, "{\\rtf"), "rtf")
            .when(starts(lowered, "<!doctype html", "<html"), "html")
            .when(word_xml, "word_xml")
            .when(is_zip & F.contains(content, F.lit(bytearray(b"word/document.xml"))), "docx")
            .when(is_zip & F.contains(content, F.lit(bytearray(b"xl/workbook.xml"))), "xlsx")
            .when(is_zip, "zip")
            .otherwise("unknown"))


def validate_content(df: DataFrame, formats: DataFrame) -> DataFrame:
    """DOC-2: add ``content_error`` from ``suffix``, ``detected`` and the accept matrix."""
    accepted = formats.select("suffix", "detected", F.lit(True).alias("_ok"))
    image = F.col("suffix").isin(*D.IMAGE_SUFFIX_FORMAT)
    is_raster = F.col("detected").isin(*sorted(set(D.IMAGE_SUFFIX_FORMAT.values())))
    checked = image | F.col("suffix").isin(*D.DOCUMENT_SUFFIX_FORMATS)
    return (df.join(accepted, ["suffix", "detected"], "left")
            .withColumn("content_error", F.when(image & ~is_raster, "unsupported_image_content")
                        .when(~image & (F.col("detected") == "empty"), "empty_file")
                        .when(checked & F.col("_ok").isNull(), "file_format_mismatch"))
            .drop("_ok"))


def upload_error(n_bytes: Column, cap: int = D.MAX_UPLOAD_BYTES) -> Column:
    """DOC-3: too large is told before empty."""
    return F.when(n_bytes > cap, "file_too_large").when(n_bytes == 0, "empty_file")


def provenance(df: DataFrame) -> DataFrame:
    """DOC-4: hashes, sizes and format; the binary column is dropped right here."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.withColumns({
        "source_sha256": F.sha2("content", 256),
        "content_sha256": F.when(text != "", F.sha2(F.encode(text, "UTF-8"), 256)),
        "source_bytes": F.length("content").cast("bigint"),
        "content_chars": F.length(text).cast("bigint"),
        "detected_format": detect_format(F.col("content")),
    }).drop("content")


def split_by_suffix(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-1: (accepted, rejected) files by suffix."""
    tagged = df.withColumn("suffix", suffix_of(F.col("file")))
    good = F.col("suffix").isin(*D.ACCEPTED_SUFFIXES)
    return tagged.filter(good), tagged.filter(~good).withColumn("error_code", F.lit("bad_request"))
