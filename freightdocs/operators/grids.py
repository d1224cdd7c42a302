"""Sheets and paragraphs to text: cell rendering, merged ranges, trimming, grids, coverage.

Cells are rows ``(doc_id, sheet, row, col, ...)`` with 1-based places. Keys that
feed a shuffle always hold the place as well (row, or tile of rows and columns),
so one huge sheet is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightdocs import dictionaries as D
from freightdocs.functions import text as t
from freightdocs.operators import issues as iss

TILE_ROWS, TILE_COLS = 64, 16


# ---- DOC-5
def clean_cell(c: Column) -> Column:
    """Text of a cell: line breaks as ``<br>``, no trailing blanks."""
    return t.rstrip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n|\r|\n", "<br>"))


def escaped(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def date_cell(stamp: Column, number_format: Column) -> Column:
    """A date or time cell by its number format, without inventing a midnight."""
    fmt = F.lower(F.coalesce(number_format, F.lit("")))
    has_date = F.rlike(fmt, F.lit("yy|dd"))
    has_time = F.rlike(fmt, F.lit(r"(?<![a-z])h{1,2}(?![a-z])|(?<![a-z])s{1,2}(?![a-z])"))
    seconds = F.contains(fmt, F.lit("s"))
    return (F.when(has_date & has_time, F.when(seconds, F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))
                   .otherwise(F.date_format(stamp, "yyyy-MM-dd HH:mm")))
            .when(has_time, F.when(seconds, F.date_format(stamp, "HH:mm:ss")).otherwise(F.date_format(stamp, "HH:mm")))
            .otherwise(F.date_format(stamp, "yyyy-MM-dd")))


def rendered(value: Column, stamp: Column, number_format: Column) -> Column:
    return F.when(stamp.isNotNull(), date_cell(stamp, number_format)).otherwise(clean_cell(value))


def legacy_rendered(number: Column, stamp: Column, value: Column) -> Column:
    """Legacy sheets: midnight shows the date only, whole floats show as integers."""
    midnight = F.date_format(stamp, "HH:mm:ss") == "00:00:00"
    return (F.when(stamp.isNotNull(), F.when(midnight, F.date_format(stamp, "yyyy-MM-dd"))
                   .otherwise(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")))
            .when(number.isNotNull(), F.when(number == F.floor(number), F.floor(number).cast("string"))
                  .otherwise(number.cast("string")))
            .otherwise(clean_cell(value)))


# ---- DOC-6
def suppress_merged(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Drop cells of a merged range except its top-left one.

    Ranges ``(doc_id, sheet, r1, r2, c1, c2)`` are cut into tiles and joined on the
    tile, so neither a large sheet nor a large range meets every other row.
    """
    tiles = (ranges.withColumn("_tr", F.explode(F.sequence(
                 F.floor(F.col("r1") / TILE_ROWS), F.floor(F.col("r2") / TILE_ROWS))))
             .withColumn("_tc", F.explode(F.sequence(
                 F.floor(F.col("c1") / TILE_COLS), F.floor(F.col("c2") / TILE_COLS)))))
    placed = cells.withColumn("_tr", F.floor(F.col("row") / TILE_ROWS)).withColumn(
        "_tc", F.floor(F.col("col") / TILE_COLS))
    left, right = placed.alias("c"), tiles.alias("r")
    covered = (
        (F.col("c.doc_id") == F.col("r.doc_id")) & (F.col("c.sheet") == F.col("r.sheet"))
        & (F.col("c._tr") == F.col("r._tr")) & (F.col("c._tc") == F.col("r._tc"))
        & F.col("c.row").between(F.col("r.r1"), F.col("r.r2")) & F.col("c.col").between(F.col("r.c1"), F.col("r.c2"))
        & ~((F.col("c.row") == F.col("r.r1")) & (F.col("c.col") == F.col("r.c1"))))
    return left.join(right, covered, "left_anti").drop("_tr", "_tc")


# ---- DOC-7
def _filled(cells: DataFrame) -> Column:
    """A cell with a value, or with a formula whose value is not cached."""
    out = F.coalesce("value", F.lit("")) != ""
    return out | F.coalesce(F.startswith("formula", F.lit("=")), F.lit(False)) if "formula" in cells.columns else out


def sheet_bounds(cells: DataFrame) -> DataFrame:
    """Last row and column with content per sheet."""
    return cells.filter(_filled(cells)).groupBy("doc_id", "sheet").agg(
        F.max("row").alias("max_row"), F.max("col").alias("max_col"))


def trim(cells: DataFrame) -> DataFrame:
    """Cells inside the bounds; inner blanks stay."""
    return (cells.join(sheet_bounds(cells), ["doc_id", "sheet"])
            .filter((F.col("row") <= F.col("max_row")) & (F.col("col") <= F.col("max_col"))))


# ---- DOC-8
def column_letter(n: Column) -> Column:
    """1 is A, 27 is AA; fourteen steps are enough for every bigint."""
    start = F.struct(n.cast("bigint").alias("rest"), F.lit("").alias("out"))

    def step(s: Column, _: Column) -> Column:
        rest = s["rest"] - 1
        return F.when(s["rest"] > 0, F.struct(F.floor(rest / F.lit(26).cast("decimal(20,0)")).cast("bigint").alias("rest"), F.concat(
            F.char(F.lit(65) + rest % 26), s["out"]).alias("out"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda s: s["out"])


def _row_line(head: Column, cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.concat(F.array(head), cells), " | "), F.lit(" |"))


def grid_lines(cells: DataFrame) -> DataFrame:
    """Rows ``(doc_id, sheet, line_no, line)`` of the dense grid: header, separator, data rows."""
    inside = trim(cells)
    filled = inside.groupBy("doc_id", "sheet", "row", "max_col").agg(
        F.map_from_entries(F.collect_list(F.struct("col", escaped(F.col("value"))))).alias("_cells"))
    # every row of the sheet appears, also the blank ones between
    bounds = sheet_bounds(cells)
    dense = bounds.withColumn("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("max_row").cast("bigint"))))
    joined = dense.join(filled.drop("max_col"), ["doc_id", "sheet", "row"], "left")
    columns = F.sequence(F.lit(1), F.col("max_col").cast("int"))
    data = joined.select("doc_id", "sheet", (F.col("row") + 1).alias("line_no"), _row_line(
        F.col("row").cast("string"), F.transform(columns, lambda c: F.coalesce(
            F.try_element_at(F.col("_cells"), c.cast("bigint")), F.lit("")))).alias("line"))
    head = bounds.select("doc_id", "sheet", F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("line_no"),
                 _row_line(F.lit("_row/col_"), F.transform(columns, column_letter)).alias("line")),
        F.struct(F.lit(1).cast("bigint").alias("line_no"),
                 _row_line(F.lit("---"), F.transform(columns, lambda c: F.lit("---"))).alias("line")))).alias("x")
    ).select("doc_id", "sheet", "x.*")
    return head.unionByName(data)


def range_name(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return F.concat(column_letter(c1), r1.cast("string"), F.lit(":"), column_letter(c2), r2.cast("string"))


def formula_lines(cells: DataFrame) -> DataFrame:
    """Table rows of formula cells with their cached value or ``_unavailable_``."""
    place = F.concat(column_letter(F.col("col")), F.col("row").cast("string"))
    shown = F.when(F.coalesce("value", F.lit("")) != "", F.col("value")).otherwise("_unavailable_")
    return cells.filter(F.startswith("formula", F.lit("="))).select(
        "doc_id", "sheet", "row", "col",
        F.concat(F.lit("| "), F.concat_ws(" | ", *[escaped(c) for c in (place, F.col("formula"), shown)]),
                 F.lit(" |")).alias("line"))


def sheet_text(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, sheet, text): the grid, then the merged ranges, then the formulas; ``_empty sheet_`` where nothing is filled.

    Lines are gathered last and once per sheet: they are its text.
    """
    if "formula" not in cells.columns:
        cells = cells.withColumn("formula", F.lit(None).cast("string"))
    shown = suppress_merged(cells, ranges)
    bounds = sheet_bounds(shown)

    def numbered(df: DataFrame, part: int) -> DataFrame:
        return df.select("doc_id", "sheet", F.lit(part).alias("part"), F.struct(
            F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).alias("at"), "line")

    def heading(df: DataFrame, part: int, *lines: str) -> DataFrame:
        rows = F.posexplode(F.array(*[F.lit(x) for x in lines])).alias("b", "line")
        return numbered(df.select("doc_id", "sheet").distinct().select("doc_id", "sheet", F.lit(-1).alias("a"), rows), part)

    grid = grid_lines(shown).select("doc_id", "sheet", F.col("line_no").alias("a"), F.lit(0).alias("b"), "line")
    kept = ranges.join(bounds, ["doc_id", "sheet"], "left_semi")
    merged = kept.select("doc_id", "sheet", F.col("r1").alias("a"), F.col("c1").alias("b"), F.concat(
        F.lit("- `"), range_name(F.col("r1"), F.col("c1"), F.col("r2"), F.col("c2")), F.lit("`")).alias("line"))
    formulas = formula_lines(trim(shown)).select("doc_id", "sheet", F.col("row").alias("a"), F.col("col").alias("b"), "line")
    empty = cells.select("doc_id", "sheet").distinct().join(bounds, ["doc_id", "sheet"], "left_anti")
    parts = [numbered(grid, 0), heading(merged, 1, "", "### Merged ranges", ""), numbered(merged, 1),
             heading(formulas, 2, "", "### Formula cells", "", "| Cell | Formula | Cached value |", "| --- | --- | --- |"),
             numbered(formulas, 2), heading(empty, 0, "_empty sheet_")]
    lines = parts[0]
    for more in parts[1:]:
        lines = lines.unionByName(more)
    return lines.groupBy("doc_id", "sheet").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("part", "at", "line"))), lambda x: x["line"]), "\n").alias("text"))


# ---- DOC-9
def coverage(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Per document: sheets, filled cells, merged ranges, formulas and their cached values.

    Cells that a merged range covers are not counted.
    """
    cells = suppress_merged(cells, ranges)
    is_formula = F.coalesce(F.startswith("formula", F.lit("=")), F.lit(False))
    has_value = F.coalesce("value", F.lit("")) != ""
    missing = is_formula & ~has_value
    place = F.concat("sheet", F.lit("!"), column_letter(F.col("col")), F.col("row").cast("string"))
    counted = cells.groupBy("doc_id").agg(
        F.count_distinct("sheet").alias("sheet_count"),
        F.count_if(has_value | is_formula).alias("nonempty_cells"),
        F.count_if(is_formula).alias("formula_cells"),
        F.count_if(is_formula & has_value).alias("formula_values_available"),
        F.count_if(missing).alias("formula_values_missing"))
    omitted = cells.filter(missing).groupBy("doc_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("sheet", "row", "col", place.alias("place")))),
        lambda x: x["place"]).alias("omissions"))
    merged = ranges.groupBy("doc_id").agg(F.count("*").alias("merged_ranges"))
    return (counted.join(merged, "doc_id", "left").join(omitted, "doc_id", "left")
            .withColumn("merged_ranges", F.coalesce("merged_ranges", F.lit(0)))
            .withColumn("omissions", F.coalesce("omissions", t.empty_strings()))
            .withColumn("complete", F.size("omissions") == 0))


def coverage_issues(report: DataFrame) -> DataFrame:
    """Parser issues of a coverage report; ``legacy`` marks sheets whose formulas cannot be read."""
    legacy = F.coalesce("legacy", F.lit(False))
    found = F.concat(
        iss.issue_when(legacy, "legacy_xls_formula_unverified", "source", D.MESSAGES["legacy_formula"]),
        iss.issue_when(~legacy & (F.size("omissions") > 0), "formula_value_unavailable", "source",
                       D.MESSAGES["formula_missing"], F.col("omissions")),
        iss.issue_when(~legacy & ~F.col("complete") & (F.size("omissions") == 0), "conversion_coverage_incomplete",
                       "source", D.MESSAGES["coverage_incomplete"]))
    return report.withColumn("issues", found)


# ---- DOC-10
def paragraph_lines(df: DataFrame) -> DataFrame:
    """Marked lines of paragraphs ``(doc_id, p, text)``; soft breaks become ``_pN.k_`` lines."""
    body = t.rstrip(F.regexp_replace("text", r"\r\n|\r", "\n"))
    number = F.col("p").cast("string")
    parts = F.split(body, "\n")

    def mark(name: Column, content: Column) -> Column:
        return F.when(t.is_blank(content), F.concat(F.lit("_p"), name, F.lit(": (empty)_"))).otherwise(
            F.concat(F.lit("_p"), name, F.lit("_ "), content))

    shown = F.when(t.is_blank(body) | (F.size(parts) == 1), F.array(mark(number, body))).otherwise(
        F.transform(parts, lambda s, i: mark(F.concat(number, F.lit("."), (i + 1).cast("string")), t.rstrip(s))))
    return df.select("doc_id", "p", F.posexplode(shown).alias("k", "line"))


def section_lines(df: DataFrame) -> DataFrame:
    """Lines ``(doc_id, at, k, line)`` of stories, text boxes and embedded images, each kind below its own heading.

    ``df(doc_id, kind, part_no, part, n, text, file, relation)``: ``kind`` is ``story``, ``text_box`` or ``image``, ``n`` counts
    from 1 within a story part or, for the other two, within the document. A heading comes once, however many rows follow.
    """
    number = F.col("n").cast("string")
    kind = F.col("kind")
    rank = F.when(kind == "story", 0).when(kind == "text_box", 1).otherwise(2).alias("rank")
    part = F.when(kind == "story", F.col("part_no")).otherwise(0).alias("part_no")

    def lines(*parts) -> Column:
        return F.array(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    body = F.when(kind == "story", lines(F.concat(F.lit("_p"), number, F.lit("_ "), "text"), "")).when(
        kind == "text_box", lines(F.concat(F.lit("### Text box "), number), F.concat(F.lit("_source: "), "part", F.lit("_")), "", F.col("text"), "")
    ).otherwise(lines(F.concat(F.lit("### Image "), number, F.lit(": "), "file"), F.concat(
        F.lit("_source: "), "part", F.lit("#"), "relation", F.lit("; content is routed separately for image verification_")), ""))
    title = F.when(kind == "story", F.concat(F.lit("## Story: "), "part")).when(kind == "text_box", "## Text boxes").otherwise("## Embedded images")
    rows = df.select("doc_id", rank, part, "n", body.alias("lines"), lines(title, "").alias("head"))
    # the first row of a part brings the heading: rows that lie together by document need no shuffle for it
    first = F.row_number().over(Window.partitionBy("doc_id", "rank", "part_no", "head").orderBy("n")) == 1
    own = F.struct("n", "lines")
    both = F.array(F.struct(F.lit(0).cast(df.schema["n"].dataType).alias("n"), F.col("head").alias("lines")), own)
    parts = rows.withColumn("_first", first).select("doc_id", "rank", "part_no", F.explode(F.when(F.col("_first"), both).otherwise(F.array(own))).alias("x"))
    return parts.select("doc_id", F.struct("rank", "part_no", F.col("x.n").alias("n")).alias("at"), F.posexplode("x.lines").alias("k", "line"))
