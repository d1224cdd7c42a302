"""Routing: document type, template and the request text for batch inference.

The marker dictionaries are a dozen short strings, so they are compiled into
one expression per row: a document is scanned once and nothing is shuffled.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightdocs import dictionaries as D
from freightdocs.functions import text as t


def route_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f:：]", ""))


def _py_route_key(marker: str) -> str:
    import re
    return re.sub(r"[\s:：]", "", marker).lower()


def route_text(file: Column, text: Column) -> Column:
    """SRC-2: the text that is routed: file name, line break, converted text."""
    return F.concat(file, F.lit("\n"), F.coalesce(text, F.lit("")))


def _any(text: Column, markers) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(text, F.lit(_py_route_key(m)))
    return out


def template_of(key: Column) -> Column:
    """RTE-1: first template whose markers all occur."""
    out = None
    for template, markers in D.TEMPLATE_MARKERS:
        hit = F.lit(True)
        for m in markers:
            hit = hit & F.contains(key, F.lit(_py_route_key(m)))
        out = F.when(hit, template) if out is None else out.when(hit, template)
    return out


def doc_type_of(key: Column) -> Column:
    """RTE-2: type by the first marker group that occurs; operational words make packing trucking."""
    words = sum((F.contains(key, F.lit(w)).cast("int") for w in D.TRUCKING_WORDS), F.lit(0))
    out = None
    for doc_type, markers in D.DOC_TYPE_MARKERS:
        hit = _any(key, markers)
        value = F.lit(doc_type)
        if doc_type == "PACKING_NOTICE":
            value = F.when(words >= 2, F.lit("TRUCKING_ORDER")).otherwise(value)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise("UNKNOWN")


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Value of a constant dictionary; null for an unknown key (the map is folded to a literal)."""
    return F.try_element_at(F.from_json(F.lit(json.dumps(table)), "map<string,string>"), c)


def with_route(df: DataFrame, text: Column) -> DataFrame:
    """Add ``route_type`` and ``route_template``."""
    routed = t.let(route_key(text), lambda k: F.struct(
        doc_type_of(k).alias("doc_type"), template_of(k).alias("template")))
    df = df.withColumn("_route", routed)
    # RTE-3, first half: an unknown type falls back to the template's
    return df.withColumns({
        "route_type": F.coalesce(F.nullif(F.col("_route.doc_type"), F.lit("UNKNOWN")),
                                 lookup(F.col("_route.template"), D.TEMPLATE_DOC_TYPES), F.lit("UNKNOWN")),
        "route_template": F.col("_route.template"),
    }).drop("_route")


def apply_route(df: DataFrame) -> DataFrame:
    """RTE-3, second half: a known route type replaces the candidate's; the mapper's template wins."""
    return df.withColumns({
        "doc_type": F.coalesce(F.nullif(F.col("route_type"), F.lit("UNKNOWN")), F.col("doc_type")),
        "template_hint": F.coalesce(F.col("mapped_template"), F.col("route_template")),
    })


def reference_year(file: Column) -> Column:
    return F.regexp_extract(file, r"(?<!\d)(20\d{2})(?!\d)", 1).try_cast("int")


def example_name(doc_type: Column, template: Column) -> Column:
    return F.coalesce(lookup(template, D.TEMPLATE_EXAMPLES), lookup(doc_type, D.DOC_TYPE_EXAMPLES))


def request_text(text: Column, file: Column, doc_format: Column, extracted_at: Column) -> Column:
    """RTE-11: the text of one inference request (fixed values: its header and frame lines)."""
    return F.concat(
        F.lit("待抽取托书。\nfile="), file, F.lit("\ndoc_format="), doc_format,
        F.lit("\nextracted_at="), extracted_at, F.lit("\n\n===== 文档内容开始 =====\n"), text,
        F.lit("\n===== 文档内容结束 =====\n\n请输出 JSON，source 字段用上述元数据填充。"))


def locked_note(values_json: Column) -> Column:
    """Locked values attached to a request (fixed values: the sentence before them); null where nothing is locked."""
    return F.concat(F.lit(
        "以下 JSON 字段已经由高置信模板确定性映射锁定。只补充其中未覆盖的字段，不得改写锁定值；"
        "若原文看似冲突，保留锁定值并写入 blocking review_issues：\n"), values_json)
