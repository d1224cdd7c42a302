"""Registry of the named queries and of the ANSI SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightdocs import dictionaries as D
from freightdocs.operators import issues as iss
from freightdocs.schemas import CONTAINERS_TYPE, CONTAINER_FIELDS, FACTORY_TYPE, TEXT_FIELDS
from freightdocs.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: a query under its name, with its check if SQL can express it."""
    def keep(fn):
        QUERIES[name] = lambda spark, sf_dir: flat(fn(spark, sf_dir))
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return keep


def flat(df: DataFrame) -> DataFrame:
    """Scalar columns only: string arrays joined by ``|``, integers as bigint."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def with_facts(sql: str) -> str:
    return f"WITH {corpus.FACTS_SQL}\n{sql}"


def note_sql(sql: str) -> str:
    """SQL over ``nf(k, pos, label, value)``, the fields of the rendered notes."""
    rows = " UNION ALL ".join(
        f"SELECT k, {i} AS pos, '{label}' AS label, {e} AS value FROM f" for i, (label, e) in enumerate(corpus.NOTE_FIELDS))
    return with_facts(f", nf AS (SELECT * FROM ({rows}) u WHERE value IS NOT NULL)\n{sql}")


def values_sql(rows, names: str) -> str:
    """A VALUES table of strings."""
    body = ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) v({names}))"


def facts(spark: SparkSession, sf_dir: str, with_lines: bool = False) -> DataFrame:
    return corpus.facts(spark, sf_dir, with_lines)


def keyed(spark: SparkSession, sf_dir: str, with_lines: bool = False, **columns: str) -> DataFrame:
    """``doc_id`` and columns given as expressions over the facts of one order."""
    return facts(spark, sf_dir, with_lines).select(
        F.col("k").alias("doc_id"), *[F.expr(e).alias(n) for n, e in columns.items()])


def blank_record(df: DataFrame) -> DataFrame:
    """Fill up a frame to a working record: absent fields null, absent lists empty."""
    defaults = {name: F.lit(None).cast("string") for name in (*TEXT_FIELDS, "doc_type", "template_hint", "text", "file")}
    defaults.update(
        reference_year=F.lit(None).cast("int"), factory=F.lit(None).cast(FACTORY_TYPE),
        containers=F.array().cast(CONTAINERS_TYPE), review_issues=iss.no_issues(), issues=iss.no_issues(),
        carriers=F.array().cast("array<string>"))
    return df.withColumns({n: c for n, c in defaults.items() if n not in df.columns})


def item(**fields: str) -> Column:
    """A container item from expressions."""
    return F.struct(*[
        (F.expr(fields[k]) if k in fields else F.lit(None)).cast(kind).alias(k) for k, kind in CONTAINER_FIELDS.items()])


def items(*parts: Column) -> Column:
    return F.array(*parts).cast(CONTAINERS_TYPE)


def issue_lines(issues: Column) -> Column:
    """Issues as ``code/field/values/blocking`` joined by ``;``."""
    return F.array_join(F.transform(issues, lambda i: F.concat_ws(
        "/", i["code"], i["field"], F.array_join(i["source_values"], ","), i["blocking"].cast("string"))), ";")


__all__ = ["D", "QUERIES", "CHECKS", "register", "flat", "with_facts", "note_sql", "values_sql", "facts", "keyed",
           "blank_record", "item", "items", "issue_lines"]
