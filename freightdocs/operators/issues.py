"""Review issues, as a table and as a column of one record.

Table form: ``issues(doc_id, seq, code, field, message, source_values, blocking)``.
Grouping first merges equal values (partial aggregation), so one document that
holds a third of all rows shrinks before it reaches a single task.

Array form: the issue log of one record in order of appearance; ``merge_keys``
and ``one_per_code`` fold it once at the end instead of after every rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightdocs import dictionaries as D
from freightdocs.functions import text as t

ISSUE_TYPE = "struct<code:string,field:string,message:string,source_values:array<string>,blocking:boolean>"
ISSUES_TYPE = f"array<{ISSUE_TYPE}>"


# ------------------------------------------------------------------ table form
def _merged_values(df: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered union of ``source_values`` per key: distinct first, then one short list."""
    values = (df.select(*keys, "seq", F.posexplode("source_values").alias("pos", "value"))
              .groupBy(*keys, "value").agg(F.min(F.struct("seq", "pos")).alias("at")))
    return values.groupBy(*keys).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("source_values"))


def append_merge(df: DataFrame) -> DataFrame:
    """ISS-1: one row per (doc, code, field): latest message, blocking by OR, ordered values."""
    keys = ["doc_id", "code", "field"]
    base = df.groupBy(*keys).agg(
        F.min("seq").alias("seq"),
        F.max_by("message", "seq").alias("message"),
        F.bool_or(F.coalesce("blocking", F.lit(True))).alias("blocking"))
    return _with_values(base, _merged_values(df, keys), keys)


def merge_by_code(df: DataFrame) -> DataFrame:
    """ISS-2: one row per (doc, code): first message, common field, blocking by OR, ordered values."""
    df = df.filter(F.coalesce(F.col("code"), F.lit("")) != "")
    keys = ["doc_id", "code"]
    root = F.split(F.col("field"), r"[.\[]", 2)[0]
    base = df.groupBy(*keys).agg(
        F.min("seq").alias("seq"),
        F.min_by("message", "seq").alias("message"),
        F.min("field").alias("_low"), F.max("field").alias("_high"),
        F.min(root).alias("_low_root"), F.max(root).alias("_high_root"),
        F.bool_or(F.coalesce("blocking", F.lit(True))).alias("blocking"))
    base = base.withColumn("field", F.when(
        (F.col("_low") == F.col("_high")) & (F.col("_low") != ""), F.col("_low"))
        .when((F.col("_low_root") == F.col("_high_root")) & (F.col("_low_root") != ""), F.col("_low_root"))
        .otherwise("multiple_fields"))
    return _with_values(base, _merged_values(df, keys), keys)


def _with_values(base: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    joined = base.join(values, keys, "left")
    return joined.select("doc_id", "seq", "code", "field", "message",
                         F.coalesce("source_values", t.empty_strings()).alias("source_values"), "blocking")


def force_blocking(df: DataFrame, codes: DataFrame) -> DataFrame:
    """ISS-3: some codes always block (``codes`` is the issue code dictionary)."""
    hits = codes.filter("always_blocking").select("code", F.lit(True).alias("_hit"))
    return (df.join(hits, "code", "left")
            .withColumn("blocking", F.coalesce("blocking", F.lit(True)) | F.coalesce("_hit", F.lit(False)))
            .drop("_hit"))


def keep_known(df: DataFrame, codes: DataFrame, item_counts: DataFrame) -> DataFrame:
    """ISS-4: drop unknown codes and repair ``containers[]`` paths by the number of items."""
    known = df.join(codes.select("code"), "code", "left_semi")
    return (known.join(item_counts, "doc_id", "left")
            .withColumn("field", repaired_field(F.col("field"), F.coalesce("n_items", F.lit(0))))
            .drop("n_items"))


def repaired_field(field: Column, n_items: Column) -> Column:
    return F.when(F.startswith(field, F.lit("containers[]")), F.concat(
        F.when(n_items == 1, F.lit("containers[0]")).otherwise(F.lit("containers")),
        F.substr(field, F.lit(13)))).otherwise(field)


def remove(df: DataFrame, keys: DataFrame) -> DataFrame:
    """ISS-5: delete exact (doc, code, field) rows."""
    return df.join(keys.select("doc_id", "code", "field"), ["doc_id", "code", "field"], "left_anti")


def ordered(df: DataFrame, codes: DataFrame) -> DataFrame:
    """ISS-6: output place by priority, code, field.

    The rows were merged to one per code before, so a document holds few of them.
    """
    from pyspark.sql import Window

    joined = df.join(codes.select("code", "priority"), "code", "left").withColumn(
        "priority", F.coalesce("priority", F.lit(D.DEFAULT_PRIORITY)))
    w = Window.partitionBy("doc_id").orderBy("priority", "code", "field")
    return joined.withColumn("place", F.row_number().over(w))


def readiness(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """ISS-7: a document is ready when none of its issues blocks."""
    flags = issues.groupBy("doc_id").agg(
        F.bool_or(F.coalesce("blocking", F.lit(True))).alias("_blocked"))
    return (docs.select("doc_id").join(flags, "doc_id", "left")
            .select("doc_id", (~F.coalesce("_blocked", F.lit(False))).alias("ready_for_order")))


# ------------------------------------------------------------------ array form
def no_issues() -> Column:
    return F.array().cast(ISSUES_TYPE)


def issue(code, field, message, values: Column | None = None, blocking: bool = True) -> Column:
    def as_col(x):
        return x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_col(code).alias("code"), as_col(field).alias("field"), as_col(message).alias("message"),
        (t.empty_strings() if values is None else values).alias("source_values"),
        F.lit(blocking).alias("blocking")).cast(ISSUE_TYPE)


def issue_when(condition: Column, *args, **kwargs) -> Column:
    """Array with one issue, or none."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(issue(*args, **kwargs))).otherwise(no_issues())


def drop_where(issues: Column, predicate) -> Column:
    return F.filter(issues, lambda i: ~F.coalesce(predicate(i), F.lit(False)))


def merge_keys(issues: Column) -> Column:
    """ISS-1 on the issue log of one record."""
    keys = F.array_distinct(F.transform(issues, lambda i: F.struct(i["code"].alias("code"), i["field"].alias("field"))))
    return t.let(issues, lambda log: F.transform(keys, lambda k: t.let(
        F.filter(log, lambda i: (i["code"] == k["code"]) & i["field"].eqNullSafe(k["field"])),
        lambda group: F.struct(
            k["code"].alias("code"), k["field"].alias("field"),
            F.element_at(group, -1)["message"].alias("message"),
            F.array_distinct(F.flatten(F.transform(
                group, lambda i: F.coalesce(i["source_values"], t.empty_strings())))).alias("source_values"),
            F.exists(group, lambda i: F.coalesce(i["blocking"], F.lit(True))).alias("blocking")))))


def one_per_code(issues: Column) -> Column:
    """ISS-2 on the issue log of one record."""
    coded = F.filter(issues, lambda i: F.coalesce(i["code"], F.lit("")) != "")

    def merged(group: Column) -> Column:
        fields = F.array_distinct(F.transform(group, lambda i: i["field"]))
        roots = F.array_distinct(F.transform(group, lambda i: F.split(i["field"], r"[.\[]", 2)[0]))
        first = F.get(group, F.lit(0))
        return F.struct(
            first["code"].alias("code"),
            F.when((F.size(fields) == 1) & (first["field"] != ""), first["field"])
            .when((F.size(roots) == 1) & (F.get(roots, F.lit(0)) != ""), F.get(roots, F.lit(0)))
            .otherwise("multiple_fields").alias("field"),
            first["message"].alias("message"),
            F.array_distinct(F.flatten(F.transform(
                group, lambda i: F.coalesce(i["source_values"], t.empty_strings())))).alias("source_values"),
            F.exists(group, lambda i: F.coalesce(i["blocking"], F.lit(True))).alias("blocking"))

    return t.let(coded, lambda log: F.transform(
        F.array_distinct(F.transform(log, lambda i: i["code"])),
        lambda code: t.let(F.filter(log, lambda i: i["code"] == code), merged)))


def forced(issues: Column) -> Column:
    """ISS-3 on the issue log of one record."""
    return F.transform(issues, lambda i: i.withField(
        "blocking", F.coalesce(i["blocking"], F.lit(True)) | i["code"].isin(*D.BLOCKING_CODES)))


def known(issues: Column, n_items: Column) -> Column:
    """ISS-4 on the issue log of one record."""
    return F.transform(F.filter(issues, lambda i: i["code"].isin(*D.KNOWN_CODES)),
                       lambda i: i.withField("field", repaired_field(i["field"], n_items)))


def in_order(issues: Column) -> Column:
    """ISS-6 on the issue log of one record."""
    def priority(code: Column) -> Column:
        out = None
        for p in sorted(set(D.ISSUE_PRIORITY.values())):
            hit = code.isin(*[c for c, q in D.ISSUE_PRIORITY.items() if q == p])
            out = F.when(hit, p) if out is None else out.when(hit, p)
        return out.otherwise(D.DEFAULT_PRIORITY)
    tagged = F.transform(issues, lambda i: F.struct(
        priority(i["code"]).alias("p"), i["code"].alias("c"), i["field"].alias("f"), i.alias("issue")))
    return F.transform(F.array_sort(tagged), lambda x: x["issue"])


def is_ready(issues: Column) -> Column:
    """ISS-7 on the issue log of one record."""
    return ~F.exists(issues, lambda i: F.coalesce(i["blocking"], F.lit(True)))
