"""Data quality evaluation: field diffs, fixture integrity, route pinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freightdocs.functions.plan import settle
from freightdocs.session import cut_lineage

#: Levels of a tree that one step of the diff opens before it looks whether anything is left.
LEVELS = 2
DIFF_COLUMNS = ("doc_id", "path", "kind", "expected", "actual")


# ---- EVL-1
def as_tree(df: DataFrame, name: str) -> Column:
    """A record as variant: JSON text is parsed, structs, maps and arrays are taken over, a variant stays."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.VariantType):
        return F.col(name)
    return F.parse_json(F.col(name)) if isinstance(kind, T.StringType) else F.to_variant_object(F.col(name))


def _json(value: Column) -> Column:
    return F.coalesce(F.to_json(value), F.lit("null"))


def _number(value: Column) -> Column:
    """The value of a JSON number, and 1 or 0 for a truth value; null for all else."""
    kind = F.schema_of_variant(value)
    return F.when(F.rlike(kind, F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")), F.try_variant_get(value, "$", "double")).when(
        kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))


def _opened(df: DataFrame) -> DataFrame:
    """One level: an open row becomes rows of its children or a finding; equal parts and nothing else disappear."""
    fields = {side: F.try_variant_get(F.col(side), "$", "map<string,variant>") for side in "ea"}
    lists = {side: F.try_variant_get(F.col(side), "$", "array<variant>") for side in "ea"}
    df = df.select("*", F.when(F.col("kind").isNull(), F.struct(
        fields["e"].alias("em"), fields["a"].alias("am"), lists["e"].alias("el"), lists["a"].alias("al"))).alias("_t"))
    t = F.col("_t")

    def row(path, e, a, in_e, in_a) -> Column:
        kind = F.when(~in_e, "unexpected").when(~in_a, "missing")
        return F.struct(path.alias("path"), kind.alias("kind"), F.when(in_e & ~in_a, _json(e)).alias("expected"), F.when(in_a & ~in_e, _json(a)).alias("actual"),
                        F.when(in_e & in_a, e).alias("e"), F.when(in_e & in_a, a).alias("a"))

    def finding(kind: str, expected, actual) -> Column:
        return F.struct(F.col("path"), F.lit(kind).alias("kind"), expected.alias("expected"), actual.alias("actual"),
                        F.lit(None).cast("variant").alias("e"), F.lit(None).cast("variant").alias("a"))

    def child(key: Column) -> Column:
        return row(F.concat(F.col("path"), F.lit("."), key), t["em"][key], t["am"][key],
                   F.map_contains_key(t["em"], key), F.map_contains_key(t["am"], key))

    keys = F.array_union(F.map_keys(t["em"]), F.map_keys(t["am"]))
    yes = F.lit(True)
    shorter = F.slice(t["el"], F.lit(1), F.least(F.size(t["el"]), F.size(t["al"])))
    items = F.transform(shorter, lambda e, i: row(F.concat(F.col("path"), F.lit("["), i.cast("string"), F.lit("]")), e, F.get(t["al"], i), yes, yes))
    length = F.when(F.size(t["el"]) != F.size(t["al"]), F.array(finding("length", F.size(t["el"]).cast("string"), F.size(t["al"]).cast("string"))))
    itself = F.array(F.struct("path", "kind", "expected", "actual", "e", "a"))
    same = _number(F.col("e")) == _number(F.col("a"))
    children = (F.when(F.col("kind").isNotNull(), itself)
                .when(t["em"].isNotNull() & t["am"].isNotNull(), F.transform(keys, child))
                .when(t["el"].isNotNull() & t["al"].isNotNull(), F.when(length.isNotNull(), F.concat(length, items)).otherwise(items))
                .when(~F.coalesce(same, F.lit(False)), F.array(finding("differs", _json(F.col("e")), _json(F.col("a"))))))
    out = df.select("doc_id", F.explode(children).alias("_c")).select("doc_id", "_c.*")
    return out.filter(F.col("kind").isNotNull() | (_json(F.col("e")) != _json(F.col("a"))))


def field_diffs(expected: DataFrame, actual: DataFrame, name: str = "record") -> DataFrame:
    """``doc_id, path, kind, expected, actual`` of every place where two records ``(doc_id, record)`` differ.

    Records are trees of any shape and depth (JSON text, variant, or nested columns). Keys of one side alone are ``missing``
    or ``unexpected``, lists of other lengths ``length`` (sizes as values), other values ``differs``; items are compared up to
    the shorter list, with all that is below them. Numbers are equal by value. Records of one side alone differ at ``$``.
    Values come as JSON. Both sides meet once, by ``doc_id``; from there each level is opened within the row, and equal
    parts are left behind at once, so only what leads to a difference is carried down.
    """
    left = expected.select("doc_id", F.col(name).alias("_e"), F.lit(True).alias("_in_e"))
    right = actual.select("doc_id", F.col(name).alias("_a"), F.lit(True).alias("_in_a"))
    both = left.join(right, "doc_id", "full_outer")
    if expected.schema[name].dataType == actual.schema[name].dataType and "map" not in (kind := expected.schema[name].dataType.simpleString()) and "variant" not in kind:
        both = both.filter(~F.col("_e").eqNullSafe(F.col("_a")) | F.col("_in_e").isNull() | F.col("_in_a").isNull())  # most records are equal as they stand
    both = settle(both.select("doc_id", "_in_e", "_in_a", as_tree(both, "_e").alias("e"), as_tree(both, "_a").alias("a")))
    kind = F.when(F.col("_in_e").isNull(), "unexpected").when(F.col("_in_a").isNull(), "missing")
    rows = both.select("doc_id", F.lit("$").alias("path"), kind.alias("kind"), F.when(F.col("_in_a").isNull(), _json(F.col("e"))).alias("expected"),
                       F.when(F.col("_in_e").isNull(), _json(F.col("a"))).alias("actual"), "e", "a")
    done = []
    while True:
        for _ in range(LEVELS):
            rows = _opened(rows)
        rows = cut_lineage(rows, "diff-frontier")
        done.append(rows.filter(F.col("kind").isNotNull()).select(*DIFF_COLUMNS))
        rows = rows.filter(F.col("kind").isNull())
        if rows.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


# ---- EVL-2
def broken_fixtures(assets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Assets ``(case, asset, content)`` whose hash is not the pinned one, or that are absent."""
    actual = assets.select("case", "asset", F.sha2("content", 256).alias("actual_sha256"))
    return (manifest.join(actual, ["case", "asset"], "left")
            .filter(~F.col("sha256").eqNullSafe(F.col("actual_sha256"))))


# ---- EVL-3
def route_mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Cases whose parser, template or mapped flag differs from the pinned one (nulls compare equal)."""
    names = ("parser", "template_hint", "deterministic_mapper")
    joined = expected.join(actual.select("case", *[F.col(n).alias(f"actual_{n}") for n in names]), "case", "left")

    def wrong(n: str) -> Column:
        return ~F.col(n).eqNullSafe(F.col(f"actual_{n}"))
    return joined.withColumn("wrong", F.array_compact(F.array(*[F.when(wrong(n), F.lit(n)) for n in names]))).filter(
        F.size("wrong") > 0)
