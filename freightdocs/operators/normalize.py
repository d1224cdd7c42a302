"""Normalisation of candidate records: loose keys and values to typed fields.

Candidates arrive as rows ``(doc_id, pos, key, value)``; items of a document as
``(doc_id, idx, pos, key, value)``. Rows are reduced by aggregates that combine
before the shuffle, then pivoted on the fixed list of field names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightdocs import dictionaries as D
from freightdocs.functions import text as t
from freightdocs.functions import values as v
from freightdocs.operators import issues as iss
from freightdocs.schemas import CONTAINER_FIELDS, CONTAINERS_TYPE, TEXT_FIELDS

CONTAINER_KEYS = tuple(CONTAINER_FIELDS) + ("container_type_qty",)
TOP_KEYS = (
    "doc_type", *TEXT_FIELDS, "vessel_voyage", "container_type_qty", "port_opening_time",
    "factory_address", "factory_contact", "factory_phone",
    *(k for k in D.LEAKED_CONTAINER_FIELDS),
)


# ---- NRM-1
def canonical_fields(df: DataFrame, aliases: DataFrame, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (ids, field, value): one per canonical key, by order of the original keys.

    The first value counts; a later alias only fills a null; a later canonical
    key overwrites, even with null. The alias maps are short constants: they go to the rows, so that rows which lie
    together by document stay so and are not shuffled by their keys.
    """
    ids = list(ids)
    direct = aliases.select(F.col("alias").alias("key"), F.col("canonical").alias("_direct"))
    bare = aliases.select(F.col("alias").alias("_bare_key"), F.col("canonical").alias("_bare"))
    named = (
        df.join(F.broadcast(direct), "key", "left")
        .withColumn("_bare_key", F.when(
            F.rlike("key", F.lit(rf"(?U){t.BLANK}")) & (F.coalesce("_direct", "key") == F.col("key")),
            t.remove_blanks(F.col("key"))))
        .join(F.broadcast(bare), "_bare_key", "left")
        .select(*ids, "pos", "value",
                F.coalesce("_bare", "_direct", "key").alias("field"),
                (F.col("_bare").isNull() & (F.coalesce("_direct", "key") == F.col("key"))).alias("own"))
    )
    keys = [*ids, "field"]
    # a record holds each key once, so a field has no more entries than it has names
    entries = named.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "own", "value"))).alias("entries"))

    def decided(own: Column) -> Column:
        after = F.filter(F.col("entries"), lambda e: ~e["own"] & e["value"].isNotNull() & (own.isNull() | (e["pos"] > own["pos"])))
        return F.coalesce(own["value"], F.get(after, F.lit(0))["value"])

    last_own = F.try_element_at(F.filter("entries", lambda e: e["own"]), F.lit(-1))
    return entries.select(*keys, t.let(last_own, decided).alias("value"))


def pivot_fields(fields: DataFrame, names, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per id with one string column per name."""
    return fields.groupBy(*ids).agg(*[
        F.max(F.when(F.col("field") == name, F.col("value"))).alias(name) for name in dict.fromkeys(names)])


def top_aliases(spark) -> DataFrame:
    """Aliases of a record: the top map, then item keys that leaked to the top."""
    rows = {a: k for k, aliases in D.CONTAINER_ALIASES.items() for a in aliases}
    rows.update({a: k for k, aliases in D.TOP_ALIASES.items() for a in aliases})
    return spark.createDataFrame(list(rows.items()), "alias string, canonical string")


# ---- NRM-2
def doc_type_code(c: Column) -> Column:
    out = None
    for name, code in D.DOC_TYPE_NAMES.items():
        out = F.when(c == name, code) if out is None else out.when(c == name, code)
    return out.otherwise(c)


def filled(c: Column) -> Column:
    """Null for an empty string (a value that counts as absent)."""
    return F.when(c != "", c)


def merge_remark(remark: Column, label: str, value: Column) -> Column:
    item = F.concat(F.lit(f"{label}："), value)
    return F.when(value.isNull() | (value == ""), remark).when(t.is_blank(remark), item).when(
        F.contains(remark, item), remark).otherwise(F.concat(t.strip(remark), F.lit("；"), item))


def normalize_record(df: DataFrame) -> DataFrame:
    """Typed record of the pivoted candidate fields (without its items)."""
    vv = v.split_vessel_voyage(F.col("vessel_voyage"))
    tq = v.split_type_qty(F.col("container_type_qty"))
    out = df.withColumn("_vv", vv).withColumn("_tq", tq)
    out = out.withColumns({
        "doc_type": doc_type_code(F.col("doc_type")),
        "etd": v.normalize_date(F.col("etd")),
        "doc_date": v.normalize_date(F.col("doc_date")),
        "loading_time": v.normalize_date(F.col("loading_time"), allow_time=True),
        "vessel": F.coalesce(filled(F.col("vessel")), F.col("_vv.vessel"), F.col("vessel")),
        "voyage": F.coalesce(filled(F.col("voyage")), F.col("_vv.voyage"), F.col("voyage")),
        "type": F.coalesce(filled(F.col("type")), F.col("_tq.type"), F.col("type")),
        "qty": F.coalesce(F.col("qty"), F.col("_tq.qty").cast("string")),
        "remark": merge_remark(F.col("remark"), "开港时间", F.col("port_opening_time")),
    })
    return out.drop("_vv", "_tq", "vessel_voyage", "container_type_qty", "port_opening_time")


def fold_factory(df: DataFrame) -> DataFrame:
    """``factory`` struct of the named part plus the three leaked address fields where blank."""
    def part(name: str, leaked: str | None) -> Column:
        own = F.col(f"factory_part_{name}")
        return (F.coalesce(filled(own), filled(F.col(leaked)), own) if leaked else own).alias(name)
    return df.withColumn("factory", F.struct(
        part("name", None), part("address", "factory_address"), part("contact", "factory_contact"),
        part("phone", "factory_phone"))).drop("factory_address", "factory_contact", "factory_phone")


# ---- NRM-4
def normalize_item(df: DataFrame) -> DataFrame:
    """Typed container item from the pivoted item fields; unreadable numbers go to ``bad_numbers``."""
    tq = v.split_type_qty(F.col("container_type_qty"))
    out = (df.withColumn("_tq", tq)
           .withColumn("_packages", v.clean_number(F.col("packages"), integral=True))
           .withColumn("_weight", v.clean_number(F.col("gross_weight_kg"), integral=False))
           .withColumn("_volume", v.clean_number(F.col("volume_cbm"), integral=False)))
    return out.withColumns({
        "type": v.container_type(F.coalesce(filled(F.col("type")), F.col("_tq.type"), F.col("type"))),
        "qty": F.coalesce(F.col("qty").try_cast("int"), F.col("_tq.qty")),
        "packages": F.col("_packages.value").cast("int"),
        "packages_unit": F.coalesce(filled(F.col("packages_unit")), F.col("_packages.unit"), F.col("packages_unit")),
        "gross_weight_kg": F.col("_weight.value"),
        "volume_cbm": F.col("_volume.value"),
        "bad_numbers": F.array_compact(F.array("_packages.raw", "_weight.raw", "_volume.raw")),
    }).drop("_tq", "_packages", "_weight", "_volume", "container_type_qty")


# ---- NRM-3
def merge_leaked(records: DataFrame, items: DataFrame) -> DataFrame:
    """Items with the leaked top-level values folded into item 0, or making up a single item.

    ``records`` carries the leaked string columns; ``items`` is typed (NRM-4).
    """
    names = D.LEAKED_CONTAINER_FIELDS
    leaked = records.filter(F.coalesce(*names).isNotNull()).select(
        "doc_id", *names, *[F.lit(None).cast("string").alias(k) for k in CONTAINER_KEYS if k not in names])
    leaked = normalize_item(leaked).select("doc_id", F.lit(0).alias("idx"), *[
        F.col(k).alias(f"leaked_{k}") for k in (*names, "bad_numbers")])
    joined = items.join(leaked, ["doc_id", "idx"], "full_outer")
    merged = [F.coalesce(F.col(k), F.col(f"leaked_{k}")).cast(CONTAINER_FIELDS[k]).alias(k) if k in names
              else F.col(k) for k in CONTAINER_FIELDS]
    return joined.select("doc_id", "idx", *merged, F.concat(
        F.coalesce("bad_numbers", t.empty_strings()), F.coalesce("leaked_bad_numbers", t.empty_strings())
    ).alias("bad_numbers"))


def gather_items(items: DataFrame) -> DataFrame:
    """``containers`` array of each document, by index."""
    struct = F.struct("idx", F.struct(*[F.col(k) for k in CONTAINER_FIELDS]).alias("item"))
    return items.groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(struct)), lambda x: x["item"]).cast(CONTAINERS_TYPE).alias("containers"),
        F.flatten(F.collect_list("bad_numbers")).alias("bad_numbers"))


# ---- NRM-9
def is_known_type(c: Column) -> Column:
    return F.upper(v.container_type(c)).isin(*D.KNOWN_CONTAINER_TYPES)


def unknown_types(items: DataFrame, codes: DataFrame) -> DataFrame:
    """Items whose type code is in no dictionary (anti join)."""
    return (items.withColumn("code", F.upper(v.container_type(F.col("type"))))
            .join(codes, "code", "left_anti"))


# ---- NRM-10
FALSE_WORDS = ("false", "0", "no")


def normalize_issues(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split loose issue rows into (good issues, documents in error).

    ``df`` holds pivoted issue fields per (doc_id, pos) with ``source_values`` as
    JSON array or plain text. One bad item rejects its whole document.
    """
    bad = (t.is_blank(F.col("code")) | t.is_blank(F.col("field")) | t.is_blank(F.col("message"))
           | (F.col("code") == "unstructured_review_issue"))
    tagged = df.withColumn("_bad", F.coalesce(bad, F.lit(True)))
    errors = (tagged.filter("_bad").groupBy("doc_id")
              .agg(F.min("pos").alias("bad_pos"), F.min_by("code", "pos").alias("_code"))
              .select("doc_id", "bad_pos", F.when(
                  F.col("_code") == "unstructured_review_issue",
                  F.lit("unstructured_review_issue is not an allowed review issue code"))
                  .otherwise("code, field, and message must be non-empty strings").alias("reason")))
    values = F.when(F.col("source_values").isNull(), t.empty_strings()).otherwise(F.coalesce(
        F.when(F.startswith(F.col("source_values"), F.lit("[")), F.from_json("source_values", "array<string>")),
        F.array("source_values")))
    good = (tagged.join(errors.select("doc_id"), "doc_id", "left_anti")
            .select("doc_id", F.col("pos").cast("bigint").alias("seq"), t.strip(F.col("code")).alias("code"),
                    t.strip(F.col("field")).alias("field"), t.strip(F.col("message")).alias("message"),
                    values.alias("source_values"),
                    (~F.lower(t.strip(F.coalesce("blocking", F.lit("true")))).isin(*FALSE_WORDS)).alias("blocking")))
    return good, errors


# ---- NRM-11
def repair_issues(df: DataFrame, repairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace the issue list of rejected documents once by its repaired list."""
    good, errors = normalize_issues(df)
    second = repairs.join(errors.select("doc_id"), "doc_id", "left_semi")
    fixed, still_bad = normalize_issues(second)
    missing = errors.join(repairs.select("doc_id"), "doc_id", "left_anti")
    return good.unionByName(fixed), missing.unionByName(still_bad)


# ---- NRM-12
def port(c: Column, source_text: Column) -> Column:
    """Upper-case port with its state or country modifier, adopted from the text if it is only there."""
    upper = F.regexp_replace(t.strip(F.upper(c)), rf"(?U){t.BLANK}+", " ")
    word = r"[A-Za-z][A-Za-z .'-]*"
    modifier = rf"(\(\s*{word}\s*\)(?:\s*,\s*{word})?|,\s*{word})"

    def with_modifier(p: Column) -> Column:
        literal = F.concat(F.lit(r"(?iuU)(?<![A-Za-z])\Q"), F.replace(p, F.lit("\\E"), F.lit("")),
                           F.lit(r"\E\s*" + modifier))
        return F.concat(p, F.upper(_extract_dynamic(source_text, literal)))

    adopted = t.let(upper, lambda p: F.when(
        source_text.isNull() | F.rlike(p, F.lit(r"\([^)]*\)|,")), p).otherwise(with_modifier(p)))
    state = r"(?Us)^(.+?)\s*\(\s*([A-Z]{2})\s*\)\z"
    stated = t.let(adopted, lambda p: F.when(F.rlike(p, F.lit(state)), F.concat(
        t.strip(F.regexp_extract(p, state, 1)), F.lit(", "), F.regexp_extract(p, state, 2))).otherwise(p))
    return F.regexp_replace(stated, r"(?U)\s*,\s*", ", ")


def _extract_dynamic(text: Column, pattern: Column) -> Column:
    """First group of a pattern that differs by row; empty if there is no match."""
    return F.coalesce(F.get(F.regexp_extract_all(text, pattern, F.lit(1)), F.lit(0)), F.lit(""))


# ---- NRM-13
def sanitize_measures(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Null out non-positive measures; issue rows list them as ``field=value``."""
    def shown(name: str) -> Column:
        text = F.col(name).cast("string") if name != "packages" else F.col(name).cast("bigint").cast("string")
        return F.when(F.col(name) <= 0, F.concat(F.lit(f"{name}="), text))

    names = ("packages", "gross_weight_kg", "volume_cbm")
    flagged = items.withColumn("invalid", F.array_compact(F.array(*[shown(n) for n in names])))
    clean = flagged.withColumns({
        "packages": F.when(F.col("packages") > 0, F.col("packages")),
        "gross_weight_kg": F.when(F.col("gross_weight_kg") > 0, F.round("gross_weight_kg", 3)),
        "volume_cbm": F.when(F.col("volume_cbm") > 0, F.round("volume_cbm", 3)),
    }).drop("invalid")
    rows = flagged.filter(F.size("invalid") > 0).select(
        "doc_id", F.lit("missing_container_measurements").alias("code"),
        F.concat(F.lit("containers["), F.col("idx").cast("string"), F.lit("]")).alias("field"),
        F.lit(D.MESSAGES["non_positive"]).alias("message"), F.col("invalid").alias("source_values"),
        F.lit(True).alias("blocking"))
    return clean, rows


# ---- NRM-14
BILL_NO = r"^[A-Za-z0-9]{8,}\z"


def bill_ok(c: Column) -> Column:
    return F.rlike(t.strip(c), F.lit(BILL_NO))


def sanitized_bill(c: Column) -> Column:
    """The trimmed bill number, null if malformed; blank stays as it is."""
    return F.when(t.is_blank(c), c).when(bill_ok(c), t.strip(c))


def bill_issue(c: Column, key: str, field) -> Column:
    return iss.issue_when(~t.is_blank(c) & ~bill_ok(c), f"invalid_{key}", field, D.MESSAGES["bill_format"],
                          F.array(t.strip(c)))


# ---- NRM-15
# The pattern decides, not the calendar: an impossible day in ISO form stays as written.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}\z"
ISO_DATE_OR_TIME = r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2})?\z"


def sanitized_date(c: Column, allow_time: bool = False) -> Column:
    pattern = F.lit(ISO_DATE_OR_TIME if allow_time else ISO_DATE)
    return t.let(v.normalize_date(c, allow_time), lambda n: F.when(F.rlike(n, pattern), n))


def date_issue(c: Column, field: str, allow_time: bool = False) -> Column:
    return iss.issue_when(~t.is_blank(c) & sanitized_date(c, allow_time).isNull(), "invalid_date_format", field,
                          D.MESSAGES["date_format"], F.array(c))
