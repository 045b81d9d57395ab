"""Data-quality checks over whole data sets.

``*_rows`` style functions return the offending rows, however many there are;
``*_verdict`` functions return one row ``dataset, check, passed, detail_json``
per data set, ready for :func:`check_report`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestlens.functions.staging import pinned
from harvestlens.functions.text import trim_blank
from harvestlens.functions.variants import fields_of, is_object, kind_of, strict_pair, strict_value
from harvestlens.operators.profile import null_or_empty

# Keys every source configuration must have. Fixed values.
REQUIRED_CONFIG_KEYS = ("source_id", "source_type", "title", "data_link", "raw_dir")


def _names(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


# ---------------------------------------------------------------- source configurations


def check_source_configs(configs: DataFrame, cfg: str = "cfg_json") -> DataFrame:
    """Add parsed config, missing keys and verdict to JSON config texts; one projection, no shuffle.

    ``valid`` needs a mapping in which every required key is present (a null
    value counts as present). ``target_schema`` is an empty object by default.
    """
    text = trim_blank(F.col(cfg))
    keys = F.map_keys(fields_of(F.col("_value")))
    read = configs.withColumn("_pair", strict_pair(text))
    return (
        pinned(read, _value=strict_value(F.col("_pair"), text))
        .withColumn("_mapping", is_object(F.col("_value")))
        .withColumn(
            "missing_fields",
            F.when(F.col("_mapping"), F.array_except(_names(REQUIRED_CONFIG_KEYS), keys)),
        )
        .withColumn(
            "error_type",
            F.when(F.col("_value").isNull(), "InvalidConfig")
            .when(~F.col("_mapping"), "NotAMapping")
            .when(F.size("missing_fields") > 0, "MissingFields"),
        )
        .withColumn("valid", F.col("error_type").isNull())
        .withColumn(
            "target_schema",
            F.when(
                F.col("_mapping"),
                F.coalesce(
                    F.try_variant_get("_value", "$.target_schema", "variant"), F.parse_json(F.lit("{}"))
                ),
            ),
        )
        .withColumnRenamed("_value", "cfg")
        .drop("_pair", "_mapping")
    )


# ---------------------------------------------------------------- column catalogs


def missing_fields(catalog: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows (dataset, ordinal, field) for required columns a data set lacks.

    The small expectation is exploded per data set, then anti-joined on
    (dataset, field), so that a data set with very many columns spreads out.
    """
    wanted = catalog.select("dataset").distinct().select(
        "dataset", F.posexplode(_names(required)).alias("ordinal", "field")
    )
    have = catalog.select("dataset", F.col("column").alias("field"))
    return wanted.join(have, ["dataset", "field"], "left_anti").select(
        "dataset", F.col("ordinal").cast("long").alias("ordinal"), "field"
    )


def schema_differences(catalog: DataFrame, target_schema: Mapping[str, object]) -> DataFrame:
    """Rows (dataset, kind, field): ``missing`` and ``extra`` columns; extras only with an expectation."""
    missing = missing_fields(catalog, list(target_schema)).select(
        "dataset", F.lit("missing").alias("kind"), "field"
    )
    extra = catalog.select("dataset", F.lit("extra").alias("kind"), F.col("column").alias("field"))
    if target_schema:
        extra = extra.filter(~F.col("field").isin(*target_schema))
    else:
        extra = extra.filter(F.lit(False))
    return missing.unionByName(extra)


def type_mismatches(catalog: DataFrame, target_schema: Mapping[str, str]) -> DataFrame:
    """Rows (dataset, field, expected, observed) where the expected name is no part of the observed one."""
    expected = F.element_at(_literal_map(target_schema), F.col("column"))
    return (
        catalog.select("dataset", F.col("column").alias("field"), expected.alias("expected"),
                       F.col("dtype").alias("observed"))
        .filter(F.col("expected").isNotNull() & ~_type_matches(F.col("expected"), F.col("observed")))
    )


def _literal_map(values: Mapping[str, str]) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def _type_matches(expected: Column, observed: Column) -> Column:
    return F.contains(F.lower(observed), F.lower(expected))


# ---------------------------------------------------------------- JSON records


def with_record_fields(records: DataFrame, record: str) -> DataFrame:
    """Add ``_fields`` (name -> type name) of a JSON record; no fields unless it is an object."""
    text = trim_blank(F.col(record))
    types = F.transform_values(fields_of(F.col("_value")), lambda _, v: kind_of(v))
    read = records.withColumn("_pair", strict_pair(text)).withColumn("_value", strict_value(F.col("_pair"), text))
    return pinned(read, _fields=F.coalesce(types, F.create_map().cast("map<string,string>"))).drop("_pair", "_value")


def record_missing_fields(records: DataFrame, key: str, record: str, required: Sequence[str]) -> DataFrame:
    """As :func:`missing_fields` with each JSON record as its own data set; no shuffle."""
    wanted = F.transform(_names(required), lambda f, i: F.struct(i.cast("long").alias("ordinal"), f.alias("field")))
    lacking = F.filter(wanted, lambda w: ~F.map_contains_key("_fields", w["field"]))
    return with_record_fields(records.select(key, record), record).select(key, F.inline(lacking))


def record_schema_differences(
    records: DataFrame, key: str, record: str, target_schema: Mapping[str, object]
) -> DataFrame:
    """As :func:`schema_differences` with each JSON record as its own data set; no shuffle."""
    expected = _names(list(target_schema))
    names = F.map_keys("_fields")

    def tagged(kind: str, values: Column) -> Column:
        return F.transform(values, lambda f: F.struct(F.lit(kind).alias("kind"), f.alias("field")))

    found = [tagged("missing", F.filter(expected, lambda f: ~F.map_contains_key("_fields", f)))]
    if target_schema:
        found.append(tagged("extra", F.array_except(names, expected)))
    return with_record_fields(records.select(key, record), record).select(key, F.inline(F.concat(*found)))


def record_type_mismatches(
    records: DataFrame, key: str, record: str, target_schema: Mapping[str, str]
) -> DataFrame:
    """As :func:`type_mismatches` with each JSON record as its own data set; no shuffle."""
    wanted = F.array(
        *[F.struct(F.lit(f).alias("field"), F.lit(t).alias("expected")) for f, t in target_schema.items()]
    )
    seen = F.transform(
        wanted,
        lambda w: F.struct(w["field"].alias("field"), w["expected"].alias("expected"),
                           F.col("_fields")[w["field"]].alias("observed")),
    )
    wrong = F.filter(seen, lambda s: s["observed"].isNotNull() & ~_type_matches(s["expected"], s["observed"]))
    return with_record_fields(records.select(key, record), record).select(key, F.inline(wrong))


# ---------------------------------------------------------------- rows


def check_row_count(
    df: DataFrame, minimum: int = 1, maximum: int | None = None, group_by: Sequence[str] = ()
) -> DataFrame:
    """Row count against bounds, for the whole data set or per group; map-side counts."""
    counted = df.groupBy(*group_by).agg(F.count(F.lit(1)).alias("row_count"))
    top = F.lit(maximum).cast("long")
    return counted.select(
        *group_by,
        "row_count",
        F.lit(minimum).cast("long").alias("minimum"),
        top.alias("maximum"),
        ((F.col("row_count") >= minimum) & (top.isNull() | (F.col("row_count") <= top))).alias("passed"),
    )


def check_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count.

    Copies are counted map-side first, so a key with a third of all rows
    reaches the shuffle as one row per task. Two NULLs are a duplicate.

    Texts and bytes are counted by their 256-bit digest first; only rows whose digest
    occurs again are then counted by the values themselves, which decide. A frame with
    such keys is read twice and must not change between the reads.
    """
    names = dict(df.dtypes)
    wide = [k for k in keys if names.get(k) in ("string", "binary")]
    if not wide:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    short = [F.unhex(F.sha2(F.col(f"`{k}`"), 256)) if k in wide else F.col(f"`{k}`") for k in keys]
    places = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{k}`") for k in keys], *[c.alias(p) for c, p in zip(short, places)])
    again = (
        df.select(*[c.alias(f"_a{i}") for i, c in enumerate(short)])
        .groupBy(*[f"_a{i}" for i in range(len(keys))])
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
    )
    same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_a{i}")) for i, p in enumerate(places)])
    found = rows.join(again, same, "left_semi")
    return found.groupBy(*[f"`{k}`" for k in keys]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_date_range(
    df: DataFrame,
    date_field: str,
    min_date: str | None = None,
    max_date: str | None = None,
    mode: str = "string",
) -> DataFrame:
    """Rows whose date lies outside inclusive bounds, with ``value`` and ``side``.

    ``mode="string"`` compares ISO text: a midnight time stamp on the upper day
    is above it. ``mode="date"`` compares calendar days. A NULL date and an
    empty bound are ignored.
    """
    if mode not in ("string", "date"):
        raise ValueError("mode must be 'string' or 'date'")
    value = F.col(f"`{date_field}`").cast("string")
    shown = value if mode == "string" else F.col(f"`{date_field}`").try_cast("date")
    below = (shown < F.lit(min_date).cast(mode)) if min_date else F.lit(False)
    above = (shown > F.lit(max_date).cast(mode)) if max_date else F.lit(False)
    side = F.when(below, "below").when(above, "above")
    return df.withColumn("value", value).withColumn("side", side).filter(F.col("side").isNotNull())


def check_nulls(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row (field, has_null) per field, ordered by name; a column the data set lacks counts as null.

    One aggregation pass for all fields. An empty data set passes.
    """
    fields = sorted(set(fields))
    present = set(df.columns)
    flags = df.agg(
        *[
            F.coalesce(F.bool_or(null_or_empty(f) if f in present else F.lit(True)), F.lit(False)).alias(f"f{i}")
            for i, f in enumerate(fields)
        ]
    )
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"f{i}").alias("has_null")) for i, f in enumerate(fields)]
    return flags.select(F.inline(F.array(*rows)))


def sample_of(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    """Restrict a check to the first ``n`` rows by an explicit order."""
    return df.orderBy(*order_by).limit(n)


# ---------------------------------------------------------------- report


def violations_verdict(violations: DataFrame, dataset: str, check: str) -> DataFrame:
    """One verdict row from a DataFrame of offending rows: passed when there are none."""
    return violations.agg(F.count(F.lit(1)).alias("n_violations")).select(
        F.lit(dataset).alias("dataset"),
        F.lit(check).alias("check"),
        (F.col("n_violations") == 0).alias("passed"),
        F.to_json(F.struct("n_violations")).alias("detail_json"),
    )


def row_count_verdict(counted: DataFrame, dataset: str) -> DataFrame:
    return counted.select(
        F.lit(dataset).alias("dataset"),
        F.lit("row_count").alias("check"),
        "passed",
        F.to_json(F.struct("row_count", "minimum", "maximum"), {"ignoreNullFields": "false"}).alias("detail_json"),
    )


def nulls_verdict(flags: DataFrame, dataset: str) -> DataFrame:
    bad = F.array_sort(F.collect_list(F.when(F.col("has_null"), F.col("field"))))
    return flags.agg(bad.alias("fields_with_nulls")).select(
        F.lit(dataset).alias("dataset"),
        F.lit("nulls").alias("check"),
        (F.size("fields_with_nulls") == 0).alias("passed"),
        F.to_json(F.struct("fields_with_nulls")).alias("detail_json"),
    )


def check_report(*verdicts: DataFrame) -> DataFrame:
    """All verdicts in one table (dataset, check, passed, detail_json)."""
    return reduce(lambda a, b: a.unionByName(b), verdicts)
