"""Tool catalog and argument contracts.

The catalog is a handful of rows that live in this file, so joining it always
broadcasts a relation of known size. A caller's own catalog is joined without
a hint: Spark broadcasts it only while it is below its size threshold.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestlens.functions.staging import pinned
from harvestlens.functions.variants import fields_of, is_object, kind_of

ARGUMENT_COLUMNS = ("argument", "type", "nullable", "item_type", "required", "minimum", "default_value")
CATALOG_COLUMNS = ("name", "category", "description", "enabled", "implemented", "additional_allowed", "contract")


# Types of JSON values a contract may name.
JSON_TYPES = ("string", "integer", "number", "boolean", "array", "object", "null")


def argument(name, type_="string", *, required=False, nullable=False, items=None, minimum=None, default=None):
    """One argument of a contract, as a row of :data:`ARGUMENT_COLUMNS`.

    ``type_`` and ``items`` are JSON types, or several joined by ``|`` of which one must
    fit; an unknown one is an error here, not a violation of every call.
    """
    for kind in [*type_.split("|"), *(items or "").split("|")]:
        if kind and kind not in JSON_TYPES:
            raise ValueError(f"unknown type {kind!r} of argument {name!r}")
    return (name, type_, nullable, items, required, minimum, default)


# Callable tools and what they accept. Fixed values.
TOOLS = [
    ("http_download", "http", "Fetch a URL with GET and keep the body as a raw artifact.", [
        argument("url", required=True),
        argument("source_id", required=True),
        argument("filename", required=True),
        argument("timeout", "integer", minimum=1.0, default="60"),
    ]),
    ("inspect_file", "file", "Size, extension, media type and sheet names of a file.", [
        argument("path", required=True),
    ]),
    ("read_csv", "file", "Shape, columns, types and a sample of a CSV file.", [
        argument("path", required=True),
        argument("sample_rows", "integer", minimum=1.0, default="5"),
    ]),
    ("read_excel", "file", "Shape, columns, types and a sample of one workbook sheet.", [
        argument("path", required=True),
        argument("sheet_name", nullable=True),
        argument("sample_rows", "integer", minimum=1.0, default="5"),
    ]),
    ("read_pdf", "file", "Page count and text samples of the first pages.", [
        argument("path", required=True),
        argument("max_pages", "integer", minimum=1.0, default="3"),
    ]),
    ("extract_pdf_table", "file", "Tables found on one page.", [
        argument("path", required=True),
        argument("page_number", "integer", minimum=1.0, default="1"),
    ]),
    ("validate_required_fields", "validation", "Are all required columns there?", [
        argument("columns", "array", items="string", required=True),
        argument("required_fields", "array", items="string", required=True),
    ]),
    ("validate_row_count", "validation", "Is a row count within bounds?", [
        argument("row_count", "integer", required=True),
        argument("minimum", "integer", default="1"),
        argument("maximum", "integer", nullable=True),
    ]),
    ("browser_open", "browser", "Open a page.", [
        argument("url", required=True),
        argument("timeout", "integer", minimum=1.0, default="30"),
    ]),
    ("browser_inspect", "browser", "Inspect the open page.", []),
    ("browser_close", "browser", "Close the open page.", []),
]

# Tools that are known but switched off and have no implementation. Fixed values.
SWITCHED_OFF = {
    "browser": ["browser_click", "browser_fill", "browser_select", "browser_wait", "browser_download",
                "browser_back"],
    "query": ["sparql_query", "api_get"],
    "email": ["email_search", "email_read", "email_get_attachment", "email_download_link"],
}


def tool_catalog(spark: SparkSession) -> DataFrame:
    """All tools, one row each, the contract as an array of arguments."""
    rows = [(name, cat, text, True, True, False, contract) for name, cat, text, contract in TOOLS]
    rows += [
        (name, cat, "Not available.", False, False, True, [])
        for cat, names in SWITCHED_OFF.items()
        for name in names
    ]
    return catalog_of(spark, rows)


def catalog_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A catalog from rows of :data:`CATALOG_COLUMNS`.

    It goes through Arrow and so becomes a local relation whose size Spark knows.
    """
    records = [
        {**dict(zip(CATALOG_COLUMNS, row)), "contract": [dict(zip(ARGUMENT_COLUMNS, a)) for a in row[-1]]}
        for row in rows
    ]
    text, flag = pa.string(), pa.bool_()
    argument_type = pa.struct(
        [("argument", text), ("type", text), ("nullable", flag), ("item_type", text), ("required", flag),
         ("minimum", pa.float64()), ("default_value", text)]
    )
    schema = pa.schema(
        [("name", text), ("category", text), ("description", text), ("enabled", flag), ("implemented", flag),
         ("additional_allowed", flag), ("contract", pa.list_(argument_type))]
    )
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=schema))


def tool_arguments(catalog: DataFrame) -> DataFrame:
    """One row per declared argument."""
    return catalog.select("name", F.inline("contract"))


def _lookup(calls: DataFrame, catalog: DataFrame, how: str) -> DataFrame:
    return calls.join(catalog, calls["action"] == catalog["name"], how)


def tool_lookup(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add category, enabled flag and ``error_type`` (``ToolNotFoundError``) by exact tool name."""
    found = catalog.select("name", "category", "enabled")
    return (
        _lookup(calls, found, "left")
        .withColumn("error_type", F.when(F.col("name").isNull(), "ToolNotFoundError"))
        .withColumn(
            "message",
            F.when(F.col("name").isNull(), F.concat(F.lit("Unknown tool: '"), F.col("action"), F.lit("'"))),
        )
        .drop("name")
    )


def unknown_tools(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Calls whose tool is not in the catalog."""
    return _lookup(calls, catalog.select("name"), "left_anti")


def _whole(kind: Column, number: Column) -> Column:
    """JSON Schema integers: 5 and 5.0, but neither 5.5 nor true."""
    return (kind == "BIGINT") | (_is_number(kind) & F.coalesce(number == F.floor(number), F.lit(False)))


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _fits(declared: Column, kind: Column, number: Column) -> Column:
    """Whether a value of the type ``kind`` is of one of the declared types."""

    def one(type_: Column) -> Column:
        return (
            F.when(type_ == "string", kind == "STRING")
            .when(type_ == "integer", _whole(kind, number))
            .when(type_ == "number", _is_number(kind))
            .when(type_ == "boolean", kind == "BOOLEAN")
            .when(type_ == "array", kind.startswith("ARRAY"))
            .when(type_ == "object", kind.startswith("OBJECT"))
            .when(type_ == "null", kind == "VOID")
            .otherwise(False)
        )

    return F.exists(F.split(declared, "[|]"), one)


def _judged(a: Column) -> Column:
    """Violation of one given argument, NULL when it fits. ``a`` is a row of :func:`_given`."""
    spec, kind, number = a["spec"], a["kind"], a["number"]
    fits = ((kind == "VOID") & spec["nullable"]) | _fits(spec["type"], kind, number)
    strays = F.exists(
        F.try_variant_get(a["value"], "$", "array<variant>"),
        lambda item: ~_fits(spec["item_type"], kind_of(item), F.try_variant_get(item, "$", "double")),
    )
    stray_item = spec["item_type"].isNotNull() & kind.startswith("ARRAY") & strays
    # The type is judged before the minimum: a boolean would pass as a number.
    return (
        F.when(~fits, "wrong_type")
        .when(stray_item, "wrong_item_type")
        .when(_is_number(kind) & (number < spec["minimum"]), "below_minimum")
    )


def _given(members: Column, contract: Column) -> Column:
    """Declared arguments that were given, each with its value, type name and number."""
    named = F.filter(contract, lambda a: F.map_contains_key(members, a["argument"]))
    valued = F.transform(named, lambda a: F.struct(a.alias("spec"), members[a["argument"]].alias("value")))
    return F.transform(
        valued,
        lambda a: F.struct(
            a["spec"].alias("spec"),
            a["value"].alias("value"),
            kind_of(a["value"]).alias("kind"),
            F.try_variant_get(a["value"], "$", "double").alias("number"),
        ),
    )


def violations_of(members: Column, contract: Column, additional_allowed: Column) -> Column:
    """ARRAY<STRUCT<violation, argument>> of one call; all in array expressions, no explode, no shuffle."""

    def row(kind: Column, name: Column) -> Column:
        return F.struct(kind.alias("violation"), name.alias("argument"))

    required = F.transform(F.filter(contract, lambda a: a["required"]), lambda a: a["argument"])
    missing = F.array_except(required, F.map_keys(members))
    declared = F.transform(contract, lambda a: a["argument"])
    unexpected = F.when(
        ~additional_allowed, F.array_except(F.map_keys(members), declared)
    ).otherwise(F.array().cast("array<string>"))
    judged = F.transform(_given(members, contract), lambda a: row(_judged(a), a["spec"]["argument"]))
    return F.concat(
        F.transform(missing, lambda name: row(F.lit("missing"), name)),
        F.transform(unexpected, lambda name: row(F.lit("unexpected"), name)),
        F.filter(judged, lambda v: v["violation"].isNotNull()),
    )


def with_violations(calls: DataFrame, catalog: DataFrame, how: str = "left") -> DataFrame:
    """Join calls (``action``, ``arguments`` VARIANT) with their tool and add ``violations``."""
    spec = catalog.select("name", "category", "enabled", "implemented", "additional_allowed", "contract")
    not_object = F.array(F.struct(F.lit("not_object").alias("violation"),
                                  F.lit(None).cast("string").alias("argument")))
    found = _lookup(calls, spec, how).withColumn("_members", fields_of(F.col("arguments")))
    violations = (
        F.when(F.col("name").isNull(), F.lit(None))
        .when(~is_object(F.col("arguments")), not_object)
        .otherwise(violations_of(F.col("_members"), F.col("contract"), F.col("additional_allowed")))
    )
    return pinned(found, violations=violations).drop("_members", "contract", "additional_allowed")


def check_arguments(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per contract violation of a call to a known tool: the call's columns, violation, argument."""
    checked = with_violations(calls, catalog, "inner")
    return checked.select(*calls.columns, F.inline("violations"))
