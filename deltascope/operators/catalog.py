"""Joins over the catalog: selections, connections, descriptions, schema text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _low(df: DataFrame) -> DataFrame:
    return (df.withColumn("_t", F.lower("table_name")).withColumn("_c", F.lower("column_name"))
            .drop("table_name", "column_name"))


def subselect(selection: DataFrame, catalog: DataFrame) -> DataFrame:
    """Selected columns under their actual names; names match in any case, unknown ones leave."""
    names = catalog.select("table_name", "column_name", F.lower("table_name").alias("_t"),
                           F.lower("column_name").alias("_c"))
    others = [c for c in selection.columns if c not in ("table_name", "column_name")]
    return _low(selection).join(F.broadcast(names), ["_t", "_c"]).select(*others, "table_name", "column_name")


def union_selections(selections: DataFrame, catalog: DataFrame, by: Sequence[str]) -> DataFrame:
    """Union of all selections of a group, actual names, without repeats."""
    return subselect(selections.select(*by, "table_name", "column_name").distinct(), catalog).distinct()


def enrich(selection: DataFrame, info: DataFrame, fields: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Copy metadata fields by name in any case; columns without a match keep the defaults."""
    unknown = set(fields) - set(info.columns)
    if unknown:
        raise ValueError(f"unknown metadata fields: {sorted(unknown)}")
    facts = info.select(F.lower("table_name").alias("_t"), F.lower("column_name").alias("_c"), *fields)
    joined = selection.withColumn("_t", F.lower("table_name")).withColumn("_c", F.lower("column_name")).join(
        F.broadcast(facts), ["_t", "_c"], "left")
    return joined.select(*selection.columns, *[F.coalesce(F.col(f), F.lit(defaults[f])).alias(f) for f in fields])


def connections(selected: DataFrame, catalog: DataFrame, edges: DataFrame) -> DataFrame:
    """Columns that link the selected tables of a query.

    ``selected`` has (query_id, table_name), at most one row per table. A column
    counts if it is a key, refers to or is referred to by a selected table, or
    is named like a key of another selected table. What comes from the schema is
    broadcast; selections, as many as there are queries, are merged.
    """
    chosen = selected.select("query_id", "table_name").distinct()
    other = chosen.select("query_id", F.col("table_name").alias("ref_table"))
    keys = catalog.filter("is_key")
    own = chosen.join(F.broadcast(keys), "table_name").select("query_id", "table_name", "column_name")
    links = edges.select("table_name", "column_name", "ref_table").unionByName(edges.select(
        F.col("ref_table").alias("table_name"), F.col("ref_column").alias("column_name"),
        F.col("table_name").alias("ref_table")))
    linked = chosen.join(F.broadcast(links), "table_name").join(other.hint("merge"), ["query_id", "ref_table"]).select(
        "query_id", "table_name", "column_name")
    key_names = keys.select(F.col("table_name").alias("ref_table"), F.lower("column_name").alias("_c"))
    namesakes = (catalog.select("table_name", "column_name", F.lower("column_name").alias("_c"))
                 .join(F.broadcast(key_names), "_c").filter(F.lower("table_name") != F.lower("ref_table"))
                 .select("table_name", "column_name", "ref_table").distinct())
    named = chosen.join(F.broadcast(namesakes), "table_name").join(other.hint("merge"), ["query_id", "ref_table"]).select(
        "query_id", "table_name", "column_name")
    return own.unionByName(linked).unionByName(named).distinct()


# Marks removed from description texts.
EVIDENCE_MARK = "commonsense evidence:"
NOT_USEFUL = "not useful"


def _tidy(col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"^\s+|\s+$", "")


def _one_line(col: str) -> Column:
    flat = F.replace(F.replace(F.coalesce(F.col(col), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit(EVIDENCE_MARK), F.lit(""))
    return F.regexp_replace(flat, r"^\s+|\s+$", "")


def clean_descriptions(raw: DataFrame, use_value_description: bool = True) -> DataFrame:
    """Column descriptions ready for joins: lower-case names, one-line texts, NULL to ""."""
    value = _one_line("value_description")
    useful = F.when(F.lower(value).startswith(NOT_USEFUL),
                    F.regexp_replace(F.substring(value, len(NOT_USEFUL) + 1, 2147483647), r"^\s+|\s+$", "")).otherwise(value)
    return raw.select(
        F.lower(F.trim("table_name")).alias("table_name"),
        F.lower(F.trim("original_column_name")).alias("column_key"), "original_column_name",
        _tidy("column_name").alias("column_name"),
        _one_line("column_description").alias("column_description"),
        _tidy("data_format").alias("data_format"),
        (useful if use_value_description else F.lit("")).alias("value_description"))


def _ticked(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.concat(F.lit("`"), v, F.lit("`"))), ", ")


# The texts of profiles and schemas below.


def references_text(edges: DataFrame) -> DataFrame:
    """Per column: list texts of what it references and what references it."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        line = F.concat(F.lit("    Table: `"), F.col("t"), F.lit("`, Column: `"), F.col("c"), F.lit("`\n"))
        # bounded by the number of foreign keys in the schema
        return df.groupBy("table_name", "column_name").agg(
            F.array_join(F.sort_array(F.collect_list(line)), "").alias(name))

    out = listed(edges.select("table_name", "column_name", F.col("ref_table").alias("t"), F.col("ref_column").alias("c")),
                 "refers")
    back = listed(edges.select(F.col("ref_table").alias("table_name"), F.col("ref_column").alias("column_name"),
                               F.col("table_name").alias("t"), F.col("column_name").alias("c")), "referred")
    return out.join(back, ["table_name", "column_name"], "full_outer")


def column_profiles(catalog: DataFrame, examples: DataFrame, descriptions: DataFrame, edges: DataFrame,
                    with_keys: bool = False, with_references: bool = False) -> DataFrame:
    """One text profile per column; key columns only ``with_keys``."""
    on = ["table_name", "column_name"]
    joined = (catalog.join(examples, on, "left").join(descriptions, on, "left")
              .join(references_text(edges), on, "left"))
    if not with_keys:
        joined = joined.filter(~F.col("is_key") & F.col("refers").isNull() & F.col("referred").isNull())
    expanded = F.coalesce("expanded_name", F.lit(""))

    def line(head: str, col: Column, tail: str = "\n") -> Column:
        return F.when(F.length(col) > 0, F.concat(F.lit(head), col, F.lit(tail)))

    parts = [
        F.concat(F.lit("Table name: `"), F.col("table_name"), F.lit("`\nOriginal column name: `"),
                 F.col("column_name"), F.lit("`\n")),
        F.when(F.lower(F.trim(expanded)) != F.lower(F.trim("column_name")), line("Expanded column name: `", expanded, "`\n")),
        line("Data type: ", F.col("type")),
        line("Description: ", F.col("column_description")),
        line("Value description: ", F.col("value_description")),
        line("Example of values in the column: ", _ticked(F.col("examples"))),
        F.when(F.col("is_key"), F.lit("This column is a primary key.\n")),
    ]
    if with_references:
        parts += [line("This column references the following columns:\n", F.col("refers"), ""),
                  line("This column is referenced by the following columns:\n", F.col("referred"), "")]
    return joined.select(*on, F.concat_ws("", *parts).alias("profile"))


def column_comment() -> Column:
    """Comment behind a column line, from examples, statistics and descriptions."""
    example = F.when(F.size("examples") > 0, F.concat(F.lit(" Example Values: "), _ticked(F.col("examples"))))
    name = F.when((F.trim("expanded_name") != "") & (F.lower("expanded_name") != F.lower("column_name")),
                  F.concat(F.lit("| Column Name Meaning: "), F.col("expanded_name")))
    about = F.when(F.length("column_description") > 0,
                   F.concat(F.lit("| Column Description: "), F.col("column_description")))
    value = F.when(F.length("value_description") > 0,
                   F.concat(F.lit("| Value Description: "), F.col("value_description")))
    blank = F.lit("")
    described = F.concat(F.coalesce(name, blank), F.lit(" "), F.coalesce(about, blank), F.lit(" "),
                         F.coalesce(value, blank))
    statics = F.coalesce(F.concat(F.lit(" Value Statics: "), F.col("value_statics")), F.lit(""))
    text = F.when(example.isNotNull(), F.concat(F.lit(" --"), example, F.lit(" |"), statics, F.lit(" "), described)
                  ).otherwise(F.concat(F.lit(" --"), described))
    return F.replace(text, F.lit("\n"), F.lit(" "))


def schema_text(columns: DataFrame, edges: DataFrame, include_value_description: bool = True,
                use_fk_constraints: bool = True) -> DataFrame:
    """Schema text per table, in stable column order.

    ``columns`` holds the selected or connecting columns with type, ordinal,
    is_key, examples, value_statics and descriptions; foreign keys are shown,
    each once, when both tables are present. The switches leave out the
    comments behind the columns and the foreign keys.
    """
    comment = column_comment() if include_value_description else F.lit("")
    column_line = F.concat(F.lit("\t"), F.col("column_name"), F.lit(" "), F.col("type"), F.lit(","), comment)
    lines = columns.select("table_name", F.col("ordinal").alias("pos"), column_line.alias("line"))
    key_list = columns.filter("is_key").groupBy("table_name").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column_name"))),
                                 lambda s: s["column_name"]), ", ").alias("keys"))
    key_lines = key_list.select("table_name", F.lit(1_000_000).alias("pos"),
                                F.concat(F.lit("\tPRIMARY KEY ("), F.col("keys"), F.lit("),")).alias("line"))
    present = columns.select("table_name").distinct()
    fk = (edges.filter(F.lit(use_fk_constraints)).distinct().join(present, "table_name")
          .join(present.select(F.col("table_name").alias("ref_table")), "ref_table"))
    fk_lines = fk.select("table_name", F.lit(1_000_001).alias("pos"), F.concat(
        F.lit("\tFOREIGN KEY ("), F.col("column_name"), F.lit(") REFERENCES "), F.col("ref_table"),
        F.lit(" ("), F.col("ref_column"), F.lit("),")).alias("line"))
    every = lines.unionByName(key_lines).unionByName(fk_lines)
    # bounded by the number of columns and keys of a table
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n")
    return every.groupBy("table_name").agg(body.alias("body")).select(
        "table_name", F.concat(F.lit("CREATE TABLE "), F.col("table_name"), F.lit("\n(\n"), F.col("body"),
                               F.lit("\n);")).alias("schema_text"))
