"""Rendering of types, columns and tables as DDL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slink.functions import fixed_values as fixed
from slink.functions.text import ordered_unique, quoted_literal, unqualified


def render_type(type_name: Column, dialect: str = "postgres") -> Column:
    """Warehouse type as shown in a prompt; NULL where the column is dropped."""
    if dialect == "postgres":
        text_type = "VARCHAR"
        number = F.replace(F.replace(type_name, F.lit("NUMBER(38,0)"), F.lit("INTEGER")), F.lit("NUMBER"), F.lit("NUMERIC"))
    elif dialect == "snowflake":
        text_type = "TEXT"
        number = F.replace(type_name, F.lit("NUMBER(38,0)"), F.lit("NUMBER"))
    else:
        text_type = "TEXT"
        number = type_name
    shown = (
        F.when(type_name.startswith("VARCHAR"), F.lit(text_type))
        .when(type_name.rlike("^TIMESTAMP_N?TZ"), F.lit("TIMESTAMP"))
        .when(type_name.startswith("VARIANT"), F.lit(None))
        .when(type_name.startswith("NUMBER"), number)
        .otherwise(type_name)
    )
    return F.lower(shown)


def hint_list(hints: Column) -> Column:
    """Up to five distinct non-blank hints, quoted and comma-joined; NULL when none."""
    shown = F.slice(ordered_unique(hints), 1, fixed.HINTS_RENDERED)
    return F.when(F.size(shown) > 0, F.array_join(F.transform(shown, quoted_literal), ", "))


def column_line(name: Column, rendered_type: Column, hints: Column | None = None) -> Column:
    """` name type, -- possible values include: 'a', 'b'`; NULL for a dropped column."""
    line = F.concat(F.lit(" "), F.lower(name), F.lit(" "), rendered_type, F.lit(","))
    if hints is None:
        return line
    listed = hint_list(hints)
    return F.concat(line, F.when(listed.isNotNull(), F.concat(F.lit(" -- possible values include: "), listed)).otherwise(""))


def table_header(fqn: Column) -> Column:
    return F.concat(F.lit("CREATE TABLE "), F.lower(unqualified(fqn)), F.lit(" (\n \n);\n"))


def table_ddl(fqn: Column, lines: Column) -> Column:
    return F.concat(
        F.lit("CREATE TABLE "), F.lower(unqualified(fqn)), F.lit(" (\n"), F.array_join(lines, "\n"), F.lit("\n);\n")
    )


def hint_cost_text(value: Column, hint_number: Column) -> Column:
    """Text whose tokens a new hint costs; NULL past the stored limit."""
    literal = quoted_literal(value)
    return F.when(hint_number == 1, F.concat(F.lit(" -- possible values include: "), literal)).when(
        hint_number <= fixed.HINTS_STORED, F.concat(F.lit(", "), literal)
    )
