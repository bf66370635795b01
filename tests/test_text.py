import datetime

import pytest
from pyspark.sql import functions as F

from slink.functions import render, text
from slink.operators import values


def one(spark, column, **cells):
    """Value of a column expression on one row of typed cells."""
    row = [tuple(cells.values())]
    schema = ", ".join(f"{k} {'date' if isinstance(v, datetime.date) else 'string' if not isinstance(v, list) else 'array<string>'}" for k, v in cells.items())
    return spark.createDataFrame(row, schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "reason"),
    [
        (None, "blank"),
        ("", "blank"),
        (" ", "few_chars_per_token"),
        ("-1.5", "only_number"),
        ("1.", "only_number"),
        (".5", "only_number"),
        ("+7", "only_number"),
        ("1.2.3", "few_chars_per_token"),
        ("7\n", "few_chars_per_token"),
        ("a" * 20, "long_hex"),
        ("#" + "0f" * 10, "long_hex"),
        ("a" * 19, None),
        ("hello", None),
        ("word " * 20, None),
        ("word " * 20 + "x", "long_for_index"),
        ("word " * 119 + "abcd", "long_for_index"),
        ("word " * 120, "too_long"),
        ("a1b2c3", "few_chars_per_token"),
    ],
)
def test_drop_reasons(spark, value, reason):
    assert one(spark, values.drop_reason(F.col("v")), v=value) == reason


@pytest.mark.parametrize(
    ("day", "shown"),
    [(1, "1st"), (2, "2nd"), (3, "3rd"), (4, "4th"), (11, "11th"), (12, "12th"), (13, "13th"), (21, "21st"), (22, "22nd"), (23, "23rd"), (31, "31st")],
)
def test_long_date(spark, day, shown):
    assert one(spark, text.long_date(F.col("d")), d=datetime.date(2023, 1, day)) == f"January {shown}, 2023"


def test_names(spark):
    assert one(spark, text.unqualified(F.col("n")), n="DB.PUBLIC.ORDER") == "ORDER"
    assert one(spark, text.quoted_fqn(F.col("n")), n="DB.PUBLIC.ORDER") == 'DB.PUBLIC."ORDER"'
    assert one(spark, text.quoted_fqn(F.col("n")), n="ORDER") == '"ORDER"'
    assert one(spark, text.quote_if_keyword(F.col("n")), n="order") == '"order"'
    assert one(spark, text.quote_if_keyword(F.col("n")), n="orders") == "orders"
    assert one(spark, text.prettify_name(F.col("n")), n="CREATED_AT") == "created at"


def test_sql_texts(spark):
    assert one(spark, text.ensure_limit_text(F.col("s")), s="SELECT 1") == "SELECT 1 LIMIT 100"
    assert one(spark, text.ensure_limit_text(F.col("s")), s="SELECT 1\nLIMIT 5") == "SELECT 1\nLIMIT 5"
    assert one(spark, text.ensure_limit_text(F.col("s")), s="SELECT 1 limit 5") == "SELECT 1 limit 5 LIMIT 100"
    assert one(spark, text.normalise_now(F.col("s")), s="x > NOW() AND f(NOW()) AND xNOW()") == (
        "x > CURRENT_TIMESTAMP() AND f(CURRENT_TIMESTAMP()) AND xNOW()"
    )
    assert one(spark, text.extract_code_block(F.col("s")), s="a ```sql\nSELECT 1``` b ```2```") == "\nSELECT 1"
    assert one(spark, text.extract_code_block(F.col("s")), s="``` ```") == " "
    assert one(spark, text.extract_code_block(F.col("s")), s="SELECT 1") == "SELECT 1"
    assert one(spark, text.backticks_to_quotes(F.col("s")), s="`a`") == '"a"'
    assert one(spark, text.effective_sql(F.col("u"), F.col("s")), u="", s="b") == "b"
    assert one(spark, text.effective_sql(F.col("u"), F.col("s")), u="a", s="b") == "a"


@pytest.mark.parametrize("value", ["plain", "it's", 'say "x"', "it's \"x\"", "a\\b", "a\nb\tc"])
def test_quoted_literal_is_python_repr(spark, value):
    assert one(spark, text.quoted_literal(F.col("v")), v=value) == repr(value)


def test_ordered_unique_keeps_case_and_first_place(spark):
    assert one(spark, text.ordered_unique(F.col("v")), v=["b", None, "a", " ", "b", "B", ""]) == ["b", "a", "B"]


@pytest.mark.parametrize(
    ("warehouse", "postgres", "snowflake"),
    [
        ("VARCHAR(255)", "varchar", "text"),
        ("NUMBER(38,0)", "integer", "number"),
        ("NUMBER(10,2)", "numeric(10,2)", "number(10,2)"),
        ("TIMESTAMP_TZ(9)", "timestamp", "timestamp"),
        ("TIMESTAMP_NTZ(9)", "timestamp", "timestamp"),
        ("TIMESTAMP_LTZ(9)", "timestamp_ltz(9)", "timestamp_ltz(9)"),
        ("VARIANT", None, None),
        ("BOOLEAN", "boolean", "boolean"),
    ],
)
def test_render_type(spark, warehouse, postgres, snowflake):
    assert one(spark, render.render_type(F.col("t"), "postgres"), t=warehouse) == postgres
    assert one(spark, render.render_type(F.col("t"), "snowflake"), t=warehouse) == snowflake


def test_column_line_shows_five_hints(spark):
    line = render.column_line(F.lit("STATUS"), F.lit("varchar"), F.col("h"))
    assert one(spark, line, h=["a", "", "b", "a", "c", "d", "e", "f"]) == (
        " status varchar, -- possible values include: 'a', 'b', 'c', 'd', 'e'"
    )
    assert one(spark, line, h=[""]) == " status varchar,"
