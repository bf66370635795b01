"""String, date and hash expressions. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slink.functions import fixed_values as fixed

# A word, a number, a run of punctuation, or white space. Kept to the subset
# that Java and RE2 read alike.
TOKEN_PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def any_pattern(column: Column, patterns: list[str]) -> Column:
    """True where at least one pattern is found. One regex pass over the text."""
    return column.rlike("|".join(f"(?:{p})" for p in patterns))


def count_tokens(column: Column) -> Column:
    """Number of pre-tokens. Approximates a BPE count without a vocabulary."""
    return F.regexp_count(column, F.lit(TOKEN_PATTERN))


def chars_per_token(column: Column) -> Column:
    return F.length(column) / F.nullif(count_tokens(column), F.lit(0))


def is_only_number(column: Column) -> Column:
    return column.rlike(fixed.NUMBER_PATTERN)


def is_long_hex(column: Column) -> Column:
    return (F.length(column) >= fixed.MIN_HEX_LENGTH) & column.rlike(fixed.HEX_PATTERN)


def is_blank(column: Column) -> Column:
    return column.isNull() | (F.regexp_replace(column, r"^\s+|\s+$", "") == "")


def is_empty(column: Column) -> Column:
    return column.isNull() | (column == "")


def effective_sql(user_sql: Column, generated_sql: Column) -> Column:
    return F.coalesce(F.nullif(user_sql, F.lit("")), generated_sql)


def fqn(database: Column, schema: Column, name: Column) -> Column:
    return F.concat_ws(".", database, schema, name)


def unqualified(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def quoted_fqn(name: Column) -> Column:
    return F.regexp_replace(name, r"([^.]+)$", '"$1"')


def prettify_name(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("_"), F.lit(" "))


def quote_if_keyword(name: Column) -> Column:
    return F.when(F.upper(name).isin(fixed.KEYWORDS), F.concat(F.lit('"'), name, F.lit('"'))).otherwise(name)


def content_hash(text: Column, fast: bool = False) -> Column:
    """Key of a text. `fast` gives xxHash64 with Spark's own seed."""
    if fast:
        return F.lower(F.lpad(F.hex(F.xxhash64(text)), 16, "0"))
    return F.sha2(text, 256)


def cache_key(data_source_id: Column, sql: Column) -> Column:
    return F.concat_ws("-", F.lit("query-cache"), data_source_id.cast("string"), content_hash(sql))


def long_date(date: Column) -> Column:
    """`January 28th, 2023`."""
    day = F.dayofmonth(date)
    suffix = (
        F.when((day >= 10) & (day < 20), "th")
        .when(day % 10 == 1, "st")
        .when(day % 10 == 2, "nd")
        .when(day % 10 == 3, "rd")
        .otherwise("th")
    )
    return F.concat(F.date_format(date, "MMMM "), day.cast("string"), suffix, F.date_format(date, ", yyyy"))


def extract_code_block(text: Column) -> Column:
    """Text of the first triple-backtick block, or the input when there is none."""
    pattern = "(?s)```(?:sql)?(.*?)```"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)


def backticks_to_quotes(text: Column) -> Column:
    return F.replace(text, F.lit("`"), F.lit('"'))


def normalise_now(sql: Column) -> Column:
    return F.regexp_replace(sql, r"([\s(])NOW\(\)", "$1CURRENT_TIMESTAMP()")


def ensure_limit_text(sql: Column) -> Column:
    return F.when(sql.rlike(r"\sLIMIT\s"), sql).otherwise(F.concat(sql, F.lit(f" LIMIT {fixed.ROW_CAP}")))


def quoted_literal(value: Column) -> Column:
    """A value as a Python-style string literal, the form hints are shown in."""
    body = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for char, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(char), F.lit(shown))
    double_quoted = value.contains("'") & ~value.contains('"')
    return F.when(double_quoted, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def ordered_unique(values: Column) -> Column:
    """First occurrence of each non-blank item, in order."""
    return F.array_distinct(F.filter(values, lambda v: ~is_blank(v)))


def canonical_cell(column: Column, data_type: str) -> Column:
    """One cell as text. Fractions get ten significant digits; NaN, infinities and NULL stay apart."""
    if data_type in ("double", "float") or data_type.startswith("decimal"):
        number = column.cast("double")
        finite = ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
        shown = F.format_string("%.9e", F.when(finite, number + F.lit(0.0)).otherwise(0.0))
        column = F.when(number.isNull(), None).when(finite, shown).otherwise(F.lower(number.cast("string")))
    elif data_type.startswith("timestamp"):
        column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.coalesce(column.cast("string"), F.lit("None"))


def canonical_row(df, columns: list[str]) -> Column:
    """Cells as sorted text, so neither column names nor their order matter."""
    types = dict(df.dtypes)
    return F.array_sort(F.array(*[canonical_cell(F.col(c), types[c]) for c in columns]))
