"""Packing against a plain walk over the ranking."""

import random
import re

import pytest

from slink.functions import fixed_values as fixed
from slink.operators import packing

TOKEN = re.compile(r" ?[^\W\d_]+| ?\d+| ?[^\s\w]+| ?_+|\s+")


def tokens(s):
    return len(TOKEN.findall(s))


COLUMNS = [
    (0, "DB.S.ORDERS", 0, 0, "ID", "NUMBER(38,0)"),
    (0, "DB.S.ORDERS", 1, 1, "STATUS", "VARCHAR(20)"),
    (0, "DB.S.ORDERS", 2, 2, "DATA", "VARIANT"),
    (0, "DB.S.ORDERS", 3, 3, "CREATED_AT", "TIMESTAMP_TZ(9)"),
    (1, "DB.S.ITEMS", 100, 0, "NAME", "VARCHAR(9)"),
    (1, "DB.S.ITEMS", 101, 1, "ORDER_ID", "NUMBER(38,0)"),
    (2, "DB.S.EMPTY", 200, 0, "BLOB", "VARIANT"),
]
SHOWN = {"NUMBER(38,0)": "integer", "VARCHAR(20)": "varchar", "VARCHAR(9)": "varchar", "VARIANT": None, "TIMESTAMP_TZ(9)": "timestamp"}


def line(column_id, hints=()):
    _, _, _, _, name, kind = next(c for c in COLUMNS if c[2] == column_id)
    if SHOWN[kind] is None:
        return None
    shown = [h for h in hints if h.strip()][: fixed.HINTS_RENDERED]
    return f" {name.lower()} {SHOWN[kind]}," + (" -- possible values include: " + ", ".join(map(repr, shown)) if shown else "")


def walk(ranking, budget):
    used, order, shown = 0, [], {}

    def add(table, column, value):
        nonlocal used
        columns = shown[table]
        if column not in columns:
            columns[column] = []
            used += tokens(line(column)) + 1 if line(column) else 0
        hints = columns[column]
        if value and value not in hints and len(hints) < fixed.HINTS_STORED:
            used += tokens(f", {value!r}" if hints else f" -- possible values include: {value!r}")
            hints.append(value)

    for table, column, value in ranking:
        if used > budget:
            break
        if table not in shown:
            shown[table] = {}
            order.insert(0, table)
            for c in COLUMNS:
                if c[0] == table and re.search(fixed.DEFAULT_COLUMN_PATTERN, c[4]):
                    add(table, c[2], None)
            name = next(c[1] for c in COLUMNS if c[0] == table).split(".")[-1].lower()
            used += tokens(f"CREATE TABLE {name} (\n \n);\n")
        if column is not None:
            add(table, column, value)
    ddl = []
    for table in order:
        name = next(c[1] for c in COLUMNS if c[0] == table).split(".")[-1].lower()
        lines = [x for x in (line(c, h) for c, h in shown[table].items()) if x]
        ddl.append(f"CREATE TABLE {name} (\n" + "\n".join(lines) + "\n);\n")
    return used, "\n".join(ddl)


@pytest.mark.parametrize("budget", [0, 10, 40, 90, 10_000])
def test_pack_equals_a_walk(spark, budget):
    rng = random.Random(budget)
    elements = [(t, None, None) for t in (0, 1, 2)] + [(c[0], c[2], None) for c in COLUMNS]
    elements += [(0, 1, v) for v in ("paid", "open", "it's", " ", "", "x1", "x2", "x3", "x4")] + [(1, 100, "ring"), (0, 0, "7"), (0, 2, "j")]
    rows, want = [], {}
    for question in range(25):
        ranking = rng.sample(elements, len(elements)) + rng.sample(elements, 5)
        rows += [(question, t, c, v, r) for r, (t, c, v) in enumerate(ranking, 1)]
        want[question] = walk(ranking, budget)
    ranked = spark.createDataFrame(rows, "question_id long, table_id int, column_id int, value string, rank int")
    columns = spark.createDataFrame(COLUMNS, "table_id int, fqn string, column_id int, ordinal int, column_name string, type string")
    got = {r.question_id: (r.tokens, r.schema_ddl) for r in packing.pack_schema(ranked, columns, budget).collect()}
    assert got == want


def test_unknown_table_is_an_error(spark):
    ranked = spark.createDataFrame([(1, 99, None, None, 1)], "question_id long, table_id int, column_id int, value string, rank int")
    columns = spark.createDataFrame(COLUMNS, "table_id int, fqn string, column_id int, ordinal int, column_name string, type string")
    with pytest.raises(Exception, match="not in the catalogue"):
        packing.pack_schema(ranked, columns, 10).collect()
