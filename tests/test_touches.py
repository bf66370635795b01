"""Expected touch counts of small queries, written as structured logs."""

import pytest

from slink.operators import touches

SCHEMA = """query_id long, tables array<struct<name:string,alias:string,path:array<int>>>,
columns array<struct<qualifier:string,name:string,times:int,path:array<int>>>, stars array<struct<qualifier:string,path:array<int>>>,
eq array<struct<qualifier:string,name:string,value:string,path:array<int>>>,
in_items array<struct<qualifier:string,name:string,value:string,quoted_identifier:boolean,path:array<int>>>"""


def catalog(spark, tables):
    rows = [(i, t.upper(), f"DB.{t.upper()}", i * 100 + o, o, c.upper(), "VARCHAR") for i, (t, cs) in enumerate(tables.items()) for o, c in enumerate(cs)]
    return spark.createDataFrame(rows, "table_id int, table_name string, fqn string, column_id int, ordinal int, column_name string, type string")


def counts(spark, schema, tables, columns=(), stars=(), eq=(), in_items=()):
    def placed(entries):
        """Entries end in their path, or in the depth of a nest of single subqueries."""
        return [(*e[:-1], [1] * e[-1] if isinstance(e[-1], int) else list(e[-1])) for e in entries]

    tables = [(*t, 0) if len(t) == 2 else t for t in tables]
    row = (1, *(placed(entries) for entries in (tables, columns, stars, eq, in_items)))
    log = spark.createDataFrame([row], SCHEMA)
    found = touches.touch_counts(log, catalog(spark, schema)).collect()
    return {(r.table_name, r.column_name, r.value): r.touches for r in found}


TWO = {"table1": ["col1", "col2"], "table2": ["col2", "col3"]}
SHOP = {"orders": ["o_id", "o_day", "note"], "items": ["i_order", "i_part", "note"], "parts": ["p_id", "p_kind"]}


def refs(*names):
    """References of the outermost query, each once; `a.b` is b with the qualifier a, and `x3` in a pair its times."""
    found = []
    for name in names:
        name, times = name if isinstance(name, tuple) else (name, 1)
        qualifier, _, column = name.rpartition(".")
        found.append((qualifier or None, column, times, 0))
    return found


# (tables, references, stars, equalities, IN items, what is touched besides each table once)
CASES = {
    "names tell the table": (["orders", "parts"], refs("o_id", ("p_kind", 2)), [], [], [], {"orders.o_id": 1, "parts.p_kind": 2}),
    "aliases of aliases count": (["orders", "items"], refs(("o_day", 5)), [], [], [], {"orders.o_day": 5}),
    "star of two tables": (
        ["orders", "items"], [], [None], [], [],
        {"orders.o_id": 1, "orders.o_day": 1, "items.i_order": 1, "items.i_part": 1, "items.note": 1},
    ),
    "star of one of them": (["orders", "items"], [], ["orders"], [], [], {"orders.o_id": 1, "orders.o_day": 1, "orders.note": 1}),
    "a table alone": (["parts"], [], [], [], [], {}),
    "IN with names": (["parts"], refs("p_kind"), [], [], [("p_kind", "ring", True), ("p_kind", "bolt", True)], {"parts.p_kind": 1, "parts.p_kind=ring": 1, "parts.p_kind=bolt": 1}),
    "IN with literals": (["parts"], refs("p_kind"), [], [], [("p_kind", "ring", False)], {"parts.p_kind": 1}),
    "star and a column": (["parts"], refs("p_id"), [None], [], [], {"parts.p_id": 2, "parts.p_kind": 1}),
    "equality": (["orders"], refs(("note", 3)), [], [("note", "late")], [], {"orders.note": 3, "orders.note=late": 1}),
    "join by alias": (["orders o", "items i"], refs("o.o_id", "i.i_order", "o.note", "i.note", "o.o_id"), [], [], [], {"orders.o_id": 2, "items.i_order": 1, "orders.note": 1, "items.note": 1}),
}


@pytest.mark.parametrize("case", CASES)
def test_touches_of_one_query(spark, case):
    tables, columns, stars, eq, in_items, expected = CASES[case]
    named = [tuple((t.split() + [None])[:2]) for t in tables]
    got = counts(
        spark, SHOP, named, columns, [(s, 0) for s in stars], [(None, *e, 0) for e in eq], [(None, *i, 0) for i in in_items]
    )
    want = {(t, None, None): 1 for t, _ in named}
    for key, n in expected.items():
        element, _, value = key.partition("=")
        want[(*element.split("."), value or None)] = n
    assert got == want


def test_unqualified_prefers_last_table_then_outer_scope(spark):
    schema = {"outer_t": ["k", "a"], "inner_t": ["k", "b"], "last_t": ["k"]}
    got = counts(spark, schema, [("outer_t", None, 0), ("inner_t", None, 1), ("last_t", None, 1)], [(None, "k", 1, 1), (None, "a", 1, 1), (None, "k", 1, 0)])
    assert got[("last_t", "k", None)] == 1 and got[("outer_t", "a", None)] == 1 and got[("outer_t", "k", None)] == 1


def test_own_name_is_hidden_by_an_alias(spark):
    log = spark.createDataFrame([(1, [("table1", "t1", [])], [("table1", "col1", 1, [])], [], [], [])], SCHEMA)
    columns = catalog(spark, TWO)
    assert [tuple(r) for r in touches.unresolved_references(log, columns).collect()] == [(1, "table1", "col1")]
    with pytest.raises(Exception, match="unresolved column table1.col1"):
        touches.column_touches(log, columns, strict=True).collect()


def test_siblings_do_not_see_each_other(spark):
    """EXISTS (SELECT x FROM a) AND EXISTS (SELECT x FROM b)."""
    tables = [("outer_t", None, ()), ("a", None, (1,)), ("b", None, (2,)), ("c", None, (1, 1))]
    schema = {"outer_t": ["o"], "a": ["x"], "b": ["x", "only_b"], "c": ["y"]}
    got = counts(spark, schema, tables, [(None, "x", 1, (1,)), (None, "x", 1, (2,)), (None, "x", 1, (1, 1)), (None, "o", 1, (1, 1))])
    assert got[("a", "x", None)] == 2 and got[("b", "x", None)] == 1 and got[("outer_t", "o", None)] == 1
    log = spark.createDataFrame([(1, [("a", None, [1]), ("b", None, [2])], [(None, "only_b", 1, [1])], [], [], [])], SCHEMA)
    assert touches.unresolved_references(log, catalog(spark, schema)).count() == 1


def test_references_of_a_query_without_tables_are_unresolved(spark):
    log = spark.createDataFrame([(1, [], [(None, "col1", 1, [])], [], [], [])], SCHEMA)
    columns = catalog(spark, TWO)
    assert [tuple(r) for r in touches.unresolved_references(log, columns).collect()] == [(1, None, "col1")]
    with pytest.raises(Exception, match="unresolved column col1"):
        touches.column_touches(log, columns, strict=True).collect()


def test_many_tables_keep_their_order(spark):
    """Positions beyond any packing of bits."""
    wide = [("outer_t", None, [])] * 70_000 + [("last_t", None, [])]
    log = spark.createDataFrame([(1, wide, [(None, "k", 1, [])], [], [], [])], SCHEMA)
    found = touches.column_touches(log, catalog(spark, {"outer_t": ["k"], "last_t": ["k"]})).collect()
    assert [(r.table_name, r.touches) for r in found] == [("last_t", 1)]


def test_strict_errors_survive_pruning(spark):
    columns = catalog(spark, TWO)
    elements = spark.createDataFrame([("nope", None, None)], "table_name string, column_name string, value string")
    with pytest.raises(Exception, match="not in the catalogue"):
        touches.resolve_element_ids(elements, columns, strict=True).select("table_name").collect()


DERIVED = SCHEMA + ", derived array<struct<alias:string,name:string,qualifier:string,column:string,path:array<int>,inner:array<int>>>"


def derived_log(spark, alias, columns, outputs, tables=(("table2", None, [1]),)):
    derived = [(alias, name, None, column, [], [1]) for name, column in outputs]
    return spark.createDataFrame([(1, list(tables), columns, [], [], [], derived)], DERIVED)


@pytest.mark.parametrize("alias", [None, "t1"])
def test_columns_of_a_derived_table_touch_their_source(spark, alias):
    """SELECT col1, [t1.]c3 FROM (SELECT col1, col3 AS c3 FROM table2) [AS t1]."""
    columns = [(None, "col1", 1, []), (alias, "c3", 1, []), (None, "col1", 1, [1]), (None, "col3", 2, [1])]
    log = derived_log(spark, alias, columns, [("col1", "col1"), ("c3", "col3")])
    catalog_ = catalog(spark, {"table1": ["col1", "col2"], "table2": ["col1", "col3"]})
    found = {(r.table_name, r.column_name): r.touches for r in touches.touch_counts(log, catalog_).collect()}
    assert found == {("table2", None): 1, ("table2", "col1"): 2, ("table2", "col3"): 3}


@pytest.mark.parametrize("reference", [("table2", "col3", 1, []), ("t1", "col3", 1, [])])
def test_what_a_derived_table_does_not_show_is_unresolved(spark, reference):
    log = derived_log(spark, "t1", [(None, "col1", 1, []), reference], [("col1", "col1")])
    catalog_ = catalog(spark, {"table2": ["col1", "col3"]})
    assert [r.column_name for r in touches.unresolved_references(log, catalog_).collect()] == ["col3"]
    with pytest.raises(Exception, match="unresolved column"):
        touches.column_touches(log, catalog_, strict=True).collect()


def test_derived_tables_inside_one_another(spark):
    """SELECT a FROM (SELECT b AS a FROM (SELECT col1 AS b FROM table2) AS u) AS t."""
    derived = [("t", "a", None, "b", [], [1]), ("u", "b", None, "col1", [1], [1, 1])]
    columns = [("t", "a", 1, []), ("u", "b", 1, [1]), (None, "col1", 1, [1, 1])]
    log = spark.createDataFrame([(1, [("table2", None, [1, 1])], columns, [], [], [], derived)], DERIVED)
    found = touches.column_touches(log, catalog(spark, {"table2": ["col1", "b"]}), strict=True).collect()
    assert [(r.table_name, r.column_name, r.touches) for r in found] == [("table2", "col1", 3)]


@pytest.mark.parametrize("levels", [1, 10, 23])
def test_derived_tables_are_followed_to_the_end(spark, levels):
    """SELECT d0.c0 FROM (SELECT c1 AS c0 FROM (SELECT ... FROM parts) AS d1) AS d0."""
    path = lambda n: [1] * n
    derived = [(f"d{n}", f"c{n}", None, f"c{n + 1}", path(n), path(n + 1)) for n in range(levels - 1)]
    derived.append((f"d{levels - 1}", f"c{levels - 1}", None, "p_kind", path(levels - 1), path(levels)))
    log = spark.createDataFrame([(1, [("parts", None, path(levels))], [("d0", "c0", 1, [])], [(None, [])], [], [], derived)], DERIVED)
    found = touches.column_touches(log, catalog(spark, SHOP), strict=True).collect()
    assert [(r.table_name, r.column_name, r.touches) for r in found] == [("parts", "p_kind", 1)]
    found = touches.star_touches(log, catalog(spark, SHOP)).collect()
    assert [(r.table_name, r.column_name, r.touches) for r in found] == [("parts", "p_kind", 1)]


def test_derived_tables_that_name_each_other_end(spark):
    derived = [("a", "x", "b", "x", [], [1]), ("b", "x", "a", "x", [1], [2])]
    log = spark.createDataFrame([(1, [("parts", None, [])], [("a", "x", 1, [])], [], [], [], derived)], DERIVED)
    assert touches.unresolved_references(log, catalog(spark, SHOP)).count() == 1


STARS = {
    "all of a derived table": ([(None, [])], [("t", "c", None, "note", [], [1])], {("orders", "note"): 1}),
    "by its alias": ([("t", [])], [("t", "c", None, "note", [], [1]), ("u", "d", None, "o_id", [], [1])], {("orders", "note"): 1}),
    "another alias": ([("u", [])], [("t", "c", None, "note", [], [1])], {}),
    "a derived column hides a table's": (
        [(None, [])], [("t", "p_kind", None, "note", [], [1])], {("orders", "note"): 1, ("parts", "p_id"): 1}
    ),
    "a star inside": (
        [("t", [])], [("t", "*", None, "*", [], [1])], {("orders", "o_id"): 1, ("orders", "o_day"): 1, ("orders", "note"): 1}
    ),
    "stars two levels down": (
        [("t", [])],
        [("t", "*", None, "*", [], [2]), ("v", "*", "orders", "*", [2], [1])],
        {("orders", "o_id"): 1, ("orders", "o_day"): 1, ("orders", "note"): 1},
    ),
}


@pytest.mark.parametrize("case", STARS)
def test_stars_over_derived_tables(spark, case):
    """SELECT * FROM (SELECT ... FROM orders) AS t, parts."""
    stars, derived, expected = STARS[case]
    tables = [("orders", None, [1])] + ([("parts", None, [])] if "hides" in case else [])
    log = spark.createDataFrame([(1, tables, [], stars, [], [], derived)], DERIVED)
    found = touches.star_touches(log, catalog(spark, SHOP)).collect()
    assert {(r.table_name, r.column_name): r.touches for r in found} == expected


def test_a_name_that_comes_through_a_star(spark):
    """SELECT t.note FROM (SELECT * FROM orders) AS t."""
    log = spark.createDataFrame([(1, [("orders", None, [1])], [("t", "note", 1, []), ("t", "nope", 1, [])], [], [], [], [("t", "*", None, "*", [], [1])])], DERIVED)
    found = touches.column_touches(log, catalog(spark, SHOP)).collect()
    assert [(r.table_name, r.column_name, r.touches) for r in found] == [("orders", "note", 1)]


def test_ids_and_back(spark):
    columns = catalog(spark, TWO)
    elements = spark.createDataFrame([("table2", "col3", "x"), ("table1", None, None), ("nope", None, None)], "table_name string, column_name string, value string")
    ids = touches.resolve_element_ids(elements, columns)
    assert {(r.table_name, r.table_id, r.column_id, r.resolved) for r in ids.collect()} == {("table2", 1, 101, True), ("table1", 0, None, True), ("nope", None, None, False)}
    with pytest.raises(Exception, match="not in the catalogue"):
        touches.resolve_element_ids(elements, columns, strict=True).collect()
