"""Which tables, columns and values logged queries touch.

The log is structured, one row per query:
query_id, tables ARRAY<STRUCT<name, alias, path>>,
columns ARRAY<STRUCT<qualifier, name, times, path>>, stars ARRAY<STRUCT<qualifier, path>>,
eq ARRAY<STRUCT<qualifier, name, value, path>>,
in_items ARRAY<STRUCT<qualifier, name, value, quoted_identifier, path>>.
A path (ARRAY<INT>) tells the query that an entry stands in: empty for the outermost one, and one number more for
each subquery on the way down, so that siblings differ. A query sees the tables of the queries around it.
A log may also have derived ARRAY<STRUCT<alias, name, qualifier, column, path, inner>>: column `name` of a subquery in
the FROM of the query at `path` is column `qualifier`.`column` of the subquery, whose own path is `inner`. Where the
subquery shows a star, `name` is `*` and `qualifier` that of its star. Derived tables stand in one another as deep as
they like.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slink.functions.text import unqualified

TOUCH = ["query_id", "table_name", "column_name", "value"]


def _null() -> Column:
    return F.lit(None).cast("string")


def _catalog(columns: DataFrame) -> DataFrame:
    return columns.select("table_id", F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name"))


def _table_names(columns: DataFrame) -> DataFrame:
    return columns.select("table_id", F.lower("table_name").alias("table_name")).distinct()


def _place(depth: Column, position: Column, table_id: Column, derived: Column | None = None) -> Column:
    """Depth, position in the query and table id, so that a plain maximum finds the winner; null without a table.

    Of one query's tables a derived one counts as the last.
    """
    derived = F.lit(False) if derived is None else derived
    parts = depth.alias("depth"), derived.alias("derived"), position.alias("position"), table_id.alias("table_id")
    return F.when(table_id.isNotNull(), F.struct(*parts))


EVERY = "*"  # as the name of a derived column: all columns that the subquery's own `*` shows


def _fixpoint(first: Column, following, rounds: Column) -> Column:
    """All entries reached from `first`; `following` gives those reached from one of them in a step.

    A step is taken as often as there are derived columns in the row, more than which no chain of them can have, and
    only from entries that are new.
    """

    def step(state: Column, _: Column) -> Column:
        reached = F.array_distinct(F.flatten(F.transform(state["new"], following)))
        return F.struct(F.concat(state["all"], state["new"]).alias("all"), F.array_except(reached, F.concat(state["all"], state["new"])).alias("new"))

    empty = F.filter(first, lambda _: F.lit(False))
    return F.aggregate(rounds, F.struct(empty.alias("all"), first.alias("new")), step, lambda state: F.concat(state["all"], state["new"]))


def _readings(derived: Column, qualifier: Column, name: Column, path: Column) -> Column:
    """What a reference can mean: itself, and, for each derived column it can name, that column's source.

    Sources are followed through derived tables inside one another to the end. `depth` is that of the query whose
    FROM has the derived table, null for the reference itself.
    """

    def struct(qualifier: Column, name: Column, path: Column, depth: Column) -> Column:
        return F.struct(
            qualifier.alias("qualifier"), F.lower(name).alias("column_name"), path.alias("path"), depth.alias("depth")
        )

    def named(qualifier: Column, name: Column, path: Column) -> Column:
        """Derived columns that a reference can name; a subquery does not see its own result."""
        return F.filter(
            derived,
            lambda d: _encloses(d["path"], path)
            & ~_encloses(d["inner"], path)
            & ((F.lower(d["name"]) == F.lower(name)) | (d["name"] == EVERY))
            & (qualifier.isNull() | F.coalesce(F.lower(d["alias"]) == F.lower(qualifier), F.lit(False))),
        )

    def sources(qualifier: Column, name: Column, path: Column, depth: Column | None) -> Column:
        """Where the derived columns of that name come from; `*` passes the name on."""
        return F.transform(
            named(qualifier, name, path),
            lambda d: struct(
                d["qualifier"],
                F.when(d["name"] == EVERY, name).otherwise(d["column"]),
                d["inner"],
                F.size(d["path"]) if depth is None else depth,
            ),
        )

    first = F.array_distinct(sources(qualifier, name, path, None))
    found = _fixpoint(first, lambda v: sources(v["qualifier"], v["column_name"], v["path"], v["depth"]), derived)
    itself = F.array(struct(qualifier, name, path, F.lit(None).cast("int")))
    # Most queries have no derived table, and skip all of this.
    return F.when(F.size(derived) > 0, F.concat(itself, found)).otherwise(itself)


def _encloses(outer: Column, inner: Column) -> Column:
    """Whether the query at path `outer` is that at `inner` or lies around it."""
    return (F.size(outer) <= F.size(inner)) & (F.slice(inner, 1, F.size(outer)) == outer)


def table_touches(log: DataFrame) -> DataFrame:
    """One touch per occurrence of a table."""
    occurrences = log.select("query_id", F.explode("tables").alias("t"))
    return occurrences.groupBy("query_id", F.lower("t.name").alias("table_name")).agg(F.count("*").alias("touches"))


REFERENCE = ["qualifier", "column_name", "value", "times"]


def resolve_references(
    log: DataFrame, references: str, columns: DataFrame, strict: bool = False, carry: list[str] | None = None
) -> DataFrame:
    """Table and column of every reference in an array field of the log; `carry` fields of it come along.

    A qualifier must equal a table's alias, or its name where it has none. Of
    several tables with the column the nearest enclosing query wins, and in it
    the last table. A reference meets the tables of its own row, so the log is
    never joined with itself; one in a query without tables stays unresolved.
    """
    carry = carry or []
    fields = {f.name for f in log.schema[references].dataType.elementType.fields}
    nested = "derived" in log.columns
    ref = log.select("query_id", "tables", *(["derived"] if nested else []), F.posexplode(references).alias("ref_no", "r")).select(
        "query_id",
        "tables",
        *(["derived"] if nested else []),
        "ref_no",
        F.col("r.qualifier").alias("qualifier"),
        F.lower("r.name").alias("column_name"),
        (F.col("r.value") if "value" in fields else _null()).alias("value"),
        (F.col("r.times") if "times" in fields else F.lit(1)).alias("times"),
        F.col("r.path").alias("path"),
        *[F.col(f"r.{c}").alias(c) for c in carry],
    )
    if nested:
        read = _readings(_derived(log), *(F.col(c) for c in ("qualifier", "column_name", "path")))
    else:
        read = F.array(F.struct("qualifier", "column_name", "path", F.lit(None).cast("int").alias("depth")))
    keys = ["query_id", "ref_no", *REFERENCE, *carry]
    ref = ref.withColumn("v", F.explode(read))
    numbered = F.transform("tables", lambda t, i: F.struct(t.alias("t"), i.alias("position")))
    # Tables out of sight leave before they become rows; the reference itself stays.
    seen = F.filter(
        numbered,
        lambda n: _encloses(n["t"]["path"], F.col("v.path"))
        & (
            F.col("v.qualifier").isNull()
            | (F.lower(F.coalesce(n["t"]["alias"], n["t"]["name"])) == F.lower("v.qualifier"))
        ),
    )
    candidates = ref.select(*keys, "v", F.explode_outer(seen).alias("n")).select(
        *keys,
        F.col("n.position").alias("position"),
        F.col("v.depth").isNotNull().alias("derived"),
        F.coalesce("v.depth", F.size("n.t.path")).alias("depth"),
        F.lower("n.t.name").alias("_table"),
        F.col("v.column_name").alias("_column"),
    )
    known = _catalog(columns).select("table_id", F.col("table_name").alias("_table"), F.col("column_name").alias("_column"))
    matched = candidates.join(known, ["_table", "_column"], "left")
    winner = F.max(F.struct(_place(F.col("depth"), F.col("position"), F.col("table_id"), F.col("derived")).alias("at"), F.col("_column").alias("real")))
    resolved = matched.groupBy(*keys).agg(winner.alias("w"))
    found = F.col("w.at").isNotNull()
    if strict:
        message = F.concat(F.lit("unresolved column "), F.coalesce(F.concat(F.col("qualifier"), F.lit(".")), F.lit("")), F.col("column_name"))
        # In the flag itself, so that a filter on it cannot skip the error.
        found = F.when(found, True).otherwise(F.raise_error(message).cast("boolean"))
    # A reference to a derived column touches the column behind it.
    real = F.when(F.col("w.at").isNotNull(), F.col("w.real")).otherwise(F.col("column_name"))
    rest = [c for c in REFERENCE if c != "column_name"] + carry
    numbered = resolved.select("query_id", "ref_no", real.alias("column_name"), *rest, F.col("w.at.table_id").alias("table_id"), found.alias("resolved"))
    return numbered.join(_table_names(columns), "table_id", "left")


def _derived(log: DataFrame) -> Column:
    """The derived columns of a row; a null counts as none."""
    return F.coalesce("derived", F.array().cast(log.schema["derived"].dataType))


def column_touches(log: DataFrame, columns: DataFrame, strict: bool = False) -> DataFrame:
    """Touches per column; `times` of a reference counts its aliases too."""
    resolved = resolve_references(log, "columns", columns, strict).filter("resolved")
    return resolved.groupBy("query_id", "table_name", "column_name").agg(F.sum("times").alias("touches"))


def alias_touches(log: DataFrame, columns: DataFrame) -> DataFrame:
    """The part of the column touches that aliases add."""
    resolved = resolve_references(log, "columns", columns).filter("resolved")
    extra = F.sum(F.col("times") - 1)
    return resolved.groupBy("query_id", "table_name", "column_name").agg(extra.alias("touches")).filter(F.col("touches") > 0)


def unresolved_references(log: DataFrame, columns: DataFrame) -> DataFrame:
    resolved = resolve_references(log, "columns", columns).filter(~F.col("resolved"))
    return resolved.select("query_id", "qualifier", "column_name")


def _named_by(alias: Column, qualifier: Column) -> Column:
    return qualifier.isNull() | F.coalesce(F.lower(alias) == F.lower(qualifier), F.lit(False))


def _scopes(derived: Column, star: Column) -> Column:
    """Where a star looks: at its own query, and at that of each derived table in it that shows a star itself.

    `order` compares as the places in the FROM do, of which derived tables count as the last.
    """

    def scope(path: Column, qualifier: Column, order: Column) -> Column:
        return F.struct(path.alias("path"), qualifier.alias("qualifier"), order.alias("order"))

    def inside(s: Column) -> Column:
        numbered = F.transform(derived, lambda d, i: F.struct(d.alias("d"), i.alias("i")))
        stars = F.filter(
            numbered, lambda n: (n["d"]["name"] == EVERY) & (n["d"]["path"] == s["path"]) & _named_by(n["d"]["alias"], s["qualifier"])
        )
        return F.transform(
            stars, lambda n: scope(n["d"]["inner"], n["d"]["qualifier"], F.concat(s["order"], F.array(F.lit(1), n["i"])))
        )

    own = F.array(scope(star["path"], star["qualifier"], F.array().cast("array<int>")))
    return F.when(F.size(derived) > 0, _fixpoint(own, inside, derived)).otherwise(own)


def star_touches(log: DataFrame, columns: DataFrame) -> DataFrame:
    """`*` touches every column in scope (a later table wins a shared name), `t.*` those of t.

    Of a derived table these are the columns that it shows, and what is touched are their sources.
    """
    nested = "derived" in log.columns
    if nested:
        scopes = _scopes(_derived(log), F.col("s"))
    else:
        scopes = F.array(F.struct("s.path", "s.qualifier", F.array().cast("array<int>").alias("order")))
    stars = log.select("query_id", "tables", *(["derived"] if nested else []), F.posexplode("stars").alias("star_no", "s"))
    looked = stars.withColumn("scope", F.explode(scopes)).drop("s")
    numbered = F.transform("tables", lambda t, i: F.struct(t.alias("t"), i.alias("position")))
    mine = F.filter(
        numbered,
        lambda n: (n["t"]["path"] == F.col("scope.path")) & _named_by(F.coalesce(n["t"]["alias"], n["t"]["name"]), F.col("scope.qualifier")),
    )
    own = looked.select("query_id", "star_no", "scope.order", F.explode(mine).alias("n")).select(
        "query_id", "star_no", F.concat("order", F.array(F.lit(0), "n.position")).alias("order"), F.lower("n.t.name").alias("table_name")
    )
    keys = ["query_id", "star_no", "shown", "order", "table_id", "column_name"]
    shown = own.join(_catalog(columns), "table_name").withColumn("shown", F.col("column_name")).select(*keys)
    if nested:
        numbered = F.transform(_derived(log), lambda d, i: F.struct(d.alias("d"), i.alias("i")))
        mine = F.filter(
            numbered,
            lambda n: (n["d"]["name"] != EVERY) & (n["d"]["path"] == F.col("scope.path")) & _named_by(n["d"]["alias"], F.col("scope.qualifier")),
        )
        listed = F.transform(
            mine,
            lambda n: F.struct(
                n["d"]["qualifier"].alias("qualifier"),
                n["d"]["column"].alias("name"),
                n["d"]["inner"].alias("path"),
                F.col("star_no"),
                F.lower(n["d"]["name"]).alias("shown"),
                F.concat(F.col("scope.order"), F.array(F.lit(1), n["i"])).alias("order"),
            ),
        )
        outputs = looked.filter(F.size(_derived(log)) > 0).withColumn("outputs", listed)
        behind = resolve_references(outputs, "outputs", columns, carry=["star_no", "shown", "order"]).filter("resolved")
        shown = shown.unionByName(behind.select(*keys))
    winners = shown.groupBy("query_id", "star_no", "shown").agg(F.max(F.struct("order", "table_id", "column_name")).alias("w"))
    counted = winners.groupBy("query_id", "w.table_id", "w.column_name").agg(F.count("*").alias("touches"))
    return counted.join(_table_names(columns), "table_id").select("query_id", "table_name", "column_name", "touches")


def _values(resolved: DataFrame) -> DataFrame:
    kept = resolved.filter("resolved")
    return kept.groupBy("query_id", "table_name", "column_name", "value").agg(F.count("*").alias("touches"))


def value_touches(log: DataFrame, columns: DataFrame) -> DataFrame:
    """Text equalities touch (table, column, value)."""
    return _values(resolve_references(log, "eq", columns))


def in_value_touches(log: DataFrame, columns: DataFrame) -> DataFrame:
    """IN items written as quoted identifiers touch their value; plain literals do not."""
    quoted = log.withColumn("in_items", F.filter("in_items", lambda i: i["quoted_identifier"]))
    return _values(resolve_references(quoted, "in_items", columns))


def _reference(entry: Column, value: Column, times: Column) -> Column:
    return F.struct(
        entry["qualifier"].alias("qualifier"), entry["name"].alias("name"), value.alias("value"), times.alias("times"), entry["path"].alias("path")
    )


def touch_counts(log: DataFrame, columns: DataFrame) -> DataFrame:
    """All touches per query and element.

    Columns, equalities and IN items become one list of references, so the log
    is resolved against the catalogue once and not once per kind.
    """
    once = F.lit(1)
    references = F.concat(
        F.transform("columns", lambda c: _reference(c, _null(), c["times"])),
        F.transform("eq", lambda e: _reference(e, e["value"], once)),
        F.transform(F.filter("in_items", lambda i: i["quoted_identifier"]), lambda i: _reference(i, i["value"], once)),
    )
    resolved = resolve_references(log.withColumn("references", references), "references", columns).filter("resolved")
    referenced = resolved.groupBy(*TOUCH).agg(F.sum("times").alias("touches"))
    parts = [
        table_touches(log).withColumns({"column_name": _null(), "value": _null()}),
        star_touches(log, columns).withColumn("value", _null()),
        referenced,
    ]
    return reduce(DataFrame.unionByName, parts).groupBy(*TOUCH).agg(F.sum("touches").alias("touches"))


def workload_touches(touches: DataFrame) -> DataFrame:
    """Number of touched elements per query and level."""
    kind = F.when(F.col("value").isNotNull(), "value").when(F.col("column_name").isNotNull(), "column").otherwise("table")
    return touches.groupBy("query_id", kind.alias("level")).agg(F.count("*").alias("elements"))


def resolve_element_ids(elements: DataFrame, columns: DataFrame, strict: bool = False) -> DataFrame:
    """Names to ids: table by its unqualified upper-case name, column by its upper-case name."""
    tables = columns.select(unqualified(F.col("fqn")).alias("_table"), F.col("table_id")).distinct()
    names = columns.select("table_id", F.col("column_name").alias("_column"), "column_id")
    keyed = elements.withColumns({"_table": F.upper("table_name"), "_column": F.upper("column_name")})
    joined = keyed.join(tables, "_table", "left").join(names, ["table_id", "_column"], "left").drop("_table", "_column")
    missing = F.col("table_id").isNull() | (F.col("column_name").isNotNull() & F.col("column_id").isNull())
    if strict:
        # In a filter, which no selection of columns can prune.
        joined = joined.filter(F.when(missing, F.raise_error(F.lit("element is not in the catalogue")).cast("boolean")).otherwise(True))
    return joined.withColumn("resolved", ~missing)


def element_names(ids: DataFrame, columns: DataFrame) -> DataFrame:
    """Ids to names; the column is optional."""
    tables = columns.select("table_id", unqualified(F.col("fqn")).alias("table_name")).distinct()
    names = columns.select("column_id", "column_name")
    return ids.join(tables, "table_id", "left").join(names, "column_id", "left")
