import pytest

from slink.plans.link_schema import link_question_texts
from slink.plans.warehouse_import import ImportLimits, import_catalog, import_warehouse, read_imported
from slink.sources.shared import new_path


def people(spark, *extra):
    rows = [(1, "Ada", "Harbour Street") + extra, (2, "Grace", "Mill Lane") + extra, (3, None, "Mill Lane") + extra]
    names = ["id", "name", "street", *(f"more_{i}" for i in range(len(extra)))]
    return spark.createDataFrame(rows, names)


def ships(spark):
    return spark.createDataFrame([("Mayflower", 3), ("Beagle", 2)], ["ship", "masts"])


def columns_of(spark, path, version=None):
    rows = read_imported(spark, path, "columns", version).collect()
    return {(r["table_name"], r["column_name"]): r for r in rows}


def test_first_import_profiles_and_numbers(spark):
    path = new_path(spark, "t-import")
    assert import_catalog(spark, {"ships": ships(spark), "people": people(spark)}, path) == 0
    found = columns_of(spark, path)
    assert {k: r["column_id"] for k, r in found.items()} == {
        ("PEOPLE", "ID"): 0, ("PEOPLE", "NAME"): 1, ("PEOPLE", "STREET"): 2, ("SHIPS", "SHIP"): 100, ("SHIPS", "MASTS"): 101,
    }
    street, name = found["PEOPLE", "STREET"], found["PEOPLE", "NAME"]
    assert (street["distinct_rows"], street["rows"], street["null_rows"]) == (2, 3, 0)
    assert (name["distinct_rows"], name["rows"], name["null_rows"]) == (2, 3, 1)
    assert street["fqn"] == "WAREHOUSE.PUBLIC.PEOPLE" and street["kind"] == "COLUMN"


def test_left_out_tables_and_columns(spark):
    listed = {
        "empty": ships(spark).limit(0),
        "fivetran_audit": ships(spark),
        "people": people(spark).withColumnRenamed("street", "default_street"),
        "old_scd": ships(spark),
        "zebra": ships(spark),
    }
    path = new_path(spark, "t-import")
    import_catalog(spark, listed, path, ImportLimits(tables=4, columns=2))
    assert set(columns_of(spark, path)) == {("PEOPLE", "ID"), ("PEOPLE", "NAME")}


def test_a_column_limit_counts_before_skipped_names(spark):
    listed = {"people": people(spark).withColumnRenamed("name", "is_default")}
    path = new_path(spark, "t-import")
    import_catalog(spark, listed, path, ImportLimits(columns=2))
    assert set(columns_of(spark, path)) == {("PEOPLE", "ID")}


def test_ids_outlive_changes(spark):
    path = new_path(spark, "t-import")
    import_catalog(spark, {"people": people(spark), "ships": ships(spark)}, path)
    before = columns_of(spark, path)
    # A table in front by name, a column in the middle, and ships gone.
    changed = people(spark, "x").select("id", "more_0", "name", "street")
    assert import_catalog(spark, {"animals": ships(spark), "people": changed}, path) == 1
    after = columns_of(spark, path)
    assert all(after[k]["column_id"] == r["column_id"] and after[k]["table_id"] == r["table_id"] for k, r in before.items())
    assert after["PEOPLE", "MORE_0"]["column_id"] == 3 and after["PEOPLE", "MORE_0"]["ordinal"] == 1
    assert after["ANIMALS", "SHIP"]["column_id"] == 200
    assert after["SHIPS", "SHIP"]["version"] == 0 and after["PEOPLE", "NAME"]["version"] == 1
    assert columns_of(spark, path, 0) == before


def test_a_column_beyond_the_stride_is_an_error(spark):
    with pytest.raises(Exception, match="more than 2 columns"):
        import_catalog(spark, {"people": people(spark)}, new_path(spark, "t-import"), id_stride=2)


def test_a_cut_off_import_is_repeated_under_its_number(spark):
    path = new_path(spark, "t-import")
    tables = {"people": people(spark)}
    import_catalog(spark, tables, path)
    # The next one fails after its tables were written.
    with pytest.raises(Exception, match="more than 3 columns"):
        import_catalog(spark, {"people": people(spark, "x"), "ships": ships(spark)}, path, id_stride=3)
    assert import_catalog(spark, {"people": people(spark, "x"), "ships": ships(spark)}, path) == 1
    assert read_imported(spark, path, "tables").count() == 2
    assert len(columns_of(spark, path)) == 6


def test_nothing_to_import(spark):
    path = new_path(spark, "t-import")
    with pytest.raises(LookupError):
        read_imported(spark, path, "columns")
    assert import_catalog(spark, {"empty": ships(spark).limit(0)}, path) == 0
    assert read_imported(spark, path, "columns", 0).count() == 0
    # What holds nothing does not count as a version.
    with pytest.raises(LookupError):
        read_imported(spark, path, "columns")
    assert import_catalog(spark, {"ships": ships(spark)}, path) == 0
    assert len(columns_of(spark, path)) == 2


def test_index_holds_all_kinds_of_the_imported_tables(spark):
    path = new_path(spark, "t-import")
    version = import_warehouse(spark, {"people": people(spark), "ships": ships(spark)}, path, data_source_id=7)
    index = read_imported(spark, path, "index", version)
    rows = index.select("data_source_id", "index_name", "content").collect()
    assert {r["data_source_id"] for r in rows} == {7}
    assert sorted(r["content"] for r in rows if r["index_name"] == "table_name") == ["PEOPLE", "SHIPS"]
    values = {r["content"] for r in rows if r["index_name"] == "value"}
    assert values == {"Ada", "Grace", "Harbour Street", "Mill Lane", "Mayflower", "Beagle"}
    assert len({r["index_name"] for r in rows}) == 9
    # A second import without ships leaves them in the catalogue, not in the index.
    second = import_warehouse(spark, {"people": people(spark)}, path, data_source_id=7)
    names = read_imported(spark, path, "index", second).filter("index_name = 'table_name'").select("content").collect()
    assert [r["content"] for r in names] == ["PEOPLE"]
    assert read_imported(spark, path, "tables", second).count() == 2


def test_value_limit_and_tables_without_text(spark):
    path = new_path(spark, "t-import")
    numbers = spark.range(3).toDF("n")
    version = import_warehouse(spark, {"numbers": numbers}, path)
    assert read_imported(spark, path, "index", version).filter("value is not null").count() == 0
    path = new_path(spark, "t-import")
    version = import_warehouse(spark, {"people": people(spark)}, path, ImportLimits(values=1))
    kept = read_imported(spark, path, "index", version).filter("index_name = 'value'").select("value").collect()
    assert sorted(r["value"] for r in kept) == ["Ada", "Mill Lane"]


def test_questions_find_what_they_name(spark):
    path = new_path(spark, "t-import")
    version = import_warehouse(spark, {"people": people(spark), "ships": ships(spark)}, path)
    index, columns = read_imported(spark, path, "index", version), read_imported(spark, path, "columns", version)
    asked = spark.createDataFrame(
        [(1, "ships with masts beagle"), (2, "people of mill lane street"), (3, None), (4, "")], "question_id int, text string"
    )
    linked = {r["question_id"]: r["schema_ddl"] for r in link_question_texts(asked, index, columns, 8).collect()}
    assert "create table ships" in linked[1].lower() and "create table people" not in linked[1].lower()
    assert "create table people" in linked[2].lower() and "create table ships" not in linked[2].lower()
    # Questions without words score nothing but are answered, in the order of the elements.
    assert set(linked) == {1, 2, 3, 4}
