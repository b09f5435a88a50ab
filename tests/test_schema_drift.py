"""Drift between files: the kinds of change, unreadable lines, and the consistent table."""

from datetime import datetime

from normspark.operators import schema_drift

SCHEMA = "report_series string, file_name string, written_at timestamp_ntz, line_no int, entry_id string, raw_record string, field string"


def lines(spark, files):
    rows = []
    for n, (name, records) in enumerate(files):
        for i, (entry, text) in enumerate(records):
            rows.append(("s", name, datetime(2025, 1, 1 + n), i, entry, text, "clash"))
    return spark.createDataFrame(rows[::-1], SCHEMA)


def log(spark, *files):
    return {tuple(r) for r in schema_drift.drift_log(lines(spark, files)).select("file_name", "drift_kind", "field_before", "field_after").collect()}


def test_added_removed_renamed_retyped(spark):
    got = log(
        spark,
        ("f1", [("e1", '{"a":1,"b":"x","c":0.5,"d":true}'), ("e2", '{"a":2,"b":"y","c":1}')]),
        ("f2", [("e1", '{"A":1,"c":"0.5","d":true,"n":[1]}'), ("e2", '{"A":2,"c":"1"}'), ("e3", '{"A":9,"d":null}')]),
    )
    assert got == {("f2", "renamed", "a", "A"), ("f2", "removed", "b", ""), ("f2", "added", "", "n"), ("f2", "retyped", "c", "c")}


def test_a_rename_needs_equal_values_of_one_type(spark):
    got = log(spark, ("f1", [("e1", '{"a":1}')]), ("f2", [("e1", '{"b":1.0}')]))
    assert got == {("f2", "removed", "a", ""), ("f2", "added", "", "b")}
    got = log(spark, ("f1", [("e1", '{"a":null}')]), ("f2", [("e1", '{"b":1}')]))
    assert got == {("f2", "removed", "a", ""), ("f2", "added", "", "b")}


def test_a_field_that_comes_back_is_added_again(spark):
    got = log(spark, ("f1", [("e", '{"a":1,"k":1}')]), ("f2", [("e", '{"k":1}')]), ("f3", [("e", '{"a":7,"k":1}')]))
    assert got == {("f2", "removed", "a", ""), ("f3", "added", "", "a")}


def test_unreadable_lines_do_not_count(spark):
    broken = ['{"z":1', "", None, "[1]", '{"z":1} x', '{"z":1}{"z":2}', "NaN"]
    got = log(spark, ("f1", [("e1", '{"a":1}')]), ("f2", [("e1", '{"a":1}')] + [("e2", b) for b in broken]))
    assert got == set()


def test_of_a_repeated_key_the_last_value_counts(spark):
    files = [("f1", [("e1", '{"a":1,"b":3}')]), ("f2", [("e1", '{"b":"x","b":3,"A":1}')])]
    assert log(spark, *files) == {("f2", "renamed", "a", "A")}
    assert sorted(tuple(r) for r in schema_drift.unified(lines(spark, files)).select("a", "b").collect()) == [(1, 3), (1, 3)]


def test_types(spark):
    raw = lines(spark, [("f", [("e", '{"i":1,"d":12.0,"e":1e3,"s":"1","l":[],"b":false,"n":null,"m":1,"o":{"x":1}}'), ("e2", '{"m":2.5}')])])
    got = {r.field: r.kind for r in schema_drift.catalogue(raw).collect()}
    assert got == {"i": "integer", "d": "double", "e": "double", "s": "string", "l": "list", "b": "boolean", "n": None, "m": "double", "o": "object"}


def test_unified_table_and_empty_input(spark):
    raw = lines(spark, [("f1", [("e1", '{"a":1,"x":"1.5"}'), ("e1", '{"a":1,"x":"1.5"}')]), ("f2", [("e1", '{"A":1,"x":2}')])])
    out = schema_drift.unified(raw)
    assert sorted(tuple(r) for r in out.select("file_name", "a", "x").collect()) == [("f1", 1, 1.5), ("f1", 1, 1.5), ("f2", 1, 2.0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert schema_drift.drift_log(empty).count() == 0 and schema_drift.unified(empty).count() == 0


def test_long_integers_keep_their_value(spark):
    long = 99999999999999999999
    raw = lines(spark, [("f1", [("e1", '{"a":%d,"b":9007199254740993,"c":1}' % long), ("e2", '{"a":-3,"b":0.5,"c":2.5}')])])
    out = schema_drift.unified(raw)
    assert dict(out.select("a", "b", "c").dtypes) == {"a": "decimal(38,0)", "b": "string", "c": "double"}
    assert {(int(r.a), r.b, r.c) for r in out.collect()} == {(long, "9007199254740993", 1.0), (-3, "0.5", 2.5)}


def test_a_renaming_holds_only_in_its_series_and_lifespan(spark):
    one = [("one", f"o{n}", datetime(2025, 1, 1 + n), 0, "e", text, "") for n, text in enumerate(['{"a":1}', '{"c":1}', '{"c":1,"a":8}', '{"c":4}'])]
    other = [("other", "p0", datetime(2025, 1, 1), 0, "e", '{"a":5,"c":7}', ""), (None, "p0", datetime(2025, 1, 1), 0, "e", '{"a":5}', "")]
    drift = schema_drift.Drift(spark.createDataFrame(one + other, SCHEMA))
    assert {tuple(r) for r in drift.aliases().collect()} == {("one", "a", 1, 1, "a"), ("one", "c", 2, 4, "a"), ("one", "a", 3, 3, "a@3"), ("other", "a", 1, 1, "a"), ("other", "c", 1, 1, "c")}
    out = schema_drift.unified(spark.createDataFrame(one + other, SCHEMA), drift)
    assert {(r.file_name, r.a, r["a@3"], r.c) for r in out.collect()} == {("o0", 1, None, None), ("o1", 1, None, None), ("o2", 1, 8, None), ("o3", 4, None, None), ("p0", 5, None, 7)}
