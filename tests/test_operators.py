import pytest

from pyspark.sql import functions as F

from lakeloom import compare, incremental, quality
from lakeloom.operators import joins, project, reshape, rows


def collected(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_thin_filter_semantics(spark):
    df = spark.createDataFrame([(0, "7"), (1, None), (2, "8")], "id long, biz string")
    def ids(tree):
        return [r.id for r in project.filter_thin(df, tree).orderBy("id").collect()]

    assert ids({"op": "ne", "column": "biz", "value": 7}) == [1, 2]
    assert ids({"op": "eq", "column": "biz", "value": 7}) == [0]
    assert ids({"op": "like", "column": "biz", "value": "8%"}) == [2]
    assert ids({"op": "what", "column": "biz"}) == []
    with pytest.raises(ValueError):
        project.filter_sql(df, "[biz] = 1")


def test_rename_and_project_errors(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        project.rename_columns(df, {"a": "b"})
    with pytest.raises(ValueError):
        project.include_columns(df, ["z"])
    with pytest.raises(ValueError):
        project.project(df, [{"name": "z"}])
    assert project.rename_columns(df, rules=[{"pattern": "A", "replacement": "x", "ignore_case": True}]).columns == ["x", "b"]


def test_strict_cast(spark):
    df = spark.createDataFrame([("x",)], "a string")
    assert project.type_cast(df, [{"name": "a", "type": "int64"}], strict=False).first().a is None
    with pytest.raises(Exception):  # noqa: B017
        project.type_cast(df, [{"name": "a", "type": "int64"}]).collect()


def test_reference_replace(spark):
    df = spark.createDataFrame([(1, "old"), (2, "other"), (3, None)], "id long, status string")
    lookup = spark.createDataFrame([("old", "new"), (None, "never")], "a string, b string")
    assert collected(project.reference_replace(df, "status", lookup, "a", "b").select("id", "status"), "id") == [(1, "new"), (2, "other"), (3, None)]
    double = spark.createDataFrame([("old", "new"), ("old", "newer")], "a string, b string")
    with pytest.raises(Exception, match="duplicate reference key"):
        project.reference_replace(df, "status", double, "a", "b").collect()


def test_null_keys_never_join(spark):
    left = spark.createDataFrame([(None, 1, "l1"), ("a", 1, "l2")], "k string, n int, x string")
    right = spark.createDataFrame([(None, 1, "r1"), ("a", 1, "r2"), ("b", 2, "r3")], "k string, n int, x string")
    assert collected(joins.join(left, right, ["k", "n"], "left"), "x") == [(None, 1, "l1", None), ("a", 1, "l2", "r2")]
    full = joins.join(left, right, ["k", "n"], "full", suffix="_r")
    assert sorted(map(str, collected(full, "n"))) == sorted(map(str, [(None, 1, "l1", None), ("a", 1, "l2", "r2"), (None, 1, None, "r1"), ("b", 2, None, "r3")]))
    with pytest.raises(ValueError):
        joins.join(left, right.withColumn("n", right.n.cast("long")), ["k", "n"])
    with pytest.raises(ValueError):
        joins.join(left, right, ["k"], exclude=["k"])
    with pytest.raises(ValueError):
        joins.join(left, right, ["k"], "cross")


def test_enrich_needs_unique_keys(spark):
    df = spark.createDataFrame([("a",), ("z",)], "k string")
    lookup = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "k string, v int")
    assert collected(joins.enrich(df, lookup, ["k"], ["v"]), "k") == [("a", 1), ("z", None)]
    with pytest.raises(Exception, match="not unique"):
        joins.enrich(df, lookup.union(lookup), ["k"], ["v"]).collect()


def test_union_and_keyspace(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([(2,), (None,)], "k int")
    assert collected(joins.union_rows({"a": a, "b": b}, "who").filter("k is not null"), "k") == [(1, "x", "a"), (2, None, "b")]
    assert collected(joins.keyspace([a, b], ["k"], "drop"), "k") == [(1,), (2,)]
    with pytest.raises(Exception, match="null key"):
        joins.keyspace([a, b], ["k"]).collect()
    with pytest.raises(ValueError):
        joins.union_by_name([a, b.withColumn("k", b.k.cast("long"))])
    assert joins.bind("v", ["a"], {}, {"l": ["v"]}) == "l.v"
    with pytest.raises(ValueError):
        joins.bind("v", ["a"], {}, {"l": ["v"], "m": ["v"]})


def test_sort_first_and_dedupe(spark, tmp_path):
    df = spark.createDataFrame([(1, "g", 2), (2, "g", None), (3, "g", 2), (4, None, 1)], "id long, g string, at int")
    assert collected(rows.sort_first(df, ["g"], [{"column": "at", "direction": "desc"}], ["id"]).select("id"), "id") == [(1,), (4,)]
    df.coalesce(1).write.parquet(str(tmp_path / "p"))
    read = spark.read.parquet(str(tmp_path / "p"))
    assert collected(rows.dedupe_per_file(read, ["g"], ["at"]).select("id"), "id") == [(2,), (4,)]


def test_pivot(spark):
    df = spark.createDataFrame([(1, "A", "X", 1), (2, "A", "Y", 2), (3, "B", "X", 3), (4, "A", "X", 9)], "o int, row string, col string, value int")
    out = reshape.pivot(df, ["row"], ["col"], [{"name": "value", "agg": "first"}], ["o"])
    assert out.columns == ["row", "X__value", "Y__value"]
    assert collected(out, "row") == [("A", 1, 2), ("B", 3, None)]
    with pytest.raises(Exception, match="duplicate cell"):
        reshape.pivot(df, ["row"], ["col"], [{"name": "value", "agg": "first"}], ["o"], duplicates="error").collect()


def test_unpivot_order_and_types(spark):
    df = spark.createDataFrame([(1, 2, 3.5, "t")], "id int, a long, b double, s string")
    assert collected(reshape.unpivot(df, ["id"], ["a", "b"]), "name") == [(1, "a", 2.0), (1, "b", 3.5)]
    with pytest.raises(ValueError):
        reshape.unpivot(df, ["id"], ["a", "s"])
    assert collected(reshape.unpivot(df, ["id"], ["a", "s"], coercion="string"), "name") == [(1, "a", "2"), (1, "s", "t")]


def test_lists_round_trip(spark):
    df = spark.createDataFrame([(1, [10, 20]), (2, []), (3, None), (4, [None])], "id long, v array<long>")
    assert collected(reshape.unnest(df), "id", "v") == [(1, 10), (1, 20), (4, None)]
    back = reshape.compact_lists(reshape.expand_lists(df, position="at"), df, "id", ["v"], "at")
    assert collected(back, "id") == [(1, [10, 20]), (2, []), (3, None), (4, [None])]
    with pytest.raises(Exception, match="differ in length"):
        reshape.unnest(spark.createDataFrame([([1], [1, 2])], "a array<int>, b array<int>")).collect()
    with pytest.raises(Exception, match="more than 1 elements"):
        reshape.unnest(df, most=1).collect()


def test_restore_lists(spark):
    lookup = spark.createDataFrame([("g", 1, 1, 1), ("g", 2, 2, 2), ("g", 3, 3, 3)], "grp string, ord int, lx int, ly int")
    df = spark.createDataFrame([("g", [3.5, 1.5], [3, 1], [3, 1]), ("g", [9.0], [7], [7])], "grp string, v array<double>, x array<int>, y array<int>")
    out = [r.v for r in reshape.restore_lists(df, lookup, "grp", ["v"], ["x", "y"], "ord", ["lx", "ly"]).collect()]
    assert out == [[1.5, None, 3.5], [None, None, None]]
    with pytest.raises(Exception, match="unknown key"):
        reshape.restore_lists(df.withColumn("grp", F.lit("z")), lookup, "grp", ["v"], ["x", "y"], "ord", ["lx", "ly"]).collect()


def test_long_fact_lanes(spark):
    df = spark.createDataFrame([(1, 2.5, [1, None])], "id long, a double, b array<int>")
    out = {r.fact_name: r for r in reshape.long_fact(df, ["id"], ["a", "b"], "g1").collect()}
    assert out["a"].value_float64 == 2.5 and out["a"].list_int64 is None and out["b"].list_int64 == [1, None]
    assert out["a"].identity_hash == out["b"].identity_hash and out["a"].is_deleted is False


def test_quality_failures_name_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, None)], "id int, s string")
    quality.check(df, [{"kind": "row_count", "min": 1, "max": 2}, {"kind": "accepted_values", "column": "s", "values": ["a"]}])
    with pytest.raises(quality.AssertionFailed) as failed:
        quality.check(df, [{"id": "u", "kind": "unique", "columns": ["id"]}, {"id": "n", "kind": "not_null", "columns": ["s"]}])
    assert {(f["rule_id"], f["failed"]) for f in failed.value.failures} == {("u", 1), ("n", 1)}


def test_compare_is_free_of_order(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "a int, b string")
    b = spark.createDataFrame([(None, 2), ("x", 1), ("x", 1)], "b string, a int")
    assert compare.compare(a, b)["equal"]
    assert not compare.compare(a, b.limit(2))["equal"]
    assert not compare.compare(a, a.withColumn("a", a.a.cast("long")))["equal"]
    assert compare.compare(a, b)["left"]["duplicates"] == 1


def test_incremental_plan_and_skips():
    contract = incremental.contract({"a": "1"})
    assert incremental.plan({"p": "1"}, None, contract).mode == "initial"
    receipt = {"contract": contract, "parts": {"p": "1", "q": "1"}}
    delta = incremental.plan({"p": "2"}, receipt, contract)
    assert (delta.mode, delta.process, delta.remove) == ("delta", ["p"], ["q"])
    assert incremental.plan(receipt["parts"], receipt, contract).mode == "unchanged"
    assert incremental.plan(receipt["parts"], receipt, "other").mode == "full"
    kept, skipped = incremental.runnable({"a": "[x] + 1", "b": "[a] + [gone]", "c": "[b]"}, ["x"])
    assert list(kept) == ["a"] and set(skipped) == {"b", "c"}


def test_pivot_minima_of_text_and_duplicate_warning(spark):
    df = spark.createDataFrame([(1, "x", "9", 1), (1, "x", "10", 2), (1, "y", "b", 3), (1, "y", "10", 4), (2, "x", None, 5), (2, "x", "1.0", 6), (2, "x", "1", 7)], "r int, c string, v string, o int")
    out = {r.r: r for r in reshape.pivot(df, ["r"], ["c"], [{"name": "v", "agg": "min"}, {"name": "v", "agg": "max"}], ["o"], name=("<column_key_value>", "<agg>")).collect()}
    assert (out[1].x__min, out[1].x__max, out[1].y__min, out[1].y__max, out[2].x__min, out[2].x__max) == ("9", "10", "10", "b", "1.0", "1.0")
    with pytest.warns(UserWarning, match="3 pivot cells"):
        reshape.pivot(df, ["r"], ["c"], [{"name": "v", "agg": "first"}], ["o"], duplicates="warn")
    with pytest.raises(ValueError):
        reshape.pivot(df, ["r"], ["c"], [{"name": "v", "agg": "first"}], ["o"], duplicates="maybe")
