import pytest

from lakeloom import publish, sinks
from lakeloom.expr import ExpressionError
from lakeloom.expr.files import load


def test_publish_read_and_collect(spark, tmp_path):
    root, target = f"{tmp_path}/data", f"{tmp_path}/public"
    df = spark.range(5)
    first = sinks.commit(df, root)["generation"]
    assert publish.publish(spark, root, target) == {"generation": first, "previous": None}
    second = sinks.commit(df.filter("id < 2"), root)["generation"]
    with pytest.raises(ValueError):
        publish.publish(spark, root, target, expected="other")
    assert publish.publish(spark, root, target, expected=first)["previous"] == first
    assert (publish.read(spark, target).count(), publish.read(spark, target, first).count()) == (2, 5)
    assert publish.collect_garbage(spark, target) == [first] and publish.current(spark, target) == second


def test_two_publishers_of_one_pointer(spark, tmp_path, monkeypatch):
    root, target = f"{tmp_path}/data", f"{tmp_path}/public"
    sinks.commit(spark.range(5), root)
    first = publish.publish(spark, root, target)["generation"]
    sinks.commit(spark.range(6), root)
    monkeypatch.setattr(publish, "_pointer", lambda *_: (0, None))  # a publisher that has not seen the first pointer
    with pytest.raises(ValueError, match="meanwhile"):
        publish.publish(spark, root, target)
    monkeypatch.undo()
    assert publish.current(spark, target) == first
    (tmp_path / "public" / "pointers" / "000000000002.json").write_text("")  # written by half
    assert publish.current(spark, target) == first


def test_key_lookup(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "cast(id % 7 as int) AS k", "if(id % 7 = 3, null, 'x') AS s")
    df.repartition(4).write.parquet(f"{tmp_path}/d")
    publish.build_key_index(spark, f"{tmp_path}/d", ["k", "s"], f"{tmp_path}/i", 8)
    ids = lambda key: sorted(r.id for r in publish.lookup(spark, f"{tmp_path}/d", f"{tmp_path}/i", key, 8).collect())
    assert ids({"k": 2, "s": "x"}) == [i for i in range(100) if i % 7 == 2]
    assert ids({"k": 3, "s": None}) == [i for i in range(100) if i % 7 == 3]
    assert ids({"k": 99, "s": "x"}) == []


def test_run_log(spark, tmp_path):
    log = publish.RunLog(spark, f"{tmp_path}/log")
    log.record("a", "ran", rows=3)
    log.record("a", "failed")
    assert [r.status for r in log.read().orderBy("at").collect()] == ["ran", "failed"]


def test_expression_files():
    assert load("x.csv", 'name,expression\na,"[x] + 1"\n') == {"a": "[x] + 1"}
    assert load("x.yaml", "layers:\n- a: '[x]'\n- expressions:\n  - {name: b, expression: '[a] * 2'}\n") == {"a": "[x]", "b": "[a] * 2"}
    with pytest.raises(ExpressionError):
        load("x.yaml", "- {name: a, expression: '1'}\n- {name: a, expression: '2'}")
    with pytest.raises(ExpressionError):
        load("x.yaml", "a: '[x'")
