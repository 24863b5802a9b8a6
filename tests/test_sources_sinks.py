import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lakeloom import plans, quality, sinks, streaming
from lakeloom.plans import chain
from lakeloom.sources import files, http, windows


def test_parquet_union_by_name(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id long, s string").write.parquet(f"{tmp_path}/d/a")
    spark.createDataFrame([(2,)], "id long").write.parquet(f"{tmp_path}/d/b")
    spark.createDataFrame([(3,)], "id int").write.parquet(f"{tmp_path}/bad")
    found = files.discover(spark, [f"{tmp_path}/d"])
    df = files.read_parquet_union(spark, found)
    assert sorted((r.id, r.s) for r in df.collect()) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError, match="column id"):
        files.read_parquet_union(spark, [*found, f"{tmp_path}/bad"])


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,load_time,note\n1,2024-01-02 03:04:05,"a,b"\n2,,NA\n')
    df = files.read_csv(spark, [str(tmp_path / "x.csv")], null_values=("", "NA"), casts={"int64": ["id"]})
    rows = df.orderBy("id").collect()
    assert rows[0].id == 1 and rows[0].load_time == dt.datetime(2024, 1, 2, 3, 4, 5) and rows[0].note == "a,b" and rows[0].file_name == "x.csv"
    assert rows[1].load_time is None and rows[1].note is None
    (tmp_path / "bad.csv").write_text("id,a\n1,2,3\n")
    with pytest.raises(Exception):  # noqa: B017
        files.read_csv(spark, [str(tmp_path / "bad.csv")]).collect()


def test_http_formats_and_pages(spark):
    data = [{"id": i, "in": {"x": i, "l": [1]}} for i in range(5)]

    def fetch(url, params):
        at, n = (params["page"] - 1) * params["size"], params["size"]
        return json.dumps({"data": {"items": data[at : at + n]}, "total": 5}).encode()

    pages = {"size": 2, "max_pages": 9}
    df = http.read(spark, fetch, "u", parse=lambda b: http.parse_json(b, "data.items", "total"), pagination=pages)
    assert df.columns == ["id", "in.x", "in.l"] and df.count() == 5
    with pytest.raises(ValueError, match="more than 1 pages"):
        http.read(spark, fetch, "u", parse=lambda b: http.parse_json(b, "data.items"), pagination={"size": 2, "max_pages": 1})
    assert http.parse_ndjson(b'{"a": 1}\n\n{"a": null}') == [{"a": "1"}, {"a": None}]
    with pytest.raises(ValueError):
        http.parse_ndjson(b"[1]")
    xml = b'<r xmlns="u"><code>00</code><items><item><a>1</a><b><c>2</c></b></item><item><a/></item></items></r>'
    assert http.parse_xml(xml, "items.item", "code", ("00",)) == [{"a": "1", "b.c": "2"}, {"a": None}]
    with pytest.raises(ValueError):
        http.parse_xml(xml, "items.item", "code", ("01",))


def test_zip_members_are_checked():
    def packed(names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, "x")
        return out.getvalue()

    assert http.unzip(packed(["a.csv", "b.exe"])) == {"a.csv": b"x"}
    for bad, most in ((["../a.csv"], 9), (["a.csv", "b.csv"], 1)):
        with pytest.raises(ValueError):
            http.unzip(packed(bad), most_members=most)
    assert http.latest_entry("1 h http://x/20240101.export\n2 h http://x/20240102.export\n3 h http://x/20240103.gkg", "export") == ("http://x/20240102.export", 2)


def test_windows_and_templates():
    now = dt.datetime(2024, 5, 1, 12)
    days = windows.expand("-3d", "today", dt.timedelta(days=2), now)
    assert days == [(dt.datetime(2024, 4, 28), dt.datetime(2024, 4, 30)), (dt.datetime(2024, 4, 30), dt.datetime(2024, 5, 1))]
    hours = windows.expand("2024-05-01T01:30", "2024-05-01T09:00", dt.timedelta(hours=4), now)
    assert [a.hour for a, _ in hours] == [1, 4, 8] and hours[0][1].hour == 4
    assert "d >= :date_from AND d < :date_to" in windows.template_sql("t", ["a"], "d", ["x = 1"])
    assert windows.prefix_filter("c", "a_b") == "c LIKE 'a\\_b%'"
    assert len(windows.tasks(days, [{"f": 1}, {"f": 2}])) == 4


def test_commit_receipts_and_recovery(spark, tmp_path):
    root = f"{tmp_path}/out"
    df = spark.createDataFrame([(1, "a/b"), (2, None), (3, "")], "id long, p string").coalesce(1)
    first = sinks.commit(df, root, "p")
    assert len(first["added"]) == 3 and first["previous"] is None
    assert sorted(r.p for r in spark.read.parquet(root).collect()) == ["__empty__", "__null__", "a_b"]
    second = sinks.commit(df.filter("id < 3"), root, "p")
    assert second["previous"] == first["generation"] and len(second["removed"]) >= 1
    with pytest.raises(ValueError):
        sinks.commit(df.withColumn("p", df.id.cast("double")), root, "p")
    (tmp_path / "out.stage-x").mkdir()
    assert sinks.recover(spark, root) == ["removed out.stage-x"]


def test_segments_and_routes(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    for segment, rows in (("a", df), ("b", df), ("a", df.filter("id = 1"))):
        sinks.write_segment(rows, f"{tmp_path}/seg", segment)
    read = spark.read.parquet(f"{tmp_path}/seg")
    assert sorted((r.id, r.segment_id) for r in read.collect()) == [(1, "a"), (1, "b"), (2, "b")]
    sinks.drop_segments(spark, f"{tmp_path}/seg", ["b"])
    assert spark.read.parquet(f"{tmp_path}/seg").count() == 1
    sinks.write_routes(df, {"low": "[id] < 2", "all": "[id] > 0"}, f"{tmp_path}/routes")
    assert spark.read.parquet(f"{tmp_path}/routes/all").count() == 2
    sinks.write_snapshot(df, f"{tmp_path}/one")
    assert len(files.discover(spark, [f"{tmp_path}/one"])) == 1


def test_definition_chain_and_reuse(spark, tmp_path):
    spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "k long, v long").write.parquet(f"{tmp_path}/in")
    clean = {"sources": {"in": {"paths": [f"{tmp_path}/in"]}}, "steps": [{"op": "active_row_selection", "group": ["k"], "sort": ["v"]}], "output": {"path": f"{tmp_path}/clean"}}
    calc = {"sources": {"c": {"asset": "clean"}}, "steps": [{"op": "add_calc", "expressions": {"w": "[v] * 2"}}, {"op": "data_assertion", "rules": [{"kind": "range", "column": "w", "max": 10}]}], "output": {"path": f"{tmp_path}/calc"}}
    marks: dict[str, str] = {}
    assert chain.run(spark, {"calc": calc, "clean": clean}, marks).status == {"clean": "ran", "calc": "ran"}
    assert sorted((r.k, r.w) for r in spark.read.parquet(f"{tmp_path}/calc").collect()) == [(1, 10), (2, 2)]
    assert chain.run(spark, {"calc": calc, "clean": clean}, marks).status == {"clean": "reused", "calc": "reused"}
    calc["steps"][1]["rules"][0]["max"] = 9
    after = {"sources": {"c": {"asset": "calc"}}, "output": {"path": f"{tmp_path}/after"}}
    assert chain.run(spark, {"calc": calc, "clean": clean, "after": after}, marks).status == {"clean": "reused", "calc": "failed", "after": "blocked"}


def test_validation_codes():
    problems = plans.validate({"sources": {}, "steps": [{"op": "nope"}, {"op": "filter", "expression": "[a"}, {"op": "join", "right": "x"}, {"op": "pivot"}], "output": {"a": 1}})
    assert {p[0] for p in problems} == {"E_SOURCES", "E_OPERATION", "E_EXPRESSION", "E_REFERENCE", "E_PARAMETER", "E_OUTPUT"}
    assert "pivot" in plans.capabilities()["operations"]


def test_schedules():
    cron = chain.Cron("*/15 6-7 * * 1-5")
    assert cron.matches(dt.datetime(2024, 5, 1, 6, 45)) and not cron.matches(dt.datetime(2024, 5, 4, 6, 45))
    now = dt.datetime(2024, 5, 1, 9, 0)
    state = {"a": dt.datetime(2024, 5, 1, 5), "b": dt.datetime(2024, 5, 1, 5)}
    made = chain.tick({"a": {"cron": cron.text}, "b": {"cron": cron.text, "misfire": "catch_up_once"}}, state, now)
    assert made == [("b", dt.datetime(2024, 5, 1, 7, 45))] and state["a"] == now


def test_stream_takes_each_file_once(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
        streaming.process_new_files(spark, f"{tmp_path}/src", df.schema, lambda x: x.selectExpr("id * 2 AS id"), f"{tmp_path}/dst", f"{tmp_path}/state")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/dst").collect()) == [2, 2, 4, 4]


def test_assertions_hold_at_their_step_and_on_staged_files(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, None), (3, "")], "id long, p string").write.parquet(f"{tmp_path}/in")
    source = {"in": {"paths": [f"{tmp_path}/in"]}}

    def document(first, last, **output):
        steps = [{"op": "data_assertion", "rules": first}, {"op": "filter", "sql": "id < 3"}, {"op": "add_calc", "expressions": {"twice": "id * 2"}}, {"op": "data_assertion", "rules": last}]
        return {"sources": source, "steps": steps, "output": {"path": f"{tmp_path}/out"} | output}

    plans.run(spark, document([{"kind": "row_count", "min": 3}], [{"kind": "range", "column": "twice", "max": 4}, {"kind": "row_count", "max": 2}], partition="p"))
    for bad in (document([{"kind": "row_count", "max": 2}], []), document([], [{"kind": "row_count", "min": 3}]), document([], [{"kind": "not_null", "columns": ["p"]}], partition="p")):
        with pytest.raises(quality.AssertionFailed):
            plans.run(spark, bad)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    assert not [p.name for p in tmp_path.iterdir() if ".stage-" in p.name or ".backup-" in p.name]
    assert plans.run(spark, document([], []), smoke=1)["previous"]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_receipts_compare_rows_not_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"a b%{i % 2}", {"k": i}) for i in range(10)], "id long, p string, m map<string,int>").coalesce(1)
    sinks.commit(df, f"{tmp_path}/out", "p", order=["id"])
    parts = sinks.read_manifest(spark, f"{tmp_path}/out")["parts"]
    assert sorted(v["rows"] for v in parts.values()) == [5, 5] and all(v["bytes"] > 0 for v in parts.values())
    first = sorted(v["content"] for v in parts.values())
    sinks.commit(df.orderBy(F.desc("id")).coalesce(1), f"{tmp_path}/out", "p")
    assert sorted(v["content"] for v in sinks.read_manifest(spark, f"{tmp_path}/out")["parts"].values()) == first


def test_http_source_of_a_definition(spark):
    def fetch(url, params):
        return {"json": b'{"items": [{"a": 1}, {"a": 2}]}', "ndjson": b'{"a": 1}\n{"a": 2}\n'}[url]

    for kind in ("json", "ndjson"):
        source = {"url": kind, "format": kind, "item_path": "items"}
        assert [r.a for r in http.read_source(spark, source, fetch).collect()] == ["1", "2"]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("x.csv", "a,b\n1,2\n")
    assert [(r.a, r.file_name) for r in http.read_source(spark, {"url": "u", "format": "zip"}, lambda u, p: packed.getvalue()).collect()] == [("1", "x.csv")]
    with pytest.raises(ValueError):
        http.fetch_url("file:///etc/hosts")
    with pytest.raises(ValueError):
        http.read_source(spark, {"url": "u", "format": "nope"}, fetch)
