"""Sources, sinks, datasets and definitions: each query writes to a scratch folder and reads back."""

from pyspark.sql import functions as F

from .. import incremental, plans, publish, sinks
from ..operators import facts, joins, project, reshape, rows
from ..scratch import folder
from ..sources import files
from . import register, rounded, table


@register("read_csv_casts", "SELECT c_custkey, nullif(c_name, '') AS c_name, round(c_acctbal, 6) AS c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer")
def read_csv_casts(spark, sf_dir):
    at = folder(spark, "csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.option("header", "true").csv(at)
    parts = files.discover(spark, [at], "*.csv")
    read = files.read_csv(spark, parts, null_values=("", "BUILDING"), casts={"int64": ["c_custkey"], "float64": ["c_acctbal"], "string": ["c_name", "c_mktsegment"]})
    return rounded(read.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))


@register("csv_provenance", "SELECT count(*) AS n, 1::BIGINT AS named, 0::BIGINT AS unnamed FROM supplier")
def csv_provenance(spark, sf_dir):
    at = folder(spark, "csv")
    table(spark, sf_dir, "supplier").coalesce(1).write.option("header", "true").csv(at)
    df = files.read_csv(spark, files.discover(spark, [at], "*.csv"))
    return df.agg(F.count("*").alias("n"), F.count_distinct("file_name").alias("named"), F.count_if(F.col("source_modified_at").isNull()).alias("unnamed"))


@register("parquet_union_by_name", "SELECT n_nationkey AS k, n_name, NULL::VARCHAR AS r_name FROM nation UNION ALL SELECT r_regionkey, NULL, r_name FROM region")
def parquet_union_by_name(spark, sf_dir):
    at = folder(spark, "union")
    table(spark, sf_dir, "nation").selectExpr("n_nationkey AS k", "n_name").write.parquet(f"{at}/a")
    table(spark, sf_dir, "region").selectExpr("r_regionkey AS k", "r_name").write.parquet(f"{at}/b")
    return files.read_parquet_union(spark, files.discover(spark, [at])).select("k", "n_name", "r_name")


@register("join_column_policy", "SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_column_policy(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return joins.join(orders, table(spark, sf_dir, "customer"), {"o_custkey": "c_custkey"}, "left", regex="^c_n", exclude_regex="segment$", exclude=["c_acctbal"])


@register("multi_join_steps", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def multi_join_steps(spark, sf_dir):
    steps = [
        {"right": table(spark, sf_dir, "nation"), "keys": {"c_nationkey": "n_nationkey"}, "how": "left"},
        {"right": table(spark, sf_dir, "region"), "keys": {"n_regionkey": "r_regionkey"}, "how": "left"},
    ]
    return joins.multi_join(table(spark, sf_dir, "customer"), steps).select("c_custkey", "n_name", "r_name")


@register("column_aliases", "SELECT s_suppkey AS supplier, s_name AS name FROM supplier")
def column_aliases(spark, sf_dir):
    df = table(spark, sf_dir, "supplier")
    found = project.resolve_aliases(["supplier", "name", "missing"], df.columns, {"supplier": ["sup_key", "s_suppkey"], "name": ["s_name", "s_nationkey"]})
    return df.select(*[F.col(c).alias(n) for n, c in found.items()])


@register("calculated_fact", "SELECT c_custkey, n_name || '/' || c_mktsegment AS place, round(c_acctbal * 2, 6) AS twice FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def calculated_fact(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    lookups = {"nat": {"frame": table(spark, sf_dir, "nation"), "keys": {"c_nationkey": "n_nationkey"}}}
    out = facts.calculated_fact(df, {"place": "[nat.n_name] & '/' & [segment]", "twice": "[balance] * 2"}, lookups, {"segment": "c_mktsegment", "balance": "c_acctbal"})
    return rounded(out.select("c_custkey", "place", "twice"))


@register(
    "pivot_unique_concatenate",
    """WITH f AS (SELECT o_custkey, o_orderstatus AS s, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY ALL)
    SELECT o_custkey, coalesce(string_agg(p, ',' ORDER BY k) FILTER (s = 'F'), '') AS F__o_orderpriority, coalesce(string_agg(p, ',' ORDER BY k) FILTER (s = 'O'), '') AS O__o_orderpriority FROM f GROUP BY o_custkey""",
)
def pivot_unique_concatenate(spark, sf_dir):
    return reshape.pivot(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderstatus"], [{"name": "o_orderpriority", "agg": "unique_concatenate"}], ["o_orderkey"], column_values=["F", "O"])


@register("pivot_text_numbers", "SELECT o_custkey, min(o_orderkey)::VARCHAR AS lo, max(o_orderkey)::VARCHAR AS hi FROM orders GROUP BY 1")
def pivot_text_numbers(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_custkey", F.lit("x").alias("all"), F.col("o_orderkey").cast("string").alias("key"), "o_orderkey")
    plain = [{"name": "key", "agg": "min", "as": "lo"}, {"name": "key", "agg": "max", "as": "hi"}]
    return reshape.pivot(df, ["o_custkey"], ["all"], [], ["o_orderkey"], plain, column_values=[])


@register("preview_rows", "SELECT 20::BIGINT AS n")
def preview_rows(spark, sf_dir):
    return rows.preview(table(spark, sf_dir, "orders"), 20).agg(F.count("*").alias("n"))


@register("write_dataset", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def write_dataset(spark, sf_dir):
    at = folder(spark, "dataset")
    sinks.commit(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), at, "o_orderstatus", order=["o_orderkey"])
    return spark.read.parquet(at).select("o_orderkey", "o_custkey", "o_orderstatus")


@register("manifest_receipt", "SELECT count(DISTINCT o_orderstatus) AS parts, 1::BIGINT AS removed, count(DISTINCT o_orderstatus) - 1 AS unchanged FROM orders")
def manifest_receipt(spark, sf_dir):
    at = folder(spark, "dataset")
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").repartition(1)
    sinks.commit(df, at, "o_orderstatus", order=["o_orderkey"])
    first = sinks.read_manifest(spark, at)
    content = {p.split("/")[0]: v["content"] for p, v in first["parts"].items()}
    sinks.commit(df.filter("o_orderstatus <> 'P'"), at, "o_orderstatus", order=["o_orderkey"])
    second = {p.split("/")[0]: v["content"] for p, v in sinks.read_manifest(spark, at)["parts"].items()}
    same = sum(content.get(p) == c for p, c in second.items())
    return spark.createDataFrame([(len(content), len(set(content) - set(second)), same)], "parts long, removed long, unchanged long")


@register("segments_replace", "SELECT c_custkey, c_mktsegment AS segment_id FROM customer WHERE c_mktsegment <> 'MACHINERY' AND (c_mktsegment <> 'BUILDING' OR c_acctbal > 0)")
def segments_replace(spark, sf_dir):
    at, df = folder(spark, "segments"), table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    for name in sorted(r[0] for r in df.select("c_mktsegment").distinct().collect()):
        sinks.write_segment(df.filter(F.col("c_mktsegment") == name).select("c_custkey"), at, name)
    sinks.write_segment(df.filter("c_mktsegment = 'BUILDING' AND c_acctbal > 0").select("c_custkey"), at, "BUILDING")
    sinks.drop_segments(spark, at, ["MACHINERY"])
    return spark.read.parquet(at).select("c_custkey", F.col("segment_id").cast("string").alias("segment_id"))


@register("segment_delta", "SELECT 'delta' AS mode, 'b,d' AS process, 'c' AS remove UNION ALL SELECT 'unchanged', '', '' UNION ALL SELECT 'full', 'a,b,d', 'c' UNION ALL SELECT 'initial', 'a,b,d', ''")
def segment_delta(spark, sf_dir):
    now, old = {"a": "1", "b": "2", "d": "4"}, {"a": "1", "b": "0", "c": "3"}
    found = [incremental.plan(now, {"contract": c, "parts": p} if p is not None else None, "x") for c, p in (("x", old), ("x", now), ("y", old), ("", None))]
    return spark.createDataFrame([(d.mode, ",".join(d.process), ",".join(d.remove)) for d in found], "mode string, process string, remove string")


@register("snapshot_file", "SELECT r_regionkey, r_name FROM region")
def snapshot_file(spark, sf_dir):
    at = folder(spark, "snapshot")
    sinks.write_snapshot(table(spark, sf_dir, "region"), at)
    return spark.read.parquet(at)


@register("key_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def key_lookup(spark, sf_dir):
    root, index = folder(spark, "rows"), folder(spark, "index")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").write.parquet(root)
    publish.build_key_index(spark, root, ["o_custkey"], index)
    first = spark.read.parquet(root).agg(F.min("o_custkey")).first()[0]
    return publish.lookup(spark, root, index, {"o_custkey": first})


@register("publish_generations", "SELECT n_nationkey, n_name, 2::BIGINT AS generations FROM nation WHERE n_regionkey = 1")
def publish_generations(spark, sf_dir):
    root, target, df = folder(spark, "root"), folder(spark, "target"), table(spark, sf_dir, "nation")
    sinks.commit(df, root)
    first = publish.publish(spark, root, target)["generation"]
    sinks.commit(df.filter("n_regionkey = 1"), root)
    publish.publish(spark, root, target, first)
    return publish.read(spark, target).select("n_nationkey", "n_name", F.lit(len({first, publish.current(spark, target)})).cast("long").alias("generations"))


@register("lookup_file", "SELECT n_nationkey, n_name FROM nation")
def lookup_file(spark, sf_dir):
    return files.read_lookup(spark, f"{sf_dir}/nation.parquet", ["n_nationkey", "n_name"])


@register("labels_select", "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation")
def labels_select(spark, sf_dir):
    catalog = [{"path": f"{sf_dir}/{t}.parquet", "labels": {"kind": k}} for t, k in (("region", "geo"), ("nation", "geo"), ("part", "goods"))]
    chosen = files.select_labels(catalog, {"kind": ["geo"]})
    parts = [spark.read.parquet(p) for p in chosen]
    return joins.union_by_name([p.select(F.col(next(c for c in p.columns if c.endswith("_name"))).alias("name")) for p in parts])


@register("definition_windows", "SELECT o_orderkey, o_totalprice > 100000 AS large FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-02-01'")
def definition_windows(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("lakeloom_windowed")
    sql = "SELECT * FROM lakeloom_windowed WHERE o_orderstatus = :status AND o_orderdate >= CAST(:date_from AS TIMESTAMP_NTZ) AND o_orderdate < CAST(:date_to AS TIMESTAMP_NTZ)"
    source = {"windows": {"sql": sql, "start": "1995-01-01", "end": "1995-02-01", "step": "7d", "adapter": "spark_sql", "sub_jobs": [{"status": "F"}, {"status": "O"}]}}
    return plans.plan(spark, {"sources": {"w": source}, "steps": [{"op": "calculated_fact", "expressions": {"large": "price > 100000"}, "aliases": {"price": "o_totalprice"}}, {"op": "include_columns", "columns": ["o_orderkey", "large"]}]})


@register("definition_run", "SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0")
def definition_run(spark, sf_dir):
    at = folder(spark, "run")
    rules = [{"kind": "not_null", "columns": ["c_custkey"]}, {"kind": "unique", "columns": ["c_custkey"]}]
    steps = [{"op": "data_assertion", "rules": [{"kind": "not_null", "columns": ["c_mktsegment"]}]}, {"op": "filter", "sql": "c_acctbal > 0"}, {"op": "include_columns", "columns": ["c_custkey", "c_nationkey"]}, {"op": "data_assertion", "rules": rules}]
    plans.run(spark, {"sources": {"c": {"paths": [f"{sf_dir}/customer.parquet"]}}, "steps": steps, "output": {"path": at}})
    return spark.read.parquet(at)
