"""Operators over whole frames."""

from pyspark.sql import functions as F

from ..operators import joins, project, reshape, rows
from . import register, rounded, table


@register(
    "latest_order_per_customer",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def latest_order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return rows.sort_first(orders, ["o_custkey"], [{"column": "o_orderdate", "direction": "desc"}], [{"column": "o_orderkey", "direction": "desc"}])


@register("filter_three_valued", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE nullif(l_returnflag, 'N') <> 'R' AND l_quantity > 10")
def filter_three_valued(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("flag", F.nullif(F.col("l_returnflag"), F.lit("N")))
    return project.filter_expression(df, "[flag] <> 'R' and [l_quantity] > 10").select("l_orderkey", "l_linenumber")


@register("filter_sql", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'O')")
def filter_sql(spark, sf_dir):
    return project.filter_sql(table(spark, sf_dir, "orders"), "o_totalprice > 100000 AND o_orderstatus IN ('F', 'O')").select("o_orderkey")


@register("filter_thin_tree", "SELECT c_custkey FROM customer WHERE (c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_name LIKE '%9') AND nullif(c_nationkey, 3)::VARCHAR IS DISTINCT FROM '7' AND c_acctbal IS NOT NULL")
def filter_thin_tree(spark, sf_dir):
    df = table(spark, sf_dir, "customer").withColumn("nation", F.nullif(F.col("c_nationkey"), F.lit(3)))
    tree = {"op": "and", "args": [{"op": "or", "args": [{"op": "in", "column": "c_mktsegment", "values": ["BUILDING", "MACHINERY"]}, {"op": "like", "column": "c_name", "value": "%9"}]}, {"op": "ne", "column": "nation", "value": 7}, {"op": "is_not_null", "column": "c_acctbal"}]}
    return project.filter_thin(df, tree).select("c_custkey")


@register("project_columns", "SELECT o_orderkey AS id, o_totalprice::VARCHAR::DOUBLE AS price, NULL::BIGINT AS missing FROM orders")
def project_columns(spark, sf_dir):
    return project.project(table(spark, sf_dir, "orders"), [{"name": "id", "source": "o_orderkey"}, {"name": "price", "source": "o_totalprice", "dtype": "float64"}, {"name": "missing", "allow_missing": True, "dtype": "int64"}])


@register("include_exclude_rename", "SELECT n_nationkey AS key, n_name AS nation_name FROM nation")
def include_exclude_rename(spark, sf_dir):
    df = project.include_columns(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"])
    df = project.exclude_columns(df, ["n_regionkey", "unknown"])
    return project.rename_columns(df, {"n_nationkey": "key"}, [{"pattern": r"n_(.*)", "replacement": r"nation_\1"}])


@register("type_cast", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderdate::DATE AS o_orderdate, o_custkey::INTEGER AS o_custkey FROM orders")
def type_cast(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    return project.type_cast(df, [{"name": "o_orderkey", "type": "string"}, {"name": "o_orderdate", "type": "date"}, {"name": "o_custkey", "type": "INTEGER"}])


@register("grouped_cast", "SELECT r_regionkey::VARCHAR AS r_regionkey, r_name, TIMESTAMP '2024-01-02 03:04:05' AS load_time, 7::BIGINT AS wafer_id FROM region")
def grouped_cast(spark, sf_dir):
    df = table(spark, sf_dir, "region").withColumns({"load_time": F.lit("2024-01-02 03:04:05"), "wafer_id": F.lit("7")})
    return project.grouped_cast(df, {})


@register("reference_replace_segment", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'construction' WHEN 'MACHINERY' THEN 'engines' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def reference_replace_segment(spark, sf_dir):
    lookup = spark.createDataFrame([("BUILDING", "construction"), ("MACHINERY", "engines")], "old string, new string")
    return project.reference_replace(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", lookup, "old", "new")


def _join(name, how, sql):
    @register(name, sql)
    def run(spark, sf_dir):
        # keys five apart: the first of one side and the last of the other have no partner
        nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 5).alias("n_nationkey"), "n_name")
        customer = table(spark, sf_dir, "customer").select(F.nullif(F.col("c_nationkey"), F.lit(8)).alias("n_nationkey"), "c_custkey")
        out = joins.join(nation, customer, ["n_nationkey"], how)
        return out if how != "semi" else out.select("n_nationkey", "n_name")


_LR = "(SELECT n_nationkey + 5 AS n_nationkey, n_name FROM nation) l {how} JOIN (SELECT nullif(c_nationkey, 8) AS k, c_custkey FROM customer) r ON l.n_nationkey = r.k"
for _how in ("inner", "left", "right", "full"):
    _join(f"join_{_how}", _how, "SELECT coalesce(n_nationkey, k) AS n_nationkey, n_name, c_custkey FROM " + _LR.format(how=_how))
_join("join_semi", "semi", "SELECT n_nationkey + 5 AS n_nationkey, n_name FROM nation WHERE n_nationkey + 5 IN (SELECT nullif(c_nationkey, 8) FROM customer)")


@register("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf_dir):
    return joins.join(table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "nation").select("n_name"), how="cross")


@register("join_collision", "SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_name AS n_name_other FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey")
def join_collision(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    other = nation.select(F.col("n_regionkey").alias("n_nationkey"), "n_name", F.lit(1).alias("dropped"))
    return joins.join(nation, other, ["n_nationkey"], suffix="_other", exclude=["dropped"])


@register("join_composite", "SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus FROM lineitem l JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber = 1) k USING (l_orderkey, l_suppkey) JOIN orders o ON o.o_orderkey = l.l_orderkey")
def join_composite(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber")
    firsts = lines.filter("l_linenumber = 1").select("l_orderkey", "l_suppkey").distinct()
    out = joins.multi_join(lines, [{"right": firsts, "keys": ["l_orderkey", "l_suppkey"]}, {"right": table(spark, sf_dir, "orders"), "keys": {"l_orderkey": "o_orderkey"}, "include": ["o_orderstatus"]}])
    return out.select("l_orderkey", "l_linenumber", "o_orderstatus")


@register("lookup_enrich", "SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_enrich(spark, sf_dir):
    return joins.enrich(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation"), {"c_nationkey": "n_nationkey"}, ["n_name", "n_regionkey"]).drop("c_nationkey")


@register("keyspace_union", "SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) WHERE k IS NOT NULL")
def keyspace_union(spark, sf_dir):
    members = [table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))]
    return joins.keyspace(members, ["k"])


@register("union_rows_identity", "SELECT c_nationkey AS nation, c_acctbal AS balance, c_name AS customer, 'customers' AS member FROM customer UNION ALL SELECT s_nationkey, s_acctbal, NULL, 'suppliers' FROM supplier")
def union_rows_identity(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("customer"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return joins.union_rows({"customers": customers, "suppliers": suppliers}, "member")


@register("selection_all_rows", "SELECT r_regionkey, r_name FROM region")
def selection_all_rows(spark, sf_dir):
    return rows.all_rows(table(spark, sf_dir, "region"))


@register("dedupe_per_file", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value NULLS FIRST, file_row) = 1".replace("events QUALIFY", "(SELECT *, event_id AS file_row FROM events) QUALIFY"))
def dedupe_per_file(spark, sf_dir):
    return rows.dedupe_per_file(table(spark, sf_dir, "events"), ["user_id"], ["value", "event_id"]).select("user_id", "event_id")


@register("natural_sort_key", "SELECT s_suppkey, regexp_replace(s_name, '[0-9]+$', '') || lpad(regexp_extract(s_name, '[0-9]+$'), 20, '0') AS k FROM supplier")
def natural_sort_key(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", rows.natural_key(F.col("s_name")).alias("k"))


_V = [{"name": "o_totalprice", "agg": "sum"}]


@register("pivot_status_sum", """SELECT o_custkey, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS F__o_totalprice, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS O__o_totalprice, round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS P__o_totalprice FROM orders GROUP BY 1""")
def pivot_status_sum(spark, sf_dir):
    return rounded(reshape.pivot(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderstatus"], _V, ["o_orderkey"]), 4)


@register("pivot_count_zero", """SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS "n__1-URGENT", count(*) FILTER (o_orderpriority = '5-LOW') AS "n__5-LOW", count(*) AS total FROM orders GROUP BY 1""")
def pivot_count_zero(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return reshape.pivot(df, ["o_custkey"], ["o_orderpriority"], [{"name": "o_orderkey", "agg": "count"}], ["o_orderkey"], [{"name": "o_orderkey", "agg": "count", "as": "total"}], name=("n", "<column_key_value>"), column_values=["1-URGENT", "5-LOW"])


@register("pivot_first_and_null_key", """SELECT o_custkey, arg_min(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'F') AS F__o_orderkey__first, arg_min(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'O') AS O__o_orderkey__first, arg_min(o_orderkey, o_orderkey) FILTER (o_orderstatus = 'P') AS __null____o_orderkey__first FROM orders GROUP BY 1""")
def pivot_first_and_null_key(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return reshape.pivot(df, ["o_custkey"], ["o_orderstatus"], [{"name": "o_orderkey", "agg": "first"}], ["o_orderkey"], name=("<column_key_value>", "<value_key_name>", "<agg>"))


@register("pivot_without_column", """SELECT o_custkey, round(sum(o_totalprice), 4) AS total, min(o_orderdate) AS first_date, max(o_totalprice) AS high, (SELECT string_agg(s, ',' ORDER BY f) FROM (SELECT o_orderstatus AS s, min(o_orderkey) AS f FROM orders i WHERE i.o_custkey = o.o_custkey GROUP BY 1)) AS states FROM orders o GROUP BY 1""")
def pivot_without_column(spark, sf_dir):
    plain = [{"name": "o_totalprice", "agg": "sum", "as": "total"}, {"name": "o_orderdate", "agg": "min", "as": "first_date"}, {"name": "o_totalprice", "agg": "max", "as": "high"}, {"name": "o_orderstatus", "agg": "unique_concatenate", "as": "states"}]
    return rounded(reshape.pivot(table(spark, sf_dir, "orders"), ["o_custkey"], [], [], ["o_orderkey"], plain, column_values=[]), 4)


@register("unpivot_measures", "SELECT l_orderkey, l_linenumber, 'l_quantity' AS name, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem")
def unpivot_measures(spark, sf_dir):
    return reshape.unpivot(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"])


@register("unpivot_coerce", "SELECT s_suppkey, 's_name' AS name, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', nullif(s_nationkey, 3)::VARCHAR FROM supplier WHERE s_nationkey <> 3")
def unpivot_coerce(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").withColumn("s_nationkey", F.nullif(F.col("s_nationkey"), F.lit(3)))
    return reshape.unpivot(df, ["s_suppkey"], ["s_name", "s_nationkey"], coercion="string", preserve_nulls=False)


@register("unpivot_mixed_numbers", "SELECT p_partkey, 'p_size' AS name, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot_mixed_numbers(spark, sf_dir):
    return reshape.unpivot(table(spark, sf_dir, "part"), ["p_partkey"], ["p_size", "p_retailprice"])


@register("unpivot_remaining", "SELECT r_regionkey, 'r_name' AS name, r_name AS value FROM region")
def unpivot_remaining(spark, sf_dir):
    return reshape.unpivot_remaining(table(spark, sf_dir, "region"), ["r_regionkey"], "string")


@register("unnest_embedding", "SELECT vec_id, unnest(embedding) AS embedding FROM embeddings")
def unnest_embedding(spark, sf_dir):
    return reshape.unnest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@register("lists_expand_compact", "SELECT vec_id, embedding FROM embeddings")
def lists_expand_compact(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return reshape.compact_lists(reshape.expand_lists(df, position="at"), df, "vec_id", ["embedding"], "at")


@register(
    "list_restore_lines",
    """WITH s AS (SELECT DISTINCT l_linenumber AS n FROM lineitem), g AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
    SELECT k AS l_orderkey, list(l_quantity ORDER BY n) AS v, list(n ORDER BY n) AS x FROM g CROSS JOIN s LEFT JOIN (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) ON l_orderkey = k AND l_linenumber = n GROUP BY k""",
)
def list_restore_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))
    packed = lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("p"))
    sparse = packed.select("l_orderkey", F.lit("all").alias("g"), F.transform("p", lambda p: p["l_quantity"]).alias("v"), F.transform("p", lambda p: p["l_linenumber"]).alias("x"))
    lookup = lines.select(F.lit("all").alias("g"), F.col("l_linenumber").alias("ord"), F.col("l_linenumber").alias("x")).distinct()
    return reshape.restore_lists(sparse, lookup, "g", ["v"], ["x"], "ord").drop("g")


@register("split_words", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def split_words(spark, sf_dir):
    from ..expr.compiler import add_expressions

    return reshape.unnest(add_expressions(table(spark, sf_dir, "part"), {"word": "Split([p_name], ' ')"}).select("p_partkey", "word"))


@register(
    "long_fact_orders",
    """SELECT o_orderkey, 'o_totalprice' AS fact_name, 'value_float64' AS value_type, o_totalprice AS value_float64, NULL AS value_string FROM orders
    UNION ALL SELECT o_orderkey, 'o_orderstatus', 'value_string', NULL, o_orderstatus FROM orders""",
)
def long_fact_orders(spark, sf_dir):
    return reshape.long_fact(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_totalprice", "o_orderstatus"]).select("o_orderkey", "fact_name", "value_type", "value_float64", "value_string")


_RULES = [
    {"id": "columns", "kind": "required_columns", "columns": ["o_orderkey", "gone"]},
    {"id": "types", "kind": "dtype", "types": {"o_orderkey": "int64", "o_orderstatus": "int64"}},
    {"id": "nulls", "kind": "not_null", "columns": ["o_custkey", "status"]},
    {"id": "key", "kind": "unique", "columns": ["o_orderkey"]},
    {"id": "customers", "kind": "unique", "columns": ["o_custkey", "status"]},
    {"id": "states", "kind": "accepted_values", "column": "status", "values": ["F"]},
    {"id": "prices", "kind": "range", "column": "o_totalprice", "min": 1000, "max": 200000},
    {"id": "rows", "kind": "row_count", "min": 1},
]


@register(
    "assert_quality",
    """WITH t AS (SELECT *, nullif(o_orderstatus, 'P') AS status FROM orders)
    SELECT 'columns' AS rule_id, 'required_columns' AS kind, 1::BIGINT AS failed UNION ALL SELECT 'types', 'dtype', 1 UNION ALL SELECT 'nulls', 'not_null', count(*) FILTER (o_custkey IS NULL OR status IS NULL) FROM t
    UNION ALL SELECT 'key', 'unique', count(*) - count(DISTINCT o_orderkey) FROM t UNION ALL SELECT 'customers', 'unique', (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, status FROM t))
    UNION ALL SELECT 'states', 'accepted_values', count(*) FILTER (status <> 'F') FROM t UNION ALL SELECT 'prices', 'range', count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 200000) FROM t UNION ALL SELECT 'rows', 'row_count', 0""",
)
def assert_quality(spark, sf_dir):
    from .. import quality

    return quality.evaluate(table(spark, sf_dir, "orders").withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P"))), _RULES)


@register("compare_summary", "SELECT count(*) AS row_count, 0::BIGINT AS duplicates, count(*) FILTER (k = 3) AS null_n_name FROM (SELECT n_nationkey AS k FROM nation)")
def compare_summary(spark, sf_dir):
    from .. import compare

    df = table(spark, sf_dir, "nation").withColumn("n_name", F.when(F.col("n_nationkey") != 3, F.col("n_name")))
    return compare.summary(df).select("row_count", "duplicates", "null_n_name")


@register("compare_differences", "SELECT n_nationkey, n_name, n_regionkey, 'left' AS side FROM nation WHERE n_regionkey = 2 UNION ALL SELECT n_nationkey, n_name || '!', n_regionkey, 'right' FROM nation WHERE n_regionkey = 2")
def compare_differences(spark, sf_dir):
    from .. import compare

    nation = table(spark, sf_dir, "nation")
    changed = nation.withColumn("n_name", F.when(F.col("n_regionkey") == 2, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name")))
    return compare.differences(nation, changed)


@register("route_events", "SELECT event_id, 'high' AS route FROM events WHERE value > 50 UNION ALL SELECT event_id, 'clicks' FROM events WHERE event_type = 'click'")
def route_events(spark, sf_dir):
    from .. import sinks

    return sinks.route(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), {"high": "[value] > 50", "clicks": "[event_type] = 'click'"}).select("event_id", "route")


@register("partition_names", """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN '__null__' WHEN o_orderpriority = '2-HIGH' THEN '__empty__' ELSE replace(o_orderpriority || '/x', '/', '_') END AS part FROM orders""")
def partition_names(spark, sf_dir):
    from .. import sinks

    raw = F.when(F.col("o_orderpriority") == "2-HIGH", "").when(F.col("o_orderpriority") != "5-LOW", F.concat("o_orderpriority", F.lit("/x")))
    return table(spark, sf_dir, "orders").select("o_orderkey", sinks.partition_value(raw).alias("part"))


@register("date_window_extract", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-15'")
def date_window_extract(spark, sf_dir):
    import datetime as dt

    from ..sources import windows

    table(spark, sf_dir, "orders").createOrReplaceTempView("lakeloom_orders")
    sql = windows.template_sql("lakeloom_orders", ["o_orderkey", "o_orderdate"], "o_orderdate", ["o_orderstatus = 'F'"]).replace(":date_from", "CAST(:date_from AS TIMESTAMP_NTZ)").replace(":date_to", "CAST(:date_to AS TIMESTAMP_NTZ)")
    return windows.extract(spark, sql, windows.expand("1996-01-01", "1996-03-15", dt.timedelta(days=20), dt.datetime(2024, 1, 1)))


@register(
    "definition_pipeline",
    """WITH l AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
    SELECT o_custkey AS customer, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS size, n_name AS nation FROM l JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P'""",
)
def definition_pipeline(spark, sf_dir):
    from .. import plans

    return plans.plan(
        spark,
        {
            "sources": {name: {"paths": [f"{sf_dir}/{name}.parquet"]} for name in ("orders", "customer", "nation")},
            "steps": [
                {"op": "active_row_selection", "group": ["o_custkey"], "sort": [{"column": "o_orderdate", "direction": "desc"}], "ties": [{"column": "o_orderkey", "direction": "desc"}]},
                {"op": "filter", "expression": "[o_orderstatus] <> 'P'"},
                {"op": "add_calc", "expressions": {"size": "If([o_totalprice] > 200000, 'large', 'small')"}},
                {"op": "join", "right": "customer", "keys": {"o_custkey": "c_custkey"}, "how": "inner", "include": ["c_nationkey"]},
                {"op": "enrich", "lookup": "nation", "keys": {"c_nationkey": "n_nationkey"}, "columns": ["n_name"]},
                {"op": "include_columns", "columns": ["o_custkey", "size", "n_name"]},
                {"op": "rename_columns", "mapping": {"o_custkey": "customer", "n_name": "nation"}},
            ],
        },
    )
