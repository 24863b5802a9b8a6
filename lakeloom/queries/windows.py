"""Partition window functions."""

from . import calculated

P = "OVER ([l_returnflag])"
W = "OVER (PARTITION BY l_returnflag)"
Q = "quantile_cont(l_extendedprice, {p}) " + W
KEEP = ["l_orderkey", "l_linenumber"]
HEAD = "SELECT l_orderkey, l_linenumber, "

calculated(
    "win_stats", "lineitem", KEEP,
    {n: f"{f}([l_quantity]) {P}" for n, f in {"s": "Sum", "a": "Avg", "lo": "Min", "hi": "Max", "v": "Var", "sd": "StdDev", "r": "Range", "se": "StdErr", "l95": "L95", "u95": "U95", "g": "GeometricMean", "n": "Count", "u": "UniqueCount"}.items()},
    HEAD + f"""sum(l_quantity) {W} AS s, round(avg(l_quantity) {W}, 6) AS a, min(l_quantity) {W} AS lo, max(l_quantity) {W} AS hi, round(var_samp(l_quantity) {W}, 6) AS v, round(stddev_samp(l_quantity) {W}, 6) AS sd, max(l_quantity) {W} - min(l_quantity) {W} AS r,
    round(stddev_samp(l_quantity) {W} / sqrt(count(l_quantity) {W}), 6) AS se, round(avg(l_quantity) {W} - 1.96 * stddev_samp(l_quantity) {W} / sqrt(count(l_quantity) {W}), 6) AS l95, round(avg(l_quantity) {W} + 1.96 * stddev_samp(l_quantity) {W} / sqrt(count(l_quantity) {W}), 6) AS u95,
    round(exp(avg(ln(l_quantity)) {W}), 6) AS g, count(l_quantity) {W} AS n, count(DISTINCT l_quantity) {W} AS u FROM lineitem""",
)
calculated(
    "win_quantiles", "lineitem", KEEP,
    {"md": f"Median([l_extendedprice]) {P}", "p10": f"P10([l_extendedprice]) {P}", "p90": f"P90([l_extendedprice]) {P}", "q1": f"Q1([l_extendedprice]) {P}", "q3": f"Q3([l_extendedprice]) {P}", "iqr": f"IQR([l_extendedprice]) {P}", "p37": f"Percentile([l_extendedprice], 37) {P}", "bad": f"Percentile([l_extendedprice], 137) {P}"},
    HEAD + ", ".join(f"round({Q.format(p=p)}, 6) AS {n}" for n, p in {"md": 0.5, "p10": 0.1, "p90": 0.9, "q1": 0.25, "q3": 0.75, "p37": 0.37}.items()) + f", round({Q.format(p=0.75)} - {Q.format(p=0.25)}, 6) AS iqr, NULL::DOUBLE AS bad FROM lineitem",
)
_FENCES = f"""WITH b AS (SELECT *, {Q.format(p=0.25)} AS q1, {Q.format(p=0.75)} AS q3, {Q.format(p=0.5)} AS md, avg(l_extendedprice) {W} AS mean, {Q.format(p=0.1)} AS p10, {Q.format(p=0.9)} AS p90 FROM lineitem),
f AS (SELECT *, l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM b) """
calculated(
    "win_fences", "lineitem", KEEP,
    {n: f"{n}([l_extendedprice]) {P}" for n in ("lif", "uif", "lof", "uof", "lav", "uav", "outliers", "pctoutliers")},
    _FENCES + HEAD + f"""round(q1 - 1.5 * (q3 - q1), 6) AS lif, round(q3 + 1.5 * (q3 - q1), 6) AS uif, round(q1 - 3 * (q3 - q1), 6) AS lof, round(q3 + 3 * (q3 - q1), 6) AS uof,
    round(min(CASE WHEN inside THEN l_extendedprice END) {W}, 6) AS lav, round(max(CASE WHEN inside THEN l_extendedprice END) {W}, 6) AS uav, (count(*) FILTER (NOT inside) {W})::DOUBLE AS outliers, round(count(*) FILTER (NOT inside) {W} / count(*) {W}, 6) AS pctoutliers FROM f""",
)
calculated(
    "win_deviations", "lineitem", KEEP,
    {"md": f"MeanDeviation([l_extendedprice]) {P}", "mad": f"MedianAbsoluteDeviation([l_extendedprice]) {P}", "tm": f"TrimmedMean([l_extendedprice], 20) {P}"},
    _FENCES + HEAD + f"round(avg(abs(l_extendedprice - mean)) {W}, 6) AS md, round(quantile_cont(abs(l_extendedprice - md), 0.5) {W}, 6) AS mad, round(avg(CASE WHEN l_extendedprice BETWEEN p10 AND p90 THEN l_extendedprice END) {W}, 6) AS tm FROM f",
)
calculated(
    "win_pairs", "lineitem", KEEP,
    {"cov": f"Covariance([l_quantity], [l_extendedprice]) {P}", "wa": f"WeightedAverage([l_discount], [l_quantity]) {P}"},
    HEAD + f"round(covar_samp(l_quantity, l_extendedprice) {W}, 6) AS cov, round(sum(l_discount * l_quantity) {W} / sum(l_quantity) {W}, 6) AS wa FROM lineitem",
)
calculated(
    "win_product", "nation", ["n_nationkey"],
    {"p": "Product([n_nationkey] + 1) OVER ([n_regionkey])", "whole": "Sum([n_nationkey])"},
    "SELECT n_nationkey, round(product(n_nationkey + 1) OVER (PARTITION BY n_regionkey), 6) AS p, (sum(n_nationkey) OVER ())::DOUBLE AS whole FROM nation",
)
calculated(
    "win_rank_dense", "orders", ["o_orderkey"],
    {"up": "DenseRank([o_totalprice], [o_custkey])", "down": "DenseRank([o_orderpriority], 'desc') OVER ([o_custkey])"},
    "SELECT o_orderkey, (dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice))::DOUBLE AS up, (dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC))::DOUBLE AS down FROM orders",
)
calculated(
    "win_rank_real", "orders", ["o_orderkey"],
    {"r": "RankReal([o_orderpriority]) OVER ([o_custkey])"},
    "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) + (count(*) OVER (PARTITION BY o_custkey, o_orderpriority) - 1) / 2 AS r FROM orders",
)
calculated(
    "win_row_number", "orders", ["o_orderkey"],
    {"n": "RowNumber() OVER ([o_custkey], ORDER BY [o_orderdate] DESC NULLS LAST)"},
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS n FROM orders", ["o_orderkey"],
)
_U = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
_E = "OVER ([user_id], ORDER BY [ts])"
calculated(
    "win_lag_lead", "events", ["event_id"],
    {"a": f"Lag([value]) {_E}", "b": f"Lead([event_type], 2) {_E}", "f": "First([event_type]) OVER ([user_id])", "l": "Last([event_type]) OVER ([user_id])"},
    f"""SELECT event_id, round(lag(value) {_U}, 6) AS a, lead(event_type, 2) {_U} AS b, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS f,
    last_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM events""", ["event_id"],
)
calculated(
    "win_fill", "events", ["event_id"],
    {"v": "If([value] > 20, [value], null)", "back": f"FirstValidAfter([v]) {_E}", "forward": f"LastValidBefore([v]) {_E}"},
    f"""WITH t AS (SELECT *, CASE WHEN value > 20 THEN value END AS v FROM events) SELECT event_id, round(v, 6) AS v,
    round(first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS back,
    round(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS forward FROM t""", ["event_id"],
)
_R = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
calculated(
    "win_rolling", "events", ["event_id"],
    {"a": f"RollingAvg([value], 3) {_E}", "s": f"RollingSum([value], 3, 3) {_E}", "lo": f"RollingMin([value], 3) {_E}", "hi": f"RollingMax([value], 3) {_E}"},
    f"""SELECT event_id, round(avg(value) {_R}, 6) AS a, round(CASE WHEN count(value) {_R} >= 3 THEN sum(value) {_R} END, 6) AS s, round(min(value) {_R}, 6) AS lo, round(max(value) {_R}, 6) AS hi FROM events""", ["event_id"],
)
calculated(
    "win_value_for", "orders", ["o_orderkey"],
    {"hi": "ValueForMax([o_orderkey], [o_orderpriority]) OVER ([o_custkey])", "lo": "ValueForMin([o_orderkey], [o_orderpriority]) OVER ([o_custkey])", "hi2": "LastValueForMax([o_orderkey], [o_orderpriority]) OVER ([o_custkey])", "lo2": "LastValueForMin([o_orderkey], [o_orderpriority]) OVER ([o_custkey])"},
    """WITH t AS (SELECT o_orderkey, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS hi,
    first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS lo FROM orders) SELECT o_orderkey, hi, lo, hi AS hi2, lo AS lo2 FROM t""", ["o_orderkey"],
)
calculated(
    "win_most_common", "orders", ["o_orderkey"],
    {"m": "MostCommon([o_orderpriority]) OVER ([o_custkey])"},
    """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2), m AS (SELECT o_custkey, o_orderpriority FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) = 1)
    SELECT o_orderkey, m.o_orderpriority AS m FROM orders JOIN m USING (o_custkey)""", ["o_orderkey"],
)
calculated(
    "win_unique_concatenate", "orders", ["o_orderkey"],
    {"u": "UniqueConcatenate([o_orderstatus]) OVER ([o_custkey])"},
    """WITH c AS (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS f FROM orders GROUP BY 1, 2), u AS (SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY f) AS u FROM c GROUP BY 1)
    SELECT o_orderkey, u FROM orders JOIN u USING (o_custkey)""", ["o_orderkey"],
)
calculated(
    "win_nth", "orders", ["o_orderkey"],
    {"a": "NthLargest([o_totalprice], 2) OVER ([o_custkey])", "b": "NthSmallest([o_totalprice], 1) OVER ([o_custkey])", "c": "NthSmallest([o_totalprice], 99999) OVER ([o_custkey])"},
    """WITH l AS (SELECT o_custkey, list_sort(list(o_totalprice), 'DESC') AS d FROM orders GROUP BY 1) SELECT o_orderkey, round(d[2], 6) AS a, round(d[-1], 6) AS b, round(d[99999], 6) AS c FROM orders JOIN l USING (o_custkey)""",
)
