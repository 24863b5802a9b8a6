import datetime as dt
import math

import pytest

from lakeloom.expr import ExpressionError, layers, parse
from lakeloom.expr.compiler import add_expressions, condition
from lakeloom.expr.parser import tokenize


@pytest.fixture(scope="module")
def frame(spark):
    rows = [
        (1, "a", 1.5, 4, "abc-1", [1, 2], dt.datetime(2024, 12, 30, 1, 2, 3, 456000), dt.date(2024, 12, 30)),
        (2, "a", None, 0, " x ", [], dt.datetime(2025, 1, 2), dt.date(2025, 1, 2)),
        (3, "b", -2.0, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "id long, g string, x double, n int, s string, v array<int>, ts timestamp_ntz, d date")


def values(df, text, order=("id",)):
    return [r.out for r in add_expressions(df, {"out": text}, order).orderBy("id").collect()]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("[x] / 0", [math.inf, None, -math.inf]),
        ("[x] / [n]", [0.375, None, None]),
        ("1 + 2 * 3 - -1", [8, 8, 8]),
        ("'it''s' & \"\"", ["it's"] * 3),
        ("[s] & 'z'", ["abc-1z", " x z", None]),
        ("not ([x] > 0) or null", [None, None, True]),
        ("[s] ~= '%'", [False, False, None]),
        ("Mod([x], 0) = Mod(0, 0)", [True, None, True]),
        ("Trim([s])", ["abc-1", "x", None]),
        ("Len([s])", [5, 3, None]),
        ("Right([s], 2)", ["-1", "x ", None]),
        ("Right([s], 0)", ["", "", None]),
        ("Mid([s], 2, -1)", [None, None, None]),
        ("Find('-', [s])", [4, 0, None]),
        ("Find('-', [s], 0)", [None, None, None]),
        ("RxExtract([s], '([a-z]+)-')", ["abc", None, None]),
        ("RxReplace([s], '[a-z]', '.')", ["...-1", " . ", None]),
        ("Ln(0) < -1e300", [True] * 3),
        ("Round(2.5)", [3.0] * 3),
        ("Round(-2.5)", [-3.0] * 3),
        ("Percent([n], 0)", [None] * 3),
        ("YearAndWeek([ts])", ["2025-01", "2025-01", None]),
        ("IsoYear([d])", [2025, 2025, None]),
        ("DayOfWeek([d])", [1, 4, None]),
        ("Millisecond([ts])", [456, 0, None]),
        ("DateDiff('day', [ts], ParseDateTime('2024-12-29', '%Y-%m-%d'))", [-1, -4, None]),
        ("DateAdd('day', 1, [d])", [dt.date(2024, 12, 31), dt.date(2025, 1, 3), None]),
        ("FiscalYear([d], 12)", [2023, 2024, None]),
        ("TotalHours(TimeSpan(1, 2, 0, 0, 0))", [26.0] * 3),
        ("ListSum([v])", [3.0, None, None]),
        ("ListCount([v])", [2, 0, None]),
        ("[v] + [v]", [[2, 4], [], None]),
        ("[v] * 2.0", [[2.0, 4.0], [], None]),
        ("Cast([s] as Integer)", [None, None, None]),
        ("Cast('2024-02-30' as Date)", [None, None, None]),
        ("CASE WHEN [n] > 1 THEN 'many' WHEN [n] = 0 THEN 'none' END", ["many", "none", None]),
        ("If([n] > 1, 1, 2)", [1, 2, 2]),
        ("SN([n], -1)", [4, 0, -1]),
        ("Base64Decode(Base64Encode('é'))", ["é"] * 3),
        ("Split('a.b.c', '.', 2)", ["b"] * 3),
        ("Split('a.b', '.', 3)", [None] * 3),
        ("Sum([x]) OVER ([g])", [1.5, 1.5, -2.0]),
        ("Count([x]) OVER ([g])", [1, 1, 1]),
        ("Sum([n])", [4.0, 4.0, 4.0]),
        ("Lag([id]) OVER ([g], ORDER BY [id])", [None, 1, None]),
        ("LastValidBefore([x]) OVER ([g], ORDER BY [id])", [1.5, 1.5, -2.0]),
        ("MostCommon([s]) OVER ([g])", ["abc-1", "abc-1", None]),
        ("GeometricMean([x]) OVER ([g])", [1.5, 1.5, None]),
        ("Var([x]) OVER ([g])", [None, None, None]),
        ("NthLargest([id], 2) OVER ([g])", [1.0, 1.0, None]),
        ("RowNumber() OVER ([g], ORDER BY [x] DESC NULLS FIRST)", [2, 1, 1]),
        ("DenseRank([x], 'desc')", [1.0, None, 2.0]),
    ],
)
def test_values(frame, text, expected):
    got = values(frame, text)
    assert [pytest.approx(g) if isinstance(g, float) and math.isfinite(g) else g for g in got] == expected


@pytest.mark.parametrize("text", ["[x", "1 +", "Today()", "Foo(1)", "Cast(1 as Nothing)", "CASE END", "[x] + [s]", "[zz]", "RowNumber()", "RollingSum([x], 2)", "'a' 'b'", "DateAdd('month', 1, [d])"])
def test_errors(frame, text):
    with pytest.raises(ExpressionError):
        add_expressions(frame, {"out": text})


def test_list_lengths_must_match(frame):
    with pytest.raises(Exception, match="differ in length"):
        add_expressions(frame, {"w": "Split('a,b,c', ',')", "out": "[v] + [u]", "u": "If([id] = 1, [v], [v])"}).collect()
        add_expressions(frame.selectExpr("v", "array(1) AS u"), {"out": "[v] + [u]"}).collect()


def test_overflow_and_bad_numbers_raise(frame):
    for text in ("9223372036854775807 + [id]", "ParseReal(' 1')", "ParseReal('x')"):
        with pytest.raises(Exception):  # noqa: B017
            add_expressions(frame, {"out": text}).collect()


def test_layers_and_cycles():
    assert layers({"c": parse("[b]"), "a": parse("1"), "b": parse("[a]")}) == [["a"], ["b"], ["c"]]
    with pytest.raises(ExpressionError):
        layers({"a": parse("[b]"), "b": parse("[a]")})


def test_brackets_quotes_and_comments():
    assert [t.text for t in tokenize("[a]]b] // rest\n + 'x''y'")][:3] == ["a]b", "+", "x'y"]


def test_filter_keeps_columns(frame):
    out = condition(frame, "Max([id]) OVER ([g]) = [id]", ["id"])
    assert out.columns == frame.columns
    assert sorted(r.id for r in out.collect()) == [2, 3]


def test_random_numbers_do_not_depend_on_partitions(frame):
    text = {"r": "RandBetween(1, 1000, 5)"}
    a, b = (sorted((r.id, r.r) for r in add_expressions(df, text, ["id"]).collect()) for df in (frame, frame.repartition(3)))
    assert a == b


def test_names_casts_and_windows_without_brackets(frame):
    assert values(frame, "x * 2") == values(frame, "[x] * 2")
    assert values(frame, "Sum(n) OVER (PARTITION BY g)") == [4.0, 4.0, None]
    assert parse("not a = b") == parse("(not [a]) = [b]")
    assert values(frame, "Cast(n as bigint)") == [4, 0, None] and values(frame, "Cast('x' as double)") == [None] * 3
    for wrong in ("Sum(n) OVER (g n)", "RowNumber() OVER (ORDER BY n NULLS foo)", "Sum(n) OVER (PARTITION BY)", "and", "1 over", "double(n)"):
        with pytest.raises(ExpressionError):
            values(frame, wrong)
    with pytest.raises(ExpressionError, match="parentheses"):
        values(frame, "not [x] > 0")


def test_numbers_beyond_64_bits(frame):
    assert values(frame, "Floor([x] * 1e20)") == [1.5e20, None, -2e20]
    assert all(math.isnan(v) for v in values(frame, "Ceiling(Mod(1, 0))")) and all(math.isnan(v) for v in values(frame, "Round(Mod(1, 0))"))
    assert values(frame, "Round(1e20)") == [1e20] * 3 and values(frame, "Ceiling(1e300)") == [1e300] * 3
    assert values(frame, "TotalDays(TimeSpan(9000000000000, 0, 0, 0, 0))") == [None] * 3


def test_statistics_are_one_aggregation(frame):
    out = add_expressions(frame, {"a": "Median([x]) OVER ([g])", "b": "Q1([x]) OVER ([g])", "c": "LIF([x]) OVER ([g])", "d": "Sum([x]) OVER ([g])", "e": "IQR([x]) OVER ([g])"})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.count("percentile(") == 1 and "Window" not in plan
