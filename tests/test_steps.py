import pytest

from millrace.operators.joins import (
    clash_names, condition_keys, conjuncts, equality_keys, join_step, range_bounds, range_join_step, rewrite_prefixes,
)
from millrace.operators.steps import (
    aggregate_step, apply_step, apply_steps, filter_step, must_cut, select_step,
)
from tests.conftest import rows


@pytest.fixture
def left(spark):
    return spark.createDataFrame(
        [("red", 1, 0.5), ("red", 2, 1.5), ("blue", 1, 4.0), ("red", 3, 1.0)],
        "line string, stop long, km double")


def test_a_chain_is_one_plan(left, make):
    """Two joins around an aggregation: each stop with the stop before it."""
    lines = make("lines.parquet", [("red", 1, 4), ("red", 2, 9), ("red", 3, 2), ("blue", 1, 1)],
                 "line string, stop long, riders long")
    df = apply_steps(left.select("line", "stop"), [
        {"type": "join", "right_path": lines, "join_type": "left",
         "on": "left.line = right.line AND left.stop = right.stop"},
        {"type": "select", "columns": ["line", "stop", "riders", "stop - 1 AS before"]},
        {"type": "join", "right_path": lines, "join_type": "left",
         "on": "left.line = right.line AND left.before = right.stop"},
        {"type": "aggregate", "group_by": ["line"],
         "aggregates": ["max(riders - riders_1) AS best", "count(riders_1) AS pairs"]},
    ])
    assert rows(df) == [("blue", None, 0), ("red", 5, 2)]


def test_select_expressions(left):
    df = select_step(left, ["*", "km * 2 AS both_ways",
                            "sum(km) OVER (PARTITION BY line ORDER BY stop) AS so_far"])
    assert rows(df, "line", "stop")[-1] == ("red", 3, 1.0, 2.0, 3.0)
    assert rows(select_step(left, ["DISTINCT line"])) == [("blue",), ("red",)]


def test_filter_has_three_valued_logic(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x long")
    assert rows(filter_step(df, "x NOT IN (3)")) == [(1,)]
    assert rows(filter_step(df, "x IN (SELECT 3)")) == [(3,)]


def test_aggregate_groups_null_and_allows_no_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 4)], "k string, v long")
    assert rows(aggregate_step(df, ["k"], ["sum(v) AS s"])) == [(None, 3), ("a", 4)]
    assert rows(aggregate_step(df, [], ["sum(v) AS s", "count(*) AS n"])) == [(7, 3)]
    assert df.schema["v"].dataType == aggregate_step(df, [], ["sum(v) AS s"]).schema["s"].dataType


def test_step_views_do_not_stay(spark, left):
    before = {t.name for t in spark.catalog.listTables()}
    select_step(left, ["km"]).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_prefix_rewriting_leaves_names_and_text_alone():
    assert rewrite_prefixes("left.a = right.b") == "left_tbl.a = right_tbl.b"
    assert rewrite_prefixes("LEFT.a=1 and x = 'left.b'") == "left_tbl.a=1 and x = 'left.b'"
    assert rewrite_prefixes("tbl_left.x = right.`left.y`") == "tbl_left.x = right_tbl.`left.y`"


def test_equality_keys():
    assert equality_keys("left.a = right.b") == (["a"], ["b"])
    assert equality_keys("right.b = left.a AND left.c = right.d") == (["a", "c"], ["b", "d"])
    assert equality_keys("left.a <= right.b") is None
    assert equality_keys("left.a = left.b") is None
    assert equality_keys("left.a = right.b or left.c = right.d") is None
    assert equality_keys("left.a = right.b + 1") is None


def test_clash_names():
    assert clash_names(["id", "x"], ["id", "X", "y"]) == ["id_1", "X_1", "y"]
    assert clash_names(["id", "id_1"], ["id"]) == ["id_2"]



SHAPES = [
    ("left.k = right.k", True), ("left.k = right.k", False),
    ("left.k = right.k AND left.t = right.t", False), ("left.k >= right.k AND right.v > 11", False),
    ("left.k = right.k AND right.v > 11", False), ("right.v <> 12 AND left.k = right.k", True),
    ("left.`k` = right.`k` AND (left.t = right.t OR right.v = 99)", False),
    ("left.k = right.k AND right.v BETWEEN 11 AND 20 AND left.t <> 'and'", False),
    ("left.`k` = right.k", False), ("left.k = right.k OR right.v = 12", False),
]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("on, small", SHAPES)
def test_join_shapes_equal_the_plain_join(spark, how, on, small):
    """Keys hot on the left (4), on the right (6), on both (9), and without a match
    (5, 3); missing keys on both sides."""
    left = [(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "d"), (6, "a"), (7, None)]
    left += [(9, "h")] * 40 + [(4, "x")] * 35 + [(5, "lone")] * 30
    right = [(1, 10, "a"), (1, 11, "z"), (2, 12, "c"), (None, 13, "d"), (4, 14, "x"), (7, 1, None)]
    right += [(9, 99, "h")] * 30 + [(6, 2, "a")] * 45 + [(3, 0, "lone")] * 30
    l = spark.createDataFrame(left, "k long, t string").repartition(3)
    r = spark.createDataFrame(right, "k long, v long, t string").repartition(3)
    shaped = join_step(l, r, on, how, right_is_small=small, hot_rows=8)
    plain = join_step(l, r, on, how, skew_safe=False)
    assert shaped.columns == ["k", "t", "k_1", "v", "t_1"]
    assert rows(shaped) == rows(plain)


def test_names_with_dots_and_quotes(spark):
    left = spark.createDataFrame([(1, "a")] * 12 + [(2, "b"), (None, "c")], "`a.b` long, `x``y` string")
    right = spark.createDataFrame([(1, 5)] * 11 + [(3, 6), (None, 7)], "`a.b` long, v long")
    for how in ("left", "right", "full"):
        for on in ("left.`a.b` = right.`a.b`", "left.`a.b` = right.`a.b` AND right.v < 9"):
            shaped = join_step(left, right, on, how, hot_rows=4)
            plain = join_step(left, right, on, how, skew_safe=False)
            assert sorted(map(str, shaped.collect())) == sorted(map(str, plain.collect()))


def test_conjuncts_and_keys():
    assert len(conjuncts("left.a BETWEEN 1 AND 2 AND (left.b = 1 AND right.c = 2) AND left.d = 'x and y'")) == 3
    assert conjuncts("left.a = right.a AND left.b = 1 OR left.c = 2") == ["left.a = right.a AND left.b = 1 OR left.c = 2"]
    assert len(conjuncts("left.end = right.end AND CASE WHEN left.a AND left.b THEN 1 END = 1")) == 2
    assert equality_keys("left.a = right.b and right.`x y` = left.c") == (["a", "c"], ["b", "x y"])
    assert equality_keys("left.a = right.b AND left.c > 1") is None
    assert condition_keys("left.a = right.b AND left.c > 1") == (["a"], ["b"], True)


JOIN = {"type": "join", "right_path": "r", "on": "left.k = right.k"}


@pytest.mark.parametrize("how, before, cut", [
    ("full", [], False),
    ("right", [{"type": "filter", "condition": "k > 1"}], False),
    ("right", [{"type": "select", "columns": ["k", "upper(v) AS v"]}], False),
    ("full", [{"type": "filter", "condition": "rand() < 0.5"}], True),
    ("full", [{"type": "select", "columns": ["row_number() OVER (ORDER BY k) AS k"]}], True),
    ("right", [{"type": "aggregate", "group_by": ["k"], "aggregates": ["count(*) AS n"]}], True),
    ("full", [{**JOIN, "join_type": "inner"}], True),
    ("left", [{**JOIN, "join_type": "full"}], False),
    ("inner", [{"type": "python", "function": "f"}], False),
])
def test_left_sides_that_are_written_before_they_are_read_twice(how, before, cut):
    assert must_cut({**JOIN, "join_type": how}, before) is cut


def test_a_cut_left_side_gives_the_same_rows(spark, left, make):
    path = make("r.parquet", [("red", 7), ("pink", 8)], "line string, x long")
    step = {"type": "join", "right_path": path, "on": "left.line = right.line"}
    df = apply_steps(left, [
        {"type": "aggregate", "group_by": ["line"], "aggregates": ["sum(km) AS s"]},
        {**step, "join_type": "full"}, {**step, "join_type": "right"}])
    assert rows(df, "line_2") == [(None, None, None, None, "pink", 8), ("red", 3.0, "red", 7, "red", 7)]


RANGES = [("a", -5.0, 4.0), ("b", 4.0, 4.0), ("c", 3.5, 17.25), ("d", 9.0, 8.0), ("e", None, 1.0),
          ("f", 100.0, 200.0), ("g", -1e300, 3.0), ("h", 10.0, float("inf")), ("i", 0.0, 1e12)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("width", [0, 1, 1000])
@pytest.mark.parametrize("side", ["left", "right"])
def test_range_join_equals_the_plain_join(spark, how, width, side):
    points = spark.createDataFrame([(i, float(i) / 3) for i in range(-20, 60)] + [(99, None), (99, None)],
                                   "id long, x double")
    ranges = spark.createDataFrame(RANGES + RANGES[:1], "id string, lo double, hi double")
    l, r, other = (points, ranges, "right") if side == "left" else (ranges, points, "left")
    on = f"{side}.x >= {other}.lo AND {side}.x <= {other}.hi"
    binned = range_join_step(l, r, on, how, "x", "lo", "hi", width, side=side)
    plain = join_step(l, r, on, how)
    assert binned.columns == plain.columns and rows(binned) == rows(plain)
    assert "NestedLoop" not in binned._jdf.queryExecution().executedPlan().toString()


def test_intervals_of_one_length_are_one_pass(spark):
    points = spark.range(50).selectExpr("id", "CAST(id AS DOUBLE) AS x")
    ranges = spark.range(0, 40, 4).selectExpr("id AS w", "id * 1.0D AS lo", "id + 4.0D AS hi")
    df = range_join_step(points, ranges, "left.x >= right.lo AND left.x < right.hi", "left", "x", "lo", "hi")
    assert df.count() == 50 and df.where("w IS NULL").count() == 10
    assert "Union" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("on, bounds", [
    ("left.t >= right.a AND left.t < right.b", ("left", "t", "a", "b")),
    ("right.a <= left.t and right.b >= left.t AND left.k <> right.a", ("left", "t", "a", "b")),
    ("left.t BETWEEN right.a AND right.b", ("left", "t", "a", "b")),
    ("right.a BETWEEN left.t AND left.u", ("right", "a", "t", "u")),
    ("left.t >= right.a", None),
    ("left.t >= right.a AND left.u <= right.b", None),
    ("left.k = right.k AND left.t >= right.a AND left.t < right.b", None),
    ("left.t >= right.a OR left.t < right.b", None),
    ("left.k >= right.a AND left.k < right.b", None),
])
def test_bounds_are_read_from_the_condition(spark, on, bounds):
    l = spark.createDataFrame([], "t date, u date, k string")
    r = spark.createDataFrame([], "a timestamp, b date, k string")
    assert range_bounds(on, l, r) == bounds


def test_join_keys_of_different_types(spark):
    l = spark.createDataFrame([(1,), (2,)], "k long")
    r = spark.createDataFrame([(1, "x"), (3, "y")], "k int, v string")
    assert rows(join_step(l, r, "left.k = right.k", "full")) == [
        (None, 3, "y"), (1, 1, "x"), (2, None, None)]


def test_join_right_side_may_be_csv(spark, left, tmp_path):
    path = tmp_path / "crews.csv"
    path.write_text("line;crew\nblue;\"Kim; Ada\"\n")
    df = apply_step(left, {"type": "join", "right_path": str(path), "join_type": "left",
                           "on": "left.line = right.line"})
    assert rows(df.where("km >= 1.5").select("stop", "line_1", "crew"), "stop") == [
        (1, "blue", "Kim; Ada"), (2, None, None)]


def test_step_after_a_clash_can_name_both(left, make):
    right = make("r.parquet", [(3, 10.0), (2, 20.0)], "stop long, km double")
    df = apply_steps(left, [
        {"type": "join", "right_path": right, "join_type": "inner",
         "on": "left.stop = right.stop"},
        {"type": "select", "columns": ["stop_1", "km_1 - km AS rest"]},
    ])
    assert rows(df) == [(2, 18.5), (3, 9.0)]
