"""Joins without a key equality, in tiles: every pair once, for all types, without loops."""

import itertools
import random

import pytest
from tests.conftest import rows

from millrace.operators.steps import apply_step
from millrace.operators.tiles import Bound, bound_of, theta_join_step


@pytest.mark.parametrize("text, want", [
    ("left.a <= right.b", Bound("left", "left.a", "right.b")),
    ("right.b + 1 >= abs(left.a)", Bound("left", "abs(left.a)", "right.b + 1")),
    ("left.a > right.`x > y`", Bound("right", "right.`x > y`", "left.a")),
    ("left.a <= right.b + left.c", None), ("left.a <> right.b", None), ("left.a < 3", None),
    ("(left.a < right.b) = true", None), ("left.a || '<' < right.s", Bound("left", "left.a || '<'", "right.s")),
    ("abs(left.a - right.b) < 2", None), ("'left.a' < right.b", None),
])
def test_bounds(text, want):
    assert bound_of(text) == want


def _tables(spark):
    r = random.Random(2)
    left = [(i, r.choice([None, 5.0, 5.0, 5.0, float("nan"), r.uniform(0, 9)])) for i in range(120)]
    right = [(i, r.choice([None, 5, 5, r.randint(0, 9)])) for i in range(70)]
    ddl = "id long, {} {}"
    return left, right, spark.createDataFrame(left, ddl.format("a", "double")).repartition(3), spark.createDataFrame(
        right, ddl.format("b", "int"))


def _plain(left, right, holds, how):
    nan = float("nan")

    def key(x):
        return float("inf") if x is None or x != x else x

    pairs = [(p, q) for p, q in itertools.product(left, right) if p[1] is not None and q[1] is not None
             and holds(key(p[1]), q[1])]
    out = [(*p, *q) for p, q in pairs]
    if how in ("left", "full"):
        out += [(*p, None, None) for p in left if p not in [x for x, _ in pairs] and (p[1] == p[1] or not any(
            x[0] == p[0] for x, _ in pairs))]
    if how in ("right", "full"):
        met = {q[0] for _, q in pairs}
        out += [(None, None, *q) for q in right if q[0] not in met]
    return sorted(map(str, ((a, "nan" if b is not None and b != b else b, c, d) for a, b, c, d in out)))


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
@pytest.mark.parametrize("on, holds", [
    ("left.a <= right.b", lambda a, b: a <= b), ("right.b + 1 < left.a", lambda a, b: b + 1 < a),
    ("left.a <> right.b AND (left.a > 3 OR right.b < 5)", lambda a, b: a != b and (a > 3 or b < 5)),
])
def test_all_types(spark, how, on, holds):
    left, right, one, two = _tables(spark)
    got = theta_join_step(one, two, on, how, rows=16)
    assert got.columns == ["id", "a", "id_1", "b"]
    found = sorted(str((a, "nan" if b is not None and b != b else b, c, d)) for a, b, c, d in rows(got))
    assert found == _plain(left, right, holds, how)


def test_plan_and_empty_sides(spark, make):
    path = make("right", [(i, i) for i in range(50)], "k int, v int")
    df = spark.range(100).selectExpr("id", "id % 7 AS a")
    step = {"type": "join", "right_path": path, "join_type": "full", "on": "left.a <= right.v", "tile_rows": 10}
    made = apply_step(df, step)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" in plan
    assert made.count() == sum(a % 7 <= v for a in range(100) for v in range(50))
    for one, two in ((df.limit(0), df), (df, df.limit(0)), (df.limit(0), df.limit(0))):
        assert theta_join_step(one, two, "left.a <= right.a", "full").count() == one.count() + two.count()


def test_tiles_outside_the_bound_are_left_out(spark):
    """Of two like columns half the tiles can hold a match; a hot value is spread."""
    from pyspark.sql import functions as F

    from millrace.operators.tiles import COLUMN, ROW, tiled

    df = spark.range(4000).selectExpr("id", "IF(id % 3 = 0, 50, id % 100) AS a")
    one, two = tiled(df, df, ["left.a <= right.a"], 100)
    slices = two.select(COLUMN).distinct().count()
    assert 40 <= slices <= 80 and one.count() < 0.6 * slices * 4000
    tiles = one.groupBy(ROW, COLUMN).agg(F.count("*").alias("n"))
    assert tiles.agg(F.max("n")).first()[0] <= 220
