"""Pages at any offset against the sorted rows."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.plans.adhoc import page_sql
from millrace.plans.paging import page_at


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(3)
    made = [(rng.choice([None, 1, 2, 2, 2, 7]), rng.choice([None, "", "b", "ü"]),
             rng.choice([None, 0.5, float("nan"), -1.0]), n) for n in range(3000)]
    path = str(tmp_path_factory.mktemp("pages") / "t")
    spark.createDataFrame(made, "a int, `b.c` string, d double, n long").withColumn(
        "day", F.expr("timestamp_ntz'2031-01-01' + make_interval(0, 0, 0, int(n % 7)) + make_dt_interval(0, 0, 0, n / 1e6)")
    ).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("order, descending", [
    (["a", "b.c", "n"], ()), (["a", "n"], ("a",)), (["d", "n"], ("d", "n")), (["day", "n"], ("day",)), (["d", "day"], ()),
])
@pytest.mark.parametrize("offset", [0, 1490, 2990, 3005])
def test_pages_are_those_of_the_whole_sort(table, order, descending, offset):
    keys = [F.desc(f"`{name}`") if name in descending else F.asc(f"`{name}`") for name in order]
    wanted = [row["n"] for row in table.orderBy(*keys).offset(offset).limit(25).collect()]
    found = page_at(table, order, offset, 25, descending=descending, window_rows=40, ranges=8)
    assert [row["n"] for row in found.collect()] == wanted and found.columns == table.columns


def test_ties_are_cut_and_pages_cover_all_rows(spark):
    rows = spark.range(900).selectExpr("1 AS a", "id AS n", "map(id, id) AS m")
    pages = [page_at(rows, ["a"], at, 300, window_rows=50) for at in (0, 300, 600)]
    assert sorted(row["n"] for page in pages for row in page.collect()) == list(range(900))


def test_a_deep_page_sorts_one_range(table):
    found = page_at(table, ["n"], 2000, 10, window_rows=40, ranges=16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(n," in plan and "LessThanOrEqual(n," in plan


def test_page_sql_and_limits(spark, table):
    page = page_sql(spark.newSession(), "SELECT id FROM range(1000)", page=3, page_size=10, order_by="id")
    assert page.table.column("id").to_pylist() == list(range(30, 40)) and page.has_more
    assert page_at(table.limit(0), ["n"], 10**6, 5, window_rows=10).count() == 0
    with pytest.raises(ValueError):
        page_at(table, ["n"], -1, 5)
