import pytest

from millrace import export_sql, page_sql, run_sql
from millrace.operators.access import ROLES_DDL
from millrace.plans.adhoc import clean_query, page_after
from tests.conftest import SMALL, rows

ORDERS = {"orders": f"{SMALL}/orders.parquet"}


@pytest.mark.parametrize("text", [
    "SELECT 1 AS x", "SELECT 1 AS x;", "SELECT 1 AS x ;\n ; ", "SELECT 1 AS x -- one\n",
    "SELECT 1 AS x /* one */ ;", "-- first\nSELECT 1 AS x;", "SELECT 1 AS x -- ;",
])
def test_trailers_and_comments(spark, text):
    assert rows(run_sql(spark, text)) == [(1,)]


def test_text_that_looks_like_a_comment_stays(spark):
    assert rows(run_sql(spark, "SELECT '--a' AS x, ';' AS y;")) == [("--a", ";")]
    assert clean_query("SELECT ';'") == "SELECT ';'"


def test_pages_tile_the_result(spark):
    seen, page = [], 0
    while True:
        got = page_sql(spark, "SELECT o_orderkey FROM orders", page=page, page_size=400,
                       order_by="o_orderkey", views=ORDERS)
        seen += got.table["o_orderkey"].to_pylist()
        page += 1
        if not got.has_more:
            break
    assert seen == sorted(seen) and len(seen) == 1500 and page == 4
    assert got.total_rows == -1


def test_page_edges(spark):
    text = "SELECT * FROM range(0, 50)"
    first = page_sql(spark, text, count_total=True)
    assert (first.table.num_rows, first.has_more, first.total_rows) == (50, False, 50)
    assert page_sql(spark, "SELECT * FROM range(0, 51)").has_more
    assert page_sql(spark, text, page=1).table.num_rows == 0


def test_files_in_sql(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,y\n")
    text = f"""SELECT a.v, 'read_csv(''no'')' AS t FROM read_csv('{tmp_path}/a.csv') a
               JOIN READ_CSV_AUTO( '{tmp_path}/a.csv' ) b ON a.k = b.k"""
    assert rows(run_sql(spark, text)) == [("x", "read_csv('no')"), ("y", "read_csv('no')")]


def test_export(spark, tmp_path):
    out = str(tmp_path / "out")
    assert export_sql(spark, "SELECT * FROM orders WHERE o_orderstatus = 'F';", out, views=ORDERS) == \
        spark.read.parquet(out).count() > 0


def test_scope_is_checked_before_anything_is_read(spark):
    roles = spark.createDataFrame([("r", [], ["s3://open/"], [])], ROLES_DDL)
    text = "SELECT * FROM read_parquet('S3://shut/a') JOIN read_parquet('s3://open/b') USING (k)"
    with pytest.raises(PermissionError, match="Access denied to: S3://shut/a$"):
        run_sql(spark, text, roles=roles, role="r")


@pytest.mark.parametrize("text, expected", [
    ("SELECT CAST(2.5D AS INT), CAST(3.5D AS INT)", (2, 3)),
    ("SELECT try_divide(1, 0), 7 div 2", (None, 3)),
    ("SELECT substr('abc', 0, 2), array(1, 2)[0]", ("ab", 1)),
    ("SELECT typeof(date_trunc('day', TIMESTAMP_NTZ '2024-01-01 05:00:00')), "
     "typeof(CAST('2024-01-01' AS TIMESTAMP))", ("timestamp", "timestamp_ntz")),
    ("SELECT dayofweek(DATE '2024-01-07'), weekday(DATE '2024-01-07')", (1, 6)),
    ("SELECT typeof(sum(CAST(1 AS INT))), typeof(avg(1)) FROM range(1)", ("bigint", "double")),
    ("SELECT typeof(n), n FROM (SELECT row_number() OVER (ORDER BY id) AS n FROM range(1))",
     ("int", 1)),
    ("SELECT max_by(x, y) FROM VALUES (NULL, 2), (1, 1) AS t(x, y)", (None,)),
    ("SELECT CAST('nan' AS DOUBLE) = CAST('nan' AS DOUBLE), CAST('nan' AS DOUBLE) > 1e300",
     (True, True)),
    ("SELECT x FROM VALUES (1), (NULL) AS t(x) ORDER BY x LIMIT 1", (None,)),
])
def test_dialect_as_documented(spark, text, expected):
    assert tuple(run_sql(spark, text).first()) == expected


@pytest.mark.parametrize("text", ["SELECT 1 / 0", "SELECT CAST('x' AS INT)"])
def test_ansi_errors(spark, text):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|CAST_INVALID_INPUT"):
        run_sql(spark, text).collect()


def test_file_calls_in_comments_are_not_read(spark):
    text = "SELECT 1 AS v -- FROM read_csv('/no/such.csv')\n/* read_parquet('/none')\n */ WHERE '--' = '--'"
    assert rows(run_sql(spark, text)) == [(1,)]


def test_file_functions_take_lists_and_options(spark, tmp_path):
    (tmp_path / "a.txt").write_text("k;v\n1;x\n")
    (tmp_path / "b.txt").write_text("k;v\n2;NIL\n")
    text = f"SELECT * FROM read_csv(['{tmp_path}/a.txt', '{tmp_path}/b.txt'], delim = ';', nullstr := 'NIL')"
    assert rows(run_sql(spark, text)) == [(1, "x"), (2, None)]
    with pytest.raises(ValueError, match="does not know"):
        run_sql(spark, f"SELECT * FROM read_csv('{tmp_path}/a.txt', teeth = 3)")


def test_scope_covers_datasets_and_views(spark):
    roles = spark.createDataFrame([("r", [], ["s3://open/"], [])], ROLES_DDL)
    saved = {"shut_set": {"config": {"path": ["s3://open/a", "s3n://shut/b"]}}}
    for context in ({"datasets": saved}, {"views": {"shut_set": "s3a://shut/b"}}):
        with pytest.raises(PermissionError, match="shut/b"):
            run_sql(spark, "SELECT * FROM shut_set", roles=roles, role="r", **context)
    with pytest.raises(ValueError, match="roles table"):
        run_sql(spark, "SELECT 1", role="r")


def test_pages_by_key(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate([None, None, 1, 1, 2])], "k long, i long")
    seen, last = [], None
    while page := rows(page_after(df, ["k", "i"], last, 2)):
        seen += page
        last = page[-1]
    assert seen == rows(df)
