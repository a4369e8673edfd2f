import glob
import os

import pyarrow.parquet as pq
import pytest

from millrace import PipelineError, run_pipeline
from millrace.operators import sinks
from millrace.operators.sinks import staged_overwrite, write_parquet
from millrace.spec import PipelineSpec
from tests.conftest import rows


@pytest.fixture
def padded(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(7_200).selectExpr("id AS n", "sha2(CAST(id % 90 AS STRING), 512) AS pad").coalesce(1).write.parquet(path)
    return path


def run(spark, source, tmp_path, **changes):
    return run_pipeline(spark, {"name": "sink", "source_path": source,
                                "sink_path": str(tmp_path / "out"), **changes})


def parts(tmp_path):
    return sorted(glob.glob(str(tmp_path / "out" / "**" / "*.parquet"), recursive=True))


def test_sized_sink_writes_several_files(spark, padded, tmp_path):
    run(spark, padded, tmp_path, target_file_size="20KB", row_group_size=450)
    files = parts(tmp_path)
    assert len(files) > 1
    assert sum(pq.ParquetFile(f).metadata.num_rows for f in files) == 7_200
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 7_200


def test_sizing_joins_small_files(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(0, 40_000, 1, 40).selectExpr("id", "md5(CAST(id AS STRING)) AS h").write.parquet(source)
    run(spark, source, tmp_path, target_file_size="500KB")
    sizes = [os.path.getsize(f) for f in parts(tmp_path)]
    assert len(sizes) < 8 and max(sizes) < 750_000
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 40_000


def test_row_groups_have_the_asked_size(spark, padded, tmp_path):
    run(spark, padded, tmp_path, row_group_size=900)
    (path,) = parts(tmp_path)
    meta = pq.ParquetFile(path).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [900] * 8
    assert meta.row_group(0).column(0).compression == "SNAPPY"


def test_compression(spark, padded, tmp_path):
    run(spark, padded, tmp_path, compression="zstd")
    assert pq.ParquetFile(parts(tmp_path)[0]).metadata.row_group(0).column(0).compression == "ZSTD"


def test_single_file_is_a_file(spark, padded, tmp_path, monkeypatch):
    result = run(spark, padded, tmp_path, single_file=True)
    assert (tmp_path / "out").is_file() and result.rows_written == 7_200
    assert pq.ParquetFile(tmp_path / "out").metadata.num_rows == 7_200
    assert sorted(os.listdir(tmp_path)) == [".out.crc", "in", "out"] or sorted(
        os.listdir(tmp_path)) == ["in", "out"]
    monkeypatch.setattr(sinks, "SINGLE_FILE_LIMIT", 10)
    with pytest.raises(PipelineError, match="write a folder instead"):
        run(spark, padded, tmp_path, single_file=True)
    assert pq.ParquetFile(tmp_path / "out").metadata.num_rows == 7_200


def test_partition_folders(spark, make, tmp_path):
    source = make("in", [(1, "X"), (2, "Y"), (3, "X")], "id long, category string")
    assert run(spark, source, tmp_path, partition_by="category").rows_written == 3
    folders = {os.path.basename(p) for p in glob.glob(str(tmp_path / "out" / "category=*"))}
    assert folders == {"category=X", "category=Y"}
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(1, "X"), (2, "Y"), (3, "X")]


def test_partition_overwrite_keeps_other_partitions(spark, make, tmp_path):
    both = make("a", [(1, "X"), (2, "Y")], "id long, category string")
    one = make("b", [(9, "Y")], "id long, category string")
    run(spark, both, tmp_path, partition_by="category")
    run(spark, one, tmp_path, partition_by="category", overwrite="partitions")
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(1, "X"), (9, "Y")]


def test_partition_values_keep_their_type_through_the_checks(spark, make, tmp_path):
    source = make("in", [(1, "01"), (2, "02")], "id long, code string")
    run(spark, source, tmp_path, partition_by="code",
        checks=[{"type": "accepted_values", "column": "code", "values": ["01", "02"]}])


def test_count_of_an_empty_result(spark, padded, tmp_path):
    result = run(spark, padded, tmp_path, transforms=[{"type": "filter", "condition": "n < 0"}])
    assert result.rows_written == 0
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["n", "pad"]


def test_table_format_without_its_data_source(spark, padded, tmp_path):
    with pytest.raises(PipelineError, match="needs its data source"):
        run(spark, padded, tmp_path, sink_format="delta")
    assert not glob.glob(str(tmp_path / "_staging*"))


def test_table_format_is_an_overwrite(spark, make, tmp_path):
    spec = PipelineSpec(name="t", sink_path=str(tmp_path / "t"), partition_by="k", sink_format="orc")
    for value in (1, 2):
        sinks.write_table(spark.createDataFrame([(value, "a")], "v long, k string"), spec)
    assert rows(spark.read.orc(spec.sink_path)) == [(2, "a")]


def test_a_table_can_be_replaced_by_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    assert write_parquet(spark.range(10), path) == 10
    assert staged_overwrite(spark.read.parquet(path).where("id >= 4"), path) == 6
    assert spark.read.parquet(path).count() == 6


def test_empty_partition_values_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, Part string")
    assert write_parquet(df, str(tmp_path / "kept"), partition_by="part") == 2
    assert rows(spark.read.parquet(str(tmp_path / "kept")).select("k", "part")) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="empty texts"):
        write_parquet(df.replace("a", ""), str(tmp_path / "refused"), partition_by="Part")
