import pytest

from millrace.errors import SpecError
from millrace.spec import PipelineSpec, parse_size


def load(**changes):
    return PipelineSpec.load({"name": "p", "source_path": "a", "sink_path": "b", **changes})


def test_minimal_spec_has_a_file_source():
    spec = load()
    assert spec.source_type == "file"
    assert spec.source_config == {"path": "a"}
    assert spec.timezone == "UTC"


@pytest.mark.parametrize("changes", [
    {"name": "Bad"},
    {"name": "1st"},
    {"source_path": None},
    {"sink_path": "out.csv"},
    {"sink_path": "out/x.NDJSON"},
    {"sink_format": "orc"},
    {"timezone": "localtime"},
    {"timezone": "Mars/Base"},
    {"threads": 0},
    {"row_group_size": 0},
    {"target_file_size": "200 gigabytes"},
    {"overwrite": "partitions"},
    {"single_file": True, "partition_by": "x"},
    {"transforms": [{"type": "sort", "columns": ["a"]}]},
    {"transforms": [{"type": "filter"}]},
    {"transforms": [{"type": "join", "right_path": "r", "join_type": "cross", "on": "1=1"}]},
    {"transforms": [{"type": "join", "join_type": "inner", "on": "1=1"}]},
    {"transforms": [{"type": "python", "function": "Bad Name"}]},
    {"transforms": [{"type": "python", "function": "f", "chunk_rows": -1}]},
    {"checks": [{"type": "row_count_min", "value": 0}]},
    {"checks": [{"type": "freshness", "column": "a"}]},
    {"alerts": {"on_failure": "email"}},
    {"alerts": {"on_failure": "none", "on_row_count_below": 0}},
])
def test_bad_specs_are_refused(changes):
    with pytest.raises(SpecError):
        load(**changes)


@pytest.mark.parametrize("text, size", [
    ("200MB", 200_000_000), ("1 gb", 10**9), ("30KB", 30_000), ("1.5kb", 1500), ("7B", 7),
    ("2TB", 2 * 10**12),
])
def test_sizes(text, size):
    assert parse_size(text) == size


def test_target_size_is_kept_and_blank_means_unset():
    assert load(target_file_size="200MB").target_file_size == "200MB"
    assert load(target_file_size=" ").target_file_size is None
