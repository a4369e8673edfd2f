"""Declarative batch pipelines, checks and table reports as Spark jobs.

A spec (plain dict) names a source, an ordered list of steps, data-quality
checks and one sink; everything in between is one lazy DataFrame plan.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster needs
# no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from millrace.errors import CheckFailure, PipelineError, PluginError, SinkError, SpecError  # noqa: E402
from millrace.plans.adhoc import export_sql, page_sql, run_sql  # noqa: E402
from millrace.plans.runner import RunResult, run_pipeline  # noqa: E402
from millrace.spec import PipelineSpec  # noqa: E402
from millrace.streaming.incremental import run_incremental  # noqa: E402

__all__ = [
    "CheckFailure",
    "PipelineError",
    "PipelineSpec",
    "PluginError",
    "RunResult",
    "SinkError",
    "SpecError",
    "export_sql",
    "page_sql",
    "run_incremental",
    "run_pipeline",
    "run_sql",
]
