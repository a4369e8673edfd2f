"""Step checkpoints of a run, kept under a fingerprint of what produced them."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace import storage
from millrace.spec import PipelineSpec, sql_texts


class StepStore:
    """Finished steps as Parquet folders ``step_<i>`` in the folder that
    ``spark.checkpoint.dir`` names, or else next to the sink, so that a later process
    finds them.

    The folder is named by the source, the steps and the saved datasets they name, so
    an edited pipeline starts afresh; name a plugin anew when its code changes; a change of sink or checks keeps finished steps.
    """

    def __init__(self, spark: SparkSession, spec: PipelineSpec, datasets: dict | None = None):
        self.spark = spark
        parts = [spec.source_type, spec.source_config, spec.transforms]
        fragments = " ".join([json.dumps(parts, default=str), *sql_texts(spec)])
        named = {k: v for k, v in (datasets or {}).items() if k.lower() in fragments.lower()}
        text = json.dumps(parts + [named] * bool(named), sort_keys=True, default=str)
        digest = hashlib.sha256(text.encode()).hexdigest()[:16]
        shared = spark.conf.get("spark.checkpoint.dir", None)
        folder = f"{shared.rstrip('/')}/millrace" if shared else storage.parent_of(spec.sink_path)
        self.root = f"{folder}/_steps-{spec.name}-{digest}"

    def last_finished(self) -> int:
        """Highest complete step by number, or -1."""
        finished = [-1]
        for name, _ in storage.children(self.spark, self.root):
            match = re.fullmatch(r"step_(\d+)", name)
            if match and storage.exists(self.spark, f"{self.root}/{name}/_SUCCESS"):
                finished.append(int(match[1]))
        return max(finished)

    def save(self, index: int, df: DataFrame) -> DataFrame:
        """Write a step and go on from the written data; lineage ends here."""
        attempt = f"{self.root}/_attempt-{uuid.uuid4().hex}"
        df.write.parquet(attempt)
        storage.replace(self.spark, attempt, f"{self.root}/step_{index}")
        return self.load(index, df.schema)

    def load(self, index: int, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.root}/step_{index}")

    def clear(self) -> None:
        storage.delete(self.spark, self.root)
