"""Which outputs are still valid: fingerprints of inputs, configuration and outputs in a JSON sidecar."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import SparkSession


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Hash over number, sizes and times of the files below ``paths`` on any file system; '' where nothing is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            continue
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toUri().getPath(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()[:16] if found else ""


class State:
    """Stages with the fingerprints they were made from. A stage is valid if configuration, inputs and output are unchanged."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)
        self.stages: dict[str, dict] = json.loads(self.path.read_text()) if self.path.exists() else {}

    def valid(self, spark: SparkSession, stage: str, inputs: Mapping[str, str], output: str, config) -> bool:
        known = self.stages.get(stage)
        return bool(known) and known == self._now(spark, inputs, output, config) and known["output"] != ""

    def start(self, stage: str, downstream=()) -> None:
        """The stage and what depends on it are invalid from now on."""
        for s in (stage, *downstream):
            self.stages.pop(s, None)
        self._save()

    def finish(self, spark: SparkSession, stage: str, inputs: Mapping[str, str], output: str, config) -> None:
        self.stages[stage] = self._now(spark, inputs, output, config)
        self._save()

    def _now(self, spark, inputs, output, config) -> dict:
        return {
            "inputs": {k: fingerprint(spark, v) for k, v in sorted(inputs.items())},
            "output": fingerprint(spark, output),
            "config": hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16],
        }

    def _save(self) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps(self.stages, indent=2, sort_keys=True))
