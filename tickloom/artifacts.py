"""Versioned store of what a training job makes: fitted pipelines, recipes, allocations, settings.

A version is written aside in full, part by part, and then named in one small file that is put in place by a rename. A
reader follows that file, so it never sees a half-written version, and a failed write leaves the version before it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


class Store:
    """Artifacts under one folder that driver and executors can reach (any file system that Hadoop knows)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def _read(self, *parts: str) -> str | None:
        if not self._fs().exists(self._path(*parts)):
            return None
        return "\n".join(r["value"] for r in self.spark.read.text("/".join([self.root, *parts])).collect())

    def _write(self, text: str, *parts: str) -> None:
        out = self._fs().create(self._path(*parts), True)
        out.write(bytearray(text.encode()))
        out.close()

    def publish(
        self, name: str, models: Mapping[str, PipelineModel] | None = None, tables: Mapping[str, DataFrame] | None = None, settings: Mapping | None = None
    ) -> str:
        """Writes a version of all parts and makes it the current one; returns its id.

        Part names are keys of the mappings and may be any text. Tables without columns of their own types are stored
        as they are; an empty table stays an empty table.
        """
        version = f"{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
        parts: dict[str, dict[str, str]] = {"models": {}, "tables": {}}
        for i, (key, model) in enumerate((models or {}).items()):
            parts["models"][key] = f"model-{i}"
            model.write().overwrite().save(f"{self.root}/{name}/{version}/model-{i}")
        for i, (key, table) in enumerate((tables or {}).items()):
            parts["tables"][key] = f"table-{i}"
            table.write.parquet(f"{self.root}/{name}/{version}/table-{i}")
        self._write(json.dumps(parts | {"settings": dict(settings or {}), "version": version}), name, version, "MANIFEST")
        self._point(name, version)
        return version

    def _point(self, name: str, version: str) -> None:
        aside = f"{POINTER}.{uuid.uuid4().hex}"
        self._write(version, name, aside)
        options = self._hadoop.Options.Rename
        overwrite = self.spark.sparkContext._gateway.new_array(options, 1)
        overwrite[0] = options.OVERWRITE
        self._hadoop.FileContext.getFileContext(self._path().toUri(), self._conf).rename(self._path(name, aside), self._path(name, POINTER), overwrite)

    def current(self, name: str) -> str | None:
        """The id of the current version, or None before the first."""
        return self._read(name, POINTER)

    def versions(self, name: str) -> list[str]:
        """Complete versions, oldest first."""
        if not self._fs().exists(self._path(name)):
            return []
        found = [s.getPath().getName() for s in self._fs().listStatus(self._path(name)) if s.isDirectory()]
        return sorted(v for v in found if self._fs().exists(self._path(name, v, "MANIFEST")))

    def restore(self, name: str, version: str) -> None:
        """Makes an earlier complete version the current one."""
        if version not in self.versions(name):
            raise KeyError(f"{name} has no complete version {version}")
        self._point(name, version)

    def _manifest(self, name: str, version: str | None) -> tuple[str, dict]:
        version = version or self.current(name)
        text = version and self._read(name, version, "MANIFEST")
        if not text:
            raise KeyError(f"{name} has no complete version {version or ''}".strip())
        return version, json.loads(text)

    def models(self, name: str, version: str | None = None) -> dict[str, PipelineModel]:
        version, m = self._manifest(name, version)
        return {k: PipelineModel.load(f"{self.root}/{name}/{version}/{part}") for k, part in m["models"].items()}

    def table(self, name: str, key: str, version: str | None = None) -> DataFrame:
        version, m = self._manifest(name, version)
        return self.spark.read.parquet(f"{self.root}/{name}/{version}/{m['tables'][key]}")

    def settings(self, name: str, version: str | None = None) -> dict:
        return self._manifest(name, version)[1]["settings"]


def score_by_regime(models: Mapping[str, PipelineModel], rows: DataFrame, cols: list[str], score, general: str = "general") -> DataFrame:
    """Every row scored by the model of its regime; regimes without one take the general model, averaged in otherwise."""
    base = score(models[general], rows, cols).withColumnRenamed("p_up", "p_general")
    out = None
    for regime in sorted(k for k in models if k != general):
        part = score(models[regime], base.where(F.col("regime") == regime), cols)
        part = part.withColumn("p_up", (F.col("p_up") + F.col("p_general")) / 2)
        out = part if out is None else out.unionByName(part)
    rest = base.where(~F.col("regime").isin([k for k in models if k != general]) | F.col("regime").isNull()).withColumn("p_up", F.col("p_general"))
    return rest if out is None else out.unionByName(rest)
