"""A table that stream batches upsert by key, rewriting only the partitions of the keys they bring."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class UpsertTable:
    """Rows unique in ``keys``, dealt by their hash into ``parts`` partitions.

    A batch writes new versions of the partitions that its keys fall into and one manifest that says
    which version of each partition counts; both live in the folder, so a restarted query goes on from there. A
    repeated batch starts from the manifest before its own and writes the same again.
    """

    def __init__(self, spark: SparkSession, folder: str, schema, keys: Sequence[str], parts: int = 64):
        self.spark, self.folder, self.schema, self.keys, self.parts = spark, folder.rstrip("/"), schema, list(keys), parts

    def _manifest(self, before: int | None = None) -> dict[int, int]:
        """Version of each partition, from the last manifest below ``before``; a manifest has at most ``parts`` entries."""
        try:
            rows = self.spark.read.schema("batch long, versions string").json(f"{self.folder}/manifest/*")
        except AnalysisException:
            return {}
        last = (rows.filter(F.col("batch") < before) if before is not None else rows).agg(F.max_by("versions", "batch")).first()[0]
        return {int(k): v for k, v in json.loads(last).items()} if last else {}

    def _rows(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/data/batch={v}/_part={p}" for p, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self._manifest())

    def upsert(self, df: DataFrame, batch: int) -> None:
        """Rows of ``df`` replace those of the same key; for ``foreachBatch``."""
        part = F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")
        df = df.select(*[f.name for f in self.schema.fields]).withColumn("_part", part).persist()
        try:
            touched = [r[0] for r in df.select("_part").distinct().collect()]  # at most ``parts``
            if not touched:
                return
            versions = self._manifest(before=batch)
            old = self._rows({p: v for p, v in versions.items() if p in touched}).withColumn("_part", part)
            out = old.join(df.select(*self.keys).distinct(), self.keys, "left_anti").select(*df.columns).unionByName(df)
            out.write.mode("overwrite").partitionBy("_part").parquet(f"{self.folder}/data/batch={batch}")
            now = json.dumps(versions | {p: batch for p in touched})
            self.spark.createDataFrame([(batch, now)], "batch long, versions string").coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest/batch={batch}")
        finally:
            df.unpersist()
