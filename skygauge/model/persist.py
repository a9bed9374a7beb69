"""Writers and readers for stages that carry tables or other models, beside their Spark ML parameters."""

from __future__ import annotations

import os

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame


class PartsWriter(MLWriter):
    """Parameters as Spark ML metadata, tables as Parquet and inner models by their own writers, side by side below the path."""

    def __init__(self, stage: "Parts"):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        s = self.stage
        parts = {"tables": sorted(s.tables), "models": {k: f"{type(m).__module__}.{type(m).__name__}" for k, m in s.models.items()}}
        DefaultParamsWriter.saveMetadata(s, path, self.sparkSession, extraMetadata=parts)
        for name, table in s.tables.items():
            table.write.parquet(os.path.join(path, "tables", name))
        for name, model in s.models.items():
            model.write().save(os.path.join(path, "models", name))


class PartsReader(MLReader):
    def __init__(self, kind: type["Parts"]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> "Parts":
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark, f"{self.kind.__module__}.{self.kind.__name__}")
        stage = self.kind()
        stage._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(stage, meta)
        stage.tables = {n: spark.read.parquet(os.path.join(path, "tables", n)) for n in meta["tables"]}
        stage.models = {n: DefaultParamsReader.loadParamsInstance(os.path.join(path, "models", n), spark) if "pyspark." not in kind
                        else _kind(kind).load(os.path.join(path, "models", n)) for n, kind in meta["models"].items()}
        return stage


def _kind(name: str) -> type:
    module, _, cls = name.rpartition(".")
    return getattr(__import__(module, fromlist=[cls]), cls)


class Parts(Model, MLWritable, MLReadable):
    """A fitted stage made of parameters, small fitted tables and inner models; saved and loaded as a whole."""

    def __init__(self, tables: dict[str, DataFrame] | None = None, models: dict[str, Model] | None = None):
        super().__init__()
        self.tables = tables or {}
        self.models = models or {}

    def write(self) -> MLWriter:
        return PartsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return PartsReader(cls)
