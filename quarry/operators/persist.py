"""Saving and loading of the fitted feature and model stages (M-8).

A stage keeps its fitted state in plain attributes, named in ``SAVED``.  Plain
values go into the stage's metadata as JSON, fitted Spark models and tables
(category tables, k-NN donors) into folders beside it, so a ``PipelineModel``
of such stages is saved and loaded with ``write().save`` and ``load``.
"""

from __future__ import annotations

import importlib

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession


def _put(value, path: str):
    """JSON form of ``value``; models and tables below it are written to ``path``."""
    if isinstance(value, DataFrame):
        value.write.parquet(path)
        return {"kind": "table", "at": path.rsplit("/", 1)[1]}
    if isinstance(value, MLWritable):
        value.write().save(path)
        return {"kind": "model", "at": path.rsplit("/", 1)[1], "class": f"{type(value).__module__}.{type(value).__name__}"}
    if isinstance(value, dict):
        return {"kind": "dict", "items": [[k, _put(v, f"{path}-{i}")] for i, (k, v) in enumerate(value.items())]}
    if isinstance(value, (list, tuple)):
        return {"kind": type(value).__name__, "items": [_put(v, f"{path}-{i}") for i, v in enumerate(value)]}
    return {"kind": "value", "value": value}


def _get(form: dict, folder: str, spark: SparkSession):
    kind = form["kind"]
    if kind == "table":
        return spark.read.parquet(f"{folder}/{form['at']}")
    if kind == "model":
        module, name = form["class"].rsplit(".", 1)
        return getattr(importlib.import_module(module), name).load(f"{folder}/{form['at']}")
    if kind == "dict":
        return {k: _get(v, folder, spark) for k, v in form["items"]}
    if kind in ("list", "tuple"):
        return (list if kind == "list" else tuple)(_get(v, folder, spark) for v in form["items"])
    return form["value"]


class _Writer(MLWriter):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        state = {name: _put(getattr(self.stage, name), f"{path}/{name}") for name in self.stage.SAVED}
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession, extraMetadata={"state": state})


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls(**{name: _get(form, path, self.sparkSession) for name, form in meta["state"].items()})
        return stage._resetUid(meta["uid"])


class Saved(MLWritable, MLReadable):
    """Mixin of fitted stages; ``SAVED`` names the constructor's arguments, kept under the same names."""

    SAVED: tuple = ()

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)
