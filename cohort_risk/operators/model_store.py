"""Versions of a trained model in one folder.

``versions/<name>`` holds a whole saved model and is never written again; an empty
file ``current/<generation>-<name>`` makes it the current one. A pointer appears in
one step and only after its version is complete, so a reader finds the old model or
the new one, and a reader that has loaded a version keeps it, whatever is published
meanwhile. Two retrains at once publish two versions; the one with the larger
(generation, name) is current for every reader."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from . import model as M


@dataclass(frozen=True)
class Version:
    name: str
    path: str
    generation: int


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[Version]:
    """All published versions, oldest first."""
    root = root.rstrip("/")
    folder, fs = _fs(spark, f"{root}/current")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    found = [name.split("-", 1) for name in names if name[:1].isdigit()]
    return [Version(name, f"{root}/versions/{name}", int(generation)) for generation, name in sorted(found)]


def publish(spark: SparkSession, result: M.TrainResult, root: str) -> Version:
    """Save a model as a new version and make it current."""
    root, name = root.rstrip("/"), f"{result.model_type}-{uuid.uuid4().hex[:12]}"
    result.model.write().save(f"{root}/versions/{name}")
    generation = max((v.generation for v in versions(spark, root)), default=0) + 1
    pointer, fs = _fs(spark, f"{root}/current/{generation:010d}-{name}")
    fs.mkdirs(pointer.getParent())
    fs.createNewFile(pointer)
    return Version(name, f"{root}/versions/{name}", generation)


def current(spark: SparkSession, root: str) -> Version | None:
    found = versions(spark, root)
    return found[-1] if found else None


def load(spark: SparkSession, root: str, version: Version | None = None) -> tuple[PipelineModel, Version]:
    """The model of ``version``, or of the version current now, and which one it is."""
    version = version or current(spark, root)
    if version is None:
        raise FileNotFoundError(f"no model has been published at {root}")
    return M.load(version.path), version


def retrain(spark: SparkSession, root: str, training: DataFrame, model_type: str = M.DEFAULT_MODEL) -> tuple[M.TrainResult, Version]:
    """Train on the rows at hand whatever is published, and publish: the held-out
    accuracy of the new model is in the result."""
    result, _ = M.train(training, model_type)
    return result, publish(spark, result, root)


def load_or_train(spark: SparkSession, root: str, training: DataFrame, model_type: str = M.DEFAULT_MODEL) -> tuple[PipelineModel, Version]:
    """The current model, or a first one trained on ``training``. A current model of
    another type is an error."""
    if current(spark, root) is None:
        result, version = retrain(spark, root, training, model_type)
        return result.model, version
    model, version = load(spark, root)
    if M.model_type_of(model) != model_type:
        raise ValueError(f"the current model at {root} is {M.model_type_of(model)}, not {model_type}")
    return model, version
