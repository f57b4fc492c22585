"""Trained artifacts as one JSON document: action grid, slot memory, feature statistics, kernel, networks.

Written and read through Spark, so any file system serves. An artifact holds a few networks and a small table of centres;
its size does not depend on the data.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession

from tidemark.operators.neighborhood import Kernel

Layers = list[tuple[np.ndarray, np.ndarray]]


@dataclass
class Artifact:
    """What an online policy needs: budgets by level, centres and priors of the slots, statistics, kernel, networks by name."""

    budgets: list[int]
    centres: np.ndarray
    priors: np.ndarray
    temperature: float = 0.35
    spec: dict[str, object] = field(default_factory=dict)
    kernel: Kernel = field(default_factory=Kernel)
    networks: dict[str, Layers] = field(default_factory=dict)


_KERNEL = ("numeric", "categorical", "binary", "temperature", "least_weight", "top_k", "same_zone", "same_kind")


def write_artifact(spark: SparkSession, artifact: Artifact, path: str) -> None:
    """One JSON text under ``path``; what is there is replaced."""
    document = {
        "budgets": artifact.budgets, "centres": artifact.centres.tolist(), "priors": artifact.priors.tolist(), "temperature": artifact.temperature, "spec": artifact.spec,
        "kernel": {k: getattr(artifact.kernel, k) for k in _KERNEL}, "networks": {n: [(w.tolist(), b.tolist()) for w, b in layers] for n, layers in artifact.networks.items()},
    }
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_artifact(spark: SparkSession, path: str) -> Artifact:
    """An artifact; a missing part is an error that names it."""
    (row,) = spark.read.text(path, wholetext=True).collect()  # one document
    found = json.loads(row["value"])
    missing = [k for k in ("budgets", "centres", "priors", "temperature", "spec", "kernel", "networks") if k not in found]
    if missing:
        raise ValueError(f"the artifact lacks {', '.join(missing)}")
    pairs = {k: tuple((n, w) for n, w in found["kernel"][k]) for k in ("numeric", "categorical", "binary")}
    return Artifact(
        found["budgets"], np.array(found["centres"]), np.array(found["priors"]), found["temperature"], found["spec"], Kernel(**{**found["kernel"], **pairs}),
        {n: [(np.array(w), np.array(b)) for w, b in layers] for n, layers in found["networks"].items()},
    )
