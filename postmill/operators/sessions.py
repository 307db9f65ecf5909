"""Recognition sessions of model packages: options within bounds, both models made once a worker, greedy decoding."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession

from postmill.sources.packages import character_list, model_packages

#: Least, greatest and default of each option.
THREADS, BATCH = (1, 8, 4), (1, 32, 8)
#: Bytes of a model that are sent to workers at most.
MOST_BYTES = 500_000_000


def option(value: object, bounds: tuple[int, int, int]) -> int:
    """A whole number within bounds; the default for what is no finite number."""
    least, most, default = bounds
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        return default
    return int(min(most, max(least, value)))


def greedy(scores: np.ndarray, characters: list[str]) -> list[tuple[str, float]]:
    """Text and score of each sample of (samples, steps, classes): the likeliest class of a step counts where it is
    no blank and differs from the step before; the score is the mean of the steps whose class has a character."""
    if scores.ndim != 3:
        raise ValueError(f"RECOGNITION_OUTPUT_SHAPE: {scores.shape}")
    best = scores.argmax(axis=2)
    fresh = np.ones_like(best, bool)
    fresh[:, 1:] = best[:, 1:] != best[:, :-1]
    kept = fresh & (best > 0) & (best <= len(characters))
    heights = scores.max(axis=2)
    return [("".join(characters[c - 1] for c in row[k].tolist()), float(h[k].mean(dtype=float)) if k.any() else 0.0) for row, k, h in zip(best, kept, heights, strict=True)]


class OnnxSession:
    """Detection and recognition models under one runtime."""

    def __init__(self, detection: bytes, recognition: bytes, characters: list[str], threads: object = None, batch: object = None) -> None:
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = option(threads, THREADS)
        options.graph_optimization_level = onnxruntime.GraphOptimizationLevel.ORT_ENABLE_ALL
        self.batch, self.characters = option(batch, BATCH), characters
        self.models = [onnxruntime.InferenceSession(m, options, providers=["CPUExecutionProvider"]) for m in (detection, recognition)]

    def _run(self, which: int, planes: np.ndarray) -> np.ndarray:
        model = self.models[which]
        return model.run([model.get_outputs()[0].name], {model.get_inputs()[0].name: np.ascontiguousarray(planes, np.float32)})[0]

    def detect(self, planes: np.ndarray) -> np.ndarray:
        found = self._run(0, planes[None])
        return found.reshape(found.shape[-2:])

    def recognise(self, batch: np.ndarray) -> list[tuple[str, float]]:
        return greedy(self._run(1, batch), self.characters)

    def close(self) -> None:
        self.models = []


def onnx_sessions(spark: SparkSession, detection: str, recognition: str, threads: object = None, batch: object = None) -> Callable[[], OnnxSession]:
    """What vision.recognise() makes its sessions with: the models of two packages, read by Spark and broadcast.

    Packages are single files of a few MB; one beyond MOST_BYTES is an error. The name tells sessions apart that
    a worker made from different packages or with different options.
    """
    found = [model_packages(spark, path).first() for path in (detection, recognition)]
    for row, path in zip(found, (detection, recognition), strict=True):
        if row is None or row.error:
            raise ValueError(f"{row.error if row else 'MODEL_PACKAGE_NOT_FOUND'}: {path}")
        if len(row.model) > MOST_BYTES:
            raise ValueError(f"MODEL_TOO_LARGE: {path}")
    models = [bytes(row.model) for row in found]
    parts = spark.sparkContext.broadcast((*models, character_list(found[1].settings)))

    def session() -> OnnxSession:
        return OnnxSession(*parts.value, threads, batch)

    session.name = hashlib.sha256(b"".join(hashlib.sha256(x).digest() for x in (*models, found[1].settings.encode())) + repr((threads, batch)).encode()).hexdigest()
    return session
