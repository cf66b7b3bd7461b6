"""Slots for extractors: a model is a factory, loaded once per Python worker; rows go through it in Arrow batches.

``HashExtractor`` stands in for a network in tests: deterministic vectors from the bytes of the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GLOBAL_WIDTH = {"dinosalad": 64 * 128 + 256, "dinov3large": 1024, "dinov3large_gem": 1024}
LOCAL_WIDTH = {"xfeat": 64, "clidd": 128, "sift": 128}
_loaded: dict[str, object] = {}


def loaded(key: str, factory: Callable[[], object]) -> object:
    """The model under ``key``, made on first use in this process."""
    if key not in _loaded:
        _loaded[key] = factory()
    return _loaded[key]


def unload(key: str) -> None:
    """Forget what is under the key, whatever factory made it."""
    for k in [k for k in _loaded if k == key or k.startswith(key + ":")]:
        del _loaded[k]


def model_key(key: str, factory: Callable[[], object]) -> str:
    """The key with a hash of the factory, so that workers that are used again never answer with another model of that name."""
    return f"{key}:{hashlib.md5(cloudpickle.dumps(factory)).hexdigest()}"


class HashExtractor:
    def __init__(self, width: int = 64, keypoints: int = 16) -> None:
        self.width, self.keypoints = width, keypoints

    def _rng(self, content: bytes) -> np.random.Generator:
        return np.random.default_rng(int.from_bytes(hashlib.md5(content).digest()[:8], "little"))

    def describe(self, contents: list[bytes]) -> np.ndarray:
        x = np.stack([self._rng(c).standard_normal(self.width) for c in contents])
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def detect(self, content: bytes) -> pd.DataFrame:
        rng = self._rng(content)
        d = rng.standard_normal((self.keypoints, self.width))
        return pd.DataFrame({"x": rng.uniform(0, 640, self.keypoints), "y": rng.uniform(0, 480, self.keypoints), "score": rng.uniform(0, 1, self.keypoints), "desc": list(d / np.linalg.norm(d, axis=1, keepdims=True))})


def global_descriptors(images: DataFrame, key: str, factory: Callable[[], object], batch: int = 32, content: str = "content", key_col: str = "image_id") -> DataFrame:
    """``(image_id, embedding)`` by ``model.describe(list of bytes)``; images without content are left out."""

    name = model_key(key, factory)

    def run(batches):
        model = loaded(name, factory)
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                some = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"k": some["k"], "embedding": [v.astype(np.float32) for v in model.describe([bytes(c) for c in some["c"]])]})

    return _keyed(images, key_col, content, run, "embedding array<float>")


def local_features(images: DataFrame, key: str, factory: Callable[[], object], most: int | None = None, content: str = "content", key_col: str = "image_id") -> DataFrame:
    """``(image_id, kp_idx, x, y, score, desc)`` by ``model.detect(bytes)``: the ``most`` keypoints of highest score, numbered from it on (all, in
    the order detected, by default); images without content are left out."""

    name = model_key(key, factory)

    def run(batches):
        model = loaded(name, factory)
        for pdf in batches:
            for image, c in zip(pdf["k"], pdf["c"]):
                got = model.detect(bytes(c))
                if not len(got):
                    continue
                if most is not None:
                    got = got.sort_values("score", ascending=False, kind="stable").head(most)
                yield got.assign(k=image, kp_idx=np.arange(len(got)))[["k", "kp_idx", "x", "y", "score", "desc"]]

    return _keyed(images, key_col, content, run, "kp_idx int, x double, y double, score double, desc array<float>")


def _keyed(images: DataFrame, key_col: str, content: str, run, schema: str) -> DataFrame:
    rows = images.select(F.col(key_col).alias("k"), F.col(content).alias("c")).filter("c is not null")
    return rows.mapInPandas(run, f"k {dict(rows.dtypes)['k']}, {schema}").withColumnRenamed("k", key_col)
