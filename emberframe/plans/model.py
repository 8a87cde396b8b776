"""Scores of gradient-boosted trees read from their text form, as an Arrow-batched function of columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    default_left: np.ndarray
    missing: np.ndarray


@dataclass
class Forest:
    """Trees over named features; the probability is the logistic function of the sum of leaves."""

    features: list[str]
    trees: list[Tree] = field(default_factory=list)
    sigmoid: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            if not len(t.feature):
                total += t.leaf[0]
                continue
            node = np.zeros(len(x), dtype=np.int64)
            while (inner := node >= 0).any():
                at = node[inner]
                v = x[inner, t.feature[at]]
                # the kind of missing value: 0 none (NaN counts as 0), 1 zero, 2 NaN
                v = np.where(np.isnan(v) & (t.missing[at] != 2), 0.0, v)
                absent = np.where(t.missing[at] == 1, np.abs(v) <= 1e-35, np.isnan(v))
                go_left = np.where(absent & (t.missing[at] > 0), t.default_left[at], v <= t.threshold[at])
                node[inner] = np.where(go_left, t.left[at], t.right[at])
            total += t.leaf[~node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.sigmoid * self.raw(x)))


def parse_forest(text: str) -> Forest:
    """Read the text form: a head with feature_names, then a block of name=value lines per tree. Numerical splits only."""
    head, *blocks = text.split("\nTree=")
    pairs = lambda s: dict(line.split("=", 1) for line in s.splitlines() if "=" in line)
    top = pairs(head)
    objective = top.get("objective", "")
    scale = next((float(p.split(":")[1]) for p in objective.split() if p.startswith("sigmoid:")), 1.0)
    forest = Forest(top["feature_names"].split(), sigmoid=scale)
    for block in blocks:
        p = pairs("number=" + block)
        ints = lambda name: np.array(p.get(name, "").split(), dtype=np.int64)  # noqa: B023, E731
        kind = ints("decision_type")
        if (kind & 1).any():
            raise ValueError("categorical splits are not supported")
        forest.trees.append(
            Tree(
                ints("split_feature"), np.array(p.get("threshold", "").split(), dtype=float), ints("left_child"),
                ints("right_child"), np.array(p["leaf_value"].split(), dtype=float), (kind >> 1) & 1 == 1,
                (kind >> 2) & 3
            )
        )
    return forest


@lru_cache(maxsize=4)
def _read(text: str) -> Forest:
    """The forest of a text; a worker that is used again reads a model once."""
    return parse_forest(text)


def probability(model: str, columns: list[str]) -> Column:
    """Probability of each row by the model's text. Features without a column, and values that are missing or not finite,
    count as 0; numbers are in single precision. The text travels with the function (as a broadcast, if it is large) and is
    parsed once per worker; it is parsed here too, so that a text that is no model fails at once."""
    forest = _read(model)
    names = [c for c in forest.features if c in columns]
    if not names:
        return F.lit(float(forest.probability(np.zeros((1, len(forest.features))))[0]))

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        own = _read(model)
        at = [own.features.index(n) for n in names]
        for batch in batches:
            x = np.zeros((len(batch), len(own.features)))
            x[:, at] = batch[names].to_numpy(dtype=np.float32, na_value=np.nan)
            yield pd.Series(own.probability(np.where(np.isfinite(x), x, 0.0)))

    return predict(F.struct(*[F.col(n).cast("float").alias(n) for n in names]))
