"""Readers of encoded grids for SQL: table functions that a query can apply to every row of a table.

After ``register(spark)``:

    SELECT f.scene_id, v.* FROM fields f, LATERAL grib_values(f.content) v
    SELECT s.scene_id, v.* FROM scenes s, LATERAL raster_values(s.content, 'float32', 50, 50) v
    SELECT * FROM raster_values((SELECT content FROM one), 'npy')
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, FloatType, IntegerType, StructType

from emberframe.sources import grib

#: Types of a raster's values by its kind.
KINDS = {"float32": FloatType(), "json": DoubleType(), "npy": DoubleType(), "npz": DoubleType()}
_OPTIONAL = ("category", "parameter", "surface_type", "surface_value")
_GRIB = ", ".join(c for c in grib.VALUES.split(", ") if not c.startswith("path "))


@udtf(returnType=_GRIB)
class GribValues:
    """``grib_values(content)``: one row per grid point of every message of a file's bytes; none for null."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        for k, m in enumerate(grib.read_messages(bytes(content)) if content is not None else []):
            head = tuple(m.get(n) for n in _OPTIONAL)
            for at, value in enumerate(m["values"].tolist()):
                i, j = at % m["nx"], at // m["nx"]
                yield (k, *head, i, j, m["lat"] - j * m["dy"], m["lon"] + i * m["dx"], value)


@udtf
class RasterValues:
    """``raster_values(content, kind, height, width)``: (row, col, value) of a raster's bytes, of kind ``float32`` (little-endian),
    ``json`` (an array in row order), ``npy`` or ``npz`` (its array ``data``). The size may be left out for the last two; where
    it is given, another is an error. NaN is null, and null bytes have no rows."""

    @staticmethod
    def analyze(
        content: AnalyzeArgument, kind: AnalyzeArgument, height: AnalyzeArgument | None = None,
        width: AnalyzeArgument | None = None
    ) -> AnalyzeResult:
        if not kind.isConstantExpression or kind.value not in KINDS:
            raise ValueError(f"the kind of a raster must be one of {', '.join(KINDS)}")
        if kind.value in ("float32", "json") and (height is None or width is None):
            raise ValueError(f"a raster of kind {kind.value} needs its height and width")
        return AnalyzeResult(
            StructType().add("row", IntegerType()).add("col", IntegerType()).add("value", KINDS[kind.value])
        )

    def eval(self, content: bytes, kind: str, height: int | None = None, width: int | None = None) -> Iterator[tuple]:
        if content is None:
            return
        data = bytes(content)
        if kind == "float32":
            x = np.frombuffer(data, dtype="<f4")
        elif kind == "json":
            x = np.array([np.nan if v is None else v for v in json.loads(data)], dtype=float)
        else:
            x = np.load(io.BytesIO(data), allow_pickle=False)
            x = x["data"] if kind == "npz" else x
            if x.ndim != 2:
                raise ValueError(f"the raster has {x.ndim} dimensions")
        if height is not None and (x.size != height * width or (x.ndim == 2 and x.shape != (height, width))):
            raise ValueError(f"the raster has {x.size} values, not {height} x {width}")
        x = x.reshape(height, width) if height is not None else x
        for r, line in enumerate(x.astype(float).tolist()):
            for c, v in enumerate(line):
                yield r, c, None if v != v else v


def register(spark: SparkSession) -> None:
    """Make ``grib_values`` and ``raster_values`` functions of the session."""
    spark.udtf.register("grib_values", GribValues)
    spark.udtf.register("raster_values", RasterValues)
