"""Weather grids in simple packing (GRIB edition 2): grid template 0, data template 0, no bitmap."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VALUES = "path string, message int, category int, parameter int, surface_type int, surface_value double, i int, j int, lat double, lon double, value double"


def _signed(data: bytes, at: int, size: int = 4) -> int:
    """Sign and magnitude, most significant byte first."""
    raw = int.from_bytes(data[at : at + size], "big")
    top = 1 << (8 * size - 1)
    return -(raw & (top - 1)) if raw & top else raw


def _angle(basic: int, parts: int) -> float:
    none = 0xFFFFFFFF
    return (1 if basic in (0, none) else basic) / (1_000_000 if parts in (0, none) else parts)


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    """``n`` unsigned numbers of ``width`` bits each, most significant bit first."""
    if width == 0:
        return np.zeros(n)
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=width * n).reshape(n, width)
    return bits.astype(float) @ (2.0 ** np.arange(width - 1, -1, -1))


def read_messages(data: bytes) -> list[dict]:
    """The complete messages of a file; what lies between them is skipped."""
    out, at = [], 0
    while (at := data.find(b"GRIB", at)) >= 0 and at + 16 <= len(data):
        end = at + int.from_bytes(data[at + 8 : at + 16], "big")
        cursor, m = at + 16, {}
        while cursor < end - 4:
            size, number = struct.unpack_from(">IB", data, cursor)
            if size == 0:
                raise ValueError("a section of no length")
            s = cursor + 5
            if number == 3:
                if struct.unpack_from(">H", data, s + 7)[0] != 0:
                    raise ValueError("only grid template 0 is supported")
                nx, ny, basic, parts = *struct.unpack_from(
                    ">II", data, s + 25
                ), *struct.unpack_from(">II", data, s + 33)
                unit = _angle(basic, parts)
                m |= {
                    "nx": nx, "ny": ny, "lat": _signed(data, s + 41) * unit, "lon": _signed(data, s + 45) * unit,
                    "dx": _signed(data, s + 58) * unit, "dy": _signed(data, s + 62) * unit
                }
            elif number == 4:
                scale, value = data[s + 18], struct.unpack_from(">I", data, s + 19)[0]
                m |= {
                    "category": data[s + 4], "parameter": data[s + 5], "surface_type": data[s + 17],
                    "surface_value": value / 10**scale if scale else float(value)
                }
            elif number == 5:
                n, template = struct.unpack_from(">IH", data, s)
                if template != 0:
                    raise ValueError("only data template 0 is supported")
                # sign and magnitude, as the format has it
                m |= {
                    "n": n, "reference": struct.unpack_from(">f", data, s + 6)[0], "binary": _signed(data, s + 10, 2),
                    "decimal": _signed(data, s + 12, 2), "width": data[s + 14]
                }
            elif number == 6 and data[s] != 255:
                raise ValueError("bitmaps are not supported")
            elif number == 7:
                m["packed"] = data[s : cursor + size]
            cursor += size
        if {"nx", "n", "packed"} <= m.keys():
            raw = unpack_bits(m.pop("packed"), m["width"], m["n"])
            # a field of width 0 is the reference itself, as readers of this format have it
            m["values"] = np.full(m["n"], m["reference"]) if m["width"] == 0 else (
                m["reference"] + raw * 2.0 ** m["binary"]
            ) / 10.0 ** m["decimal"]
            out.append(m)
        at = max(end, at + 4)
    return out


def write_message(
    values: np.ndarray, lat: float, lon: float, dx: float, dy: float, category: int = 0, parameter: int = 0,
    surface: tuple[int, int, int] = (103, 0, 2), decimal: int = 2, width: int = 16
) -> bytes:
    """A message of a grid[j, i] from its first point; the inverse of ``read_messages`` up to the packing's precision."""
    ny, nx = values.shape
    flat = values.ravel() * 10.0**decimal
    reference = float(np.float32(flat.min()))
    span = max(flat.max() - reference, 0.0)
    binary = max(int(np.ceil(np.log2(span / (2**width - 1)))), -30) if span > 0 else 0
    raw = np.clip(np.rint((flat - reference) / 2.0**binary), 0, 2**width - 1).astype(np.uint64)
    bits = ((raw[:, None] >> np.arange(width - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(bits.ravel()).tobytes()
    sign = lambda v, size: (abs(int(v)) | ((1 << (8 * size - 1)) if v < 0 else 0)).to_bytes(size, "big")

    def section(number: int, body: bytes | bytearray) -> bytes:
        return struct.pack(">IB", len(body) + 5, number) + bytes(body)

    grid = bytearray(67)
    struct.pack_into(">II", grid, 25, nx, ny)
    for at, v in ((41, lat), (45, lon), (58, dx), (62, dy)):
        grid[at : at + 4] = sign(round(v * 1e6), 4)
    product = bytearray(29)
    product[4], product[5], product[17], product[18] = category, parameter, surface[0], surface[1]
    struct.pack_into(">I", product, 19, surface[2])
    data = struct.pack(">IHf", nx * ny, 0, reference) + sign(binary, 2) + sign(decimal, 2) + bytes([width, 0])
    body = section(3, grid) + section(4, product) + section(5, data) + section(6, b"\xff") + section(7, packed) + b"7777"
    return b"GRIB\0\0\0\2" + (len(body) + 16).to_bytes(8, "big") + body


def encode_grid(values, nx, lat, lon, dx: float, dy: float, **options) -> Column:
    """A message of an array of values in row order, ``nx`` a row, from its first point (lat, lon) on; null for no values. See
    ``write_message`` for the options."""

    @F.pandas_udf("binary")
    def encode(v: pd.Series, n: pd.Series, y: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([
            None if a is None or not len(a) else write_message(np.asarray(a, dtype=float).reshape(-1, int(w)), p, q, dx, dy, **options)
            for a, w, p, q in zip(v, n, y, x)
        ])

    return encode(values, nx, lat, lon)


def grid_values(spark: SparkSession, path: str) -> DataFrame:
    """One row per grid point of every message below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                for k, m in enumerate(read_messages(content.as_buffer().to_pybytes())):
                    for first in range(0, m["n"], 1 << 16):
                        at = np.arange(first, min(first + (1 << 16), m["n"]))
                        i, j = (at % m["nx"]).astype(np.int32), (at // m["nx"]).astype(np.int32)
                        same = lambda v, t: pa.array([v] * len(at), t)  # noqa: B023, E731
                        yield pa.record_batch([
                            same(name, pa.string()), same(k, pa.int32()), same(m.get("category"), pa.int32()),
                            same(m.get("parameter"), pa.int32()), same(m.get("surface_type"), pa.int32()),
                            same(m.get("surface_value"), pa.float64()),
                            pa.array(i), pa.array(j), pa.array(m["lat"] - j * m["dy"]),
                            pa.array(m["lon"] + i * m["dx"]), pa.array(m["values"][at]),
                        ], names=[c.split()[0] for c in VALUES.split(", ")])

    return spark.read.format("binaryFile").option(
        "recursiveFileLookup", "true"
    ).load(path).select("path", "content").mapInArrow(run, VALUES)
