"""Table functions over encoded grids, and rounding of what a double holds."""

import io
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberframe.functions.rounding import half_even
from emberframe.sources import grib, table_functions


def test_half_even_is_that_of_exact_values(spark):
    rng = random.Random(9)
    given = [2.675, 2.665, 0.125, 0.375, -0.125, 0.5, 1.5, 2.5, -2.5, 1.005, 0.285, 1e15, 1e300, -1e300, 5e-324, 0.0, -0.0, 0.49999999999999994]
    given += [k / 8 for k in range(-400, 400)] + [k / 1000 for k in range(-3000, 3000, 5)]
    given += [rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 12) for _ in range(3000)]
    given += [round(rng.uniform(0, 999), 3) + 0.0005 for _ in range(1000)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(given)] + [(-1, None), (-2, math.nan), (-3, math.inf)], "k long, x double")
    names = {d: half_even("x", d).alias(f"d{d}") for d in (0, 1, 2, 3, 4, 6, 9)}
    got = {r["k"]: r for r in df.select("k", *names.values()).collect()}
    for d in names:
        for k, v in enumerate(given):
            want = float(round(v, d)) if d else float(round(v))
            assert got[k][f"d{d}"] == want, (v, d, got[k][f"d{d}"], want)
    assert got[-1]["d2"] is None and math.isnan(got[-2]["d2"]) and got[-3]["d2"] == math.inf
    with pytest.raises(ValueError):
        half_even("x", 16)


def test_grib_values_of_every_row(spark):
    table_functions.register(spark)
    x = np.arange(12.0).reshape(3, 4) / 4
    two = grib.write_message(x, 31.0, 100.0, 0.5, 0.25) + b"junk" + grib.write_message(x + 100, 10.0, 20.0, 1.0, 1.0, parameter=7)
    files = spark.createDataFrame([("a", two), ("b", None), ("c", b"no message")], "name string, content binary")
    got = spark.sql("SELECT f.name, v.* FROM {files} f, LATERAL grib_values(f.content) v", files=files).collect()
    assert len(got) == 24 and {r["name"] for r in got} == {"a"}
    for r in got:
        assert r["value"] == pytest.approx(x[r["j"], r["i"]] + 100 * r["message"], abs=0.01) and r["parameter"] == 7 * r["message"]
        assert (r["lat"], r["lon"]) == (pytest.approx((31 - 0.25 * r["j"]) if not r["message"] else 10 - r["j"]), pytest.approx((100 + 0.5 * r["i"]) if not r["message"] else 20 + r["i"]))
    arrays = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, None)], "id int, v array<double>")
    made = arrays.select("id", grib.encode_grid("v", F.lit(2), F.lit(1.0), F.lit(2.0), 1.0, 1.0).alias("content"))
    assert [r["value"] for r in spark.sql("SELECT v.value FROM {made} m, LATERAL grib_values(m.content) v ORDER BY v.j, v.i", made=made).collect()] == [1.0, 2.0, 3.0, 4.0]


def test_raster_values_of_every_kind(spark):
    table_functions.register(spark)
    x = np.array([[1.5, np.nan, 3.0], [4.0, 5.0, 6.25]], dtype=np.float32)
    npy, npz = io.BytesIO(), io.BytesIO()
    np.save(npy, x)
    np.savez(npz, data=x, other=x[:1])
    data = {
        "float32": x.tobytes(), "json": json.dumps([None if v != v else v for v in x.ravel().tolist()]).encode(), "npy": npy.getvalue(),
        "npz": npz.getvalue()
    }
    want = [(r, c, None if x[r, c] != x[r, c] else float(x[r, c])) for r in range(2) for c in range(3)]
    for kind, content in data.items():
        files = spark.createDataFrame([(content,), (None,)], "content binary")
        sizes = ("", ", 2, 3") if kind.startswith("np") else (", 2, 3",)
        for size in sizes:
            out = spark.sql(f"SELECT v.* FROM {{files}} f, LATERAL raster_values(f.content, '{kind}'{size}) v", files=files)
            assert sorted(map(tuple, out.collect())) == want and out.schema["value"].dataType == table_functions.KINDS[kind]
        with pytest.raises(Exception, match="not 3 x 3"):
            spark.sql(f"SELECT v.* FROM {{files}} f, LATERAL raster_values(f.content, '{kind}', 3, 3) v", files=files).collect()
    files = spark.createDataFrame([(data["npy"],)], "content binary")
    for wrong in ("'tape'", "'float32'", "concat('n', f.content)"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT v.* FROM {{files}} f, LATERAL raster_values(f.content, {wrong}) v", files=files).collect()
