"""Scenes with unreadable segments."""

import bz2

import numpy as np
import pytest

from emberframe.sources import hsd


@pytest.mark.parametrize("harm", ["truncated", "corrupt", "short", "empty"])
def test_latest_scene_is_readable_to_its_end(spark, tmp_path, harm):
    head = {name: 1 for *_, name in hsd.FIELDS} | {"total_segments": 2}
    whole = hsd.write_segment(head, np.random.default_rng(0).integers(0, 2000, (40, 50)))
    bad = {
        "truncated": whole[:-20], "corrupt": whole[:200] + bytes(50) + whole[250:],
        "short": bz2.compress(bz2.decompress(whole)[:-4]), "empty": b""
    }[harm]
    for slot in ("1000", "1010", "1020"):
        for s in (1, 2):
            path = tmp_path / f"HS_H09_20260101_{slot}_B07_FLDK_R20_S{s:02d}02.DAT.bz2"
            path.write_bytes(bad if (slot, s) == ("1020", 2) else whole)
    got = lambda **more: [
        q["scene_id"] for q in hsd.latest_scenes(spark, str(tmp_path), ["07"], [1, 2], **more).collect()
    ]
    assert got() == ["202601011010"]
    assert got(n=3) == ["202601011010", "202601011000"] and got(oldest_first=True) == ["202601011000"]
