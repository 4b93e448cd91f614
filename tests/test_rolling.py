"""Sliding medians: both ways against plain windows; a finely sampled series leaves the others' reach alone."""

import numpy as np
import pytest

from spectraloom.operators import masks


@pytest.mark.parametrize("wide", [5, 512])
def test_rolling_median_and_mad(wide, monkeypatch):
    monkeypatch.setattr(masks, "WIDE", wide)
    monkeypatch.setattr(masks, "WINDOW_VALUES", 64)
    rng = np.random.default_rng(1)
    for n, h in [(1, 5), (7, 5), (40, 5), (200, 9), (30, 50)]:
        g = np.round(rng.normal(size=n), 1)
        med, mad = masks.rolling_median_mad(g, h)
        for i in range(n):
            w = g[max(0, i - h) : i + h + 1]
            m = np.median(w)
            assert med[i] == pytest.approx(m, abs=1e-12) and mad[i] == pytest.approx(np.median(np.abs(w - m)), abs=1e-12)


def test_reach_is_each_series_own(spark):
    """A step of 1e-2 means windows of thousands of rows for that series; growth and outliers of the other stay as they are alone."""
    rng = np.random.default_rng(3)
    coarse = [(1, k, 8400.0 + 1.25 * k, float(rng.normal(5, 1) + 30 * (k == 30)), 1.0, True, k in (10, 40)) for k in range(70)]
    fine = [(2, k, 8400.0 + 0.01 * k, float(rng.normal(5, 1) + 30 * (k == 900)), 1.0, True, k == 1000) for k in range(3000)]
    cols = "object_id long, pix long, x double, g double, gerr double, good boolean, flag boolean"

    def run(rows):
        df = spark.createDataFrame(rows, cols)
        out = masks.grow_mask_by(df, "flag", 3.0)
        return {(r.object_id, r.pix) for r in out.filter("grown").collect()}, {(r.object_id, r.pix) for r in masks.rolling_flags(df, 5.0).collect()}

    grown, found = run(coarse + fine)
    alone_grown, alone_found = run(coarse)
    assert {x for x in grown if x[0] == 1} == alone_grown == {(1, k) for c in (10, 40) for k in range(c - 3, c + 4)}
    assert {x for x in grown if x[0] == 2} == {(2, k) for k in range(700, 1301)}
    assert {x for x in found if x[0] == 1} == alone_found and (1, 30) in found and (2, 900) in found
