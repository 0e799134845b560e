"""Robust fits drawn and voted on by blocks."""

import numpy as np
import pytest

from tessella.operators import fitting

_SHAPE = "run_id long, match_idx long, src_x double, src_y double, ref_x double, ref_y double"


def test_many_sets_of_points_are_fitted_at_once():
    src = np.array([[[0, 0], [4, 0], [0, 3], [5, 7]], [[1, 1], [9, 2], [3, 8], [np.nan, 0]]], float)
    h = fitting._dlt(src, src * 2 + 5)
    assert h[0] == pytest.approx(np.array([[2, 0, 5], [0, 2, 5], [0, 0, 1]]), abs=1e-9) and np.isnan(h[1]).all()


def test_robust_fit_over_many_blocks_with_a_missing_coordinate(spark):
    """A point without a coordinate fits nothing; it ended the job when it was drawn."""
    pts = [(1, i, float(i * 37 % 101), float(i * 53 % 97)) for i in range(60)]
    rows = [(r, i, x, y, 1.1 * x + 4 + (200 if i % 5 == 0 else 0), 1.2 * y - 7) for r, i, x, y in pts] + [(1, 60, None, 1.0, 1.0, 1.0)]
    got = fitting.fit_robust(spark.createDataFrame(rows, _SHAPE), block=7).first()
    assert (got.inliers, got.total) == (48, 61) and got.h[:6] == pytest.approx([1.1, 0, 4, 0, 1.2, -7], abs=1e-6)
