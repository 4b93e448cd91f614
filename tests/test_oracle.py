"""Every query with a SQL twin, compared on the smallest data set."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF) is None


SPLIT = [
    "affine_axis", "anchored_bounds", "biweight_location", "bloom", "bootstrap_draws", "cross_correlate", "emission_line_mask",
    "error_policy", "gauss_smooth", "grow_mask", "grow_mask_by", "interp_templates", "line_excess_snr", "mask_regions", "mask_spans",
    "median_step", "percentile_table", "pooled_frac_error", "prepare", "protect_mask", "rebin", "refine_peak", "replicate_interval",
    "robust_sigma", "rolling_outliers", "series_quality", "sigma_clip", "xcorr_velocity",
]


@pytest.mark.parametrize("name", SPLIT)
def test_split_plans_return_the_same(spark, con, split_plans, name):
    """With tiny limits the hot-key, block and long-series plans run; results must not change."""
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_every_query_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
