"""Registered queries against their SQL on the small tables.

All of them with TIDEGRID_ALL=1, otherwise one or two per family.
"""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect

from conftest import SMALL

QUERIES, SQL = entry.queries(), entry.oracle_sql()
SAMPLE = """RG2_resample RG5_fill_interpolate RG9_hold_stale_tail RG10_gap_spans CN1_restart_detect CN2_glitch_hold CN3_undone_drop CN5_rate_cap
CN8_increment_actuals LS4_carry_deficit LS5_unmeasured_days IO1_normalise_history IO5_parse_trajectory IO8_upsert IO13_log_prune IO16_publish_payload
PF4_to_canonical_energy PF14_covariate_status TR2_clip_mad TR13_psi_drift TR14_data_report SO6_changed_since_previous JN2_asof_tolerance
LS1_subtract_next LS2_load_subtract_drop FC11_smoothing_grid HZ2_slot_quantiles JN4_asof_trajectory JN11_winner_cohort CAL1_calendar CAL6_solar_elevation WF2_rolling WF8_causal_impute WF9_resolve_missingness WF10_sliding_windows
AG2_lead_curve_cohorts AG6_daily_cum_accuracy AG9_conformal_quantiles AG10_coverage_by AG13_stability_daily AG23_skill_common_band MT11_compute_all
CV2_sliding_window BM3_composite_rank BM8_diebold_mariano HZ1_scores FC5_daily_profile FC14_asymmetric_band FC6_recursive_features UD2_stored_models UD3_grid_cells UD3_trajectory_cells ST1_first_write_wins ST2_tumbling ST4_counter_state ST8_late_rewrite""".split()
NAMES = list(QUERIES) if os.environ.get("TIDEGRID_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_check_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    left = QUERIES[name](spark, SMALL).toPandas()
    if name in SQL:
        assert compare(left, con.execute(SQL[name]).df(), tol=1e-9) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
