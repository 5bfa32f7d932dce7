"""A cross-section of registered queries against DuckDB; `python check.py SF_DIR` compares all of them."""

import pytest

from check import compare, duck
from tabloom.plans import load_all

NAMES = ["fidelity_report", "clean_impute_mode", "profile_mutual_information", "encode_target", "encode_cross_fitted_target", "scale_robust",
         "split_stratified_folds", "augment_quotas", "nearest_rows", "score_ranking", "results_win_ranks", "leaderboard_places", "noise_geometric",
         "private_quantile", "model_naive_bayes", "generate_per_class", "train_preprocess", "read_group_runs", "stream_moments"]


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, sf, name):
    status, text = compare(spark, duck(sf), sf, load_all()[name])
    assert status == "ok", text


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
