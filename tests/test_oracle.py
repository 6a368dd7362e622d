"""Registered queries against their SQL on the smallest tables."""

import pytest

from quillspark import catalog

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"
#: a spread over all modules; python -m tests.oracle runs every query
NAMES = [
    "dump_timeline", "promoted_yet_flags", "lifecycle_build", "merge_sources_ga", "credibility_score", "site_activity", "community_dynamics", "users_overlap",
    "degree_centrality_stats", "triangle_count", "connected_components", "closeness_stats", "reply_stats", "score_per_user", "attach_scores", "talk_promotion_dates",
    "talk_events", "parse_date_multi", "topic_pivot", "eval_measures", "find_threshold", "qcut_bins", "spearman_corr", "stratified_bootstrap", "source_fallback",
    "talk_events_grammar", "talk_promotion_dates_grammar", "fit_text_classifier",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    compare(spark, con, SF, catalog.queries()[name], catalog.oracle_sql()[name])
