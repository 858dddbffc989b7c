"""Registered queries against their SQL on the smallest data folder.

The whole set runs with ``python -m tests.oracle_check``; here a cross-section that
touches every module keeps the suite short.
"""

import os

import pytest

from courtside.plans import registry
from tests.oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
SOME = ("standings", "player_team_seasons", "player_records", "team_seasons", "rank_by_metric", "head_to_head", "global_search", "boxscore_status", "key_diff",
        "surrogate_id", "read_table_csv", "load_all", "resolve_player", "unique_jersey", "fuzzy_candidates", "merge_games", "merge_player_stats", "extract_games",
        "extract_boxscore_teams", "classify_missing_boxscore", "resolve_single_player", "answer_recent_games", "strip_accents", "identity_key")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", SOME)
def test_query(spark, con, name):
    verdict = compare(spark, con, FOLDER, name, registry.queries()[name], registry.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict
