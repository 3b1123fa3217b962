"""What must hold at scale: pruned scans, pushed filters, work before the shuffle, no Python and no nested loops in hot paths."""

import re

import pytest

from marlow import plans

PYTHON = {"fuzzy_join", "fuzzy_search", "fuzzy_search_keys", "grey_rasters", "markdown_blocks", "markdown_joined", "suppressed", "kept_smaller", "player_clusters", "largest_quiet_region", "archived_files", "dominant_colour", "stream_limited", "stream_deltas"}
# plane sweeps in the leaves of a k-d tree, and tables read by a Python data source
PYTHON |= {"rect_anti", "rect_anti_threshold", "rect_anti_halves", "rect_pairs", "point_in_rect", "customer_in_rect", "suppressed_all", "kept_smaller_all", "committed_parts", "committed_events"}
# one row each
NESTED = {"top_k", "limited_text", "overlap_ratio", "offset_ids"}
HEAVY = {"stream_first_seen", "stream_deltas", "stream_limited", "same_rows", "dominant_colour", "kept_smaller_all"}


def plan(spark, sf, name):
    return plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned(spark, sf):
    p = plan(spark, sf, "latest_groups")
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,event_type:string>", p), p
    assert "PushedFilters: [IsNotNull(event_type), IsNotNull(value)" in plan(spark, sf, "filter_chain")


def test_rows_are_cut_before_the_shuffle(spark, sf):
    assert plan(spark, sf, "best_per_key").count("WindowGroupLimit") == 2
    assert "partial_max" in plan(spark, sf, "latest_groups") and "TakeOrderedAndProject" in plan(spark, sf, "fuzzy_rank")


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - HEAVY))
def test_no_python_or_nested_loops(spark, sf, name):
    p = plan(spark, sf, name)
    assert name in PYTHON or not re.search("Python|Pandas|Arrow", p)
    assert name in NESTED or not re.search("NestedLoop|CartesianProduct", p)
