import pytest

from checks.compare import compare
from checks.oracle import ORACLE
from hunkwise.plans.queries import QUERIES

FAST = (
    "parse_diff_files number_lines format_diff run_rules run_rules_diffs confidence_gate rank_findings severity_rollup "
    "match_labels eval_total rate_limit usage_ledger chunk_blocks upsert_chunks text_search retrieve_context "
    "import_edges pr_events stream_rate_limit resolve_imports change_reach change_reach_near eval_levels read_labels stored_page "
    "exact_neighbours stream_rollup stream_upsert_chunks stream_acceptance stream_usage_ledger attach_findings"
).split()


def test_every_query_has_sql():
    # Cells are fitted outside SQL; the recall is tested against the exact search.
    assert set(QUERIES) == {*ORACLE, "approximate_neighbours"}


@pytest.mark.parametrize("name", FAST)
def test_same_as_sql(spark, name):
    result = compare(spark, "/root/testdata/sf0.001", name)
    assert result.startswith("same"), result
