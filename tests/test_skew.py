"""Named queries on tables in which one key holds a third of the rows, with hot keys cut early."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect
from tidemark.operators import ordered as scans
from tidemark.plans.inputs import TABLES

SMALL = "/root/testdata/sf0.001"
HOT = {
    "events": "* REPLACE (CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id)",
    "orders": "* REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey)",
    "lineitem": "* REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 7 ELSE l_suppkey END AS l_suppkey)",
    "conversations": "* REPLACE (CASE WHEN conv_id % 3 = 0 THEN 7 ELSE conv_id END AS conv_id, "
    "row_number() OVER (ORDER BY conv_id, turn) AS turn)",
    "documents": "* REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'src0' ELSE source END AS source)",
}
CUT = (
    "counter_rates counter_increases counter_resets container_restarts network_rates retry_report running_total "
    "price_against_previous attached_lines parsed_logs trace_lines parsed_batches alert_episodes alert_transitions "
    "scrape_gaps missing_steps component_alerts as_of_values lookback_alerts concurrent_apps"
).split()
WHOLE = ["top_orders_per_customer", "retained_files", "order_customer", "above_average_orders", "signature_missing", "states_in_order", "activity_sessions", "known_issues"]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    root = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(
            f"COPY (SELECT {HOT.get(name, '*')} FROM '{SMALL}/{name}.parquet') TO '{root}/{name}.parquet'"
        )
    return str(root)


#: Series that are sparse or short in the small tables are cut earlier.
EARLIER = {"scrape_gaps": 3, "missing_steps": 3, "component_alerts": 10, "alert_transitions": 10}


@pytest.mark.parametrize("name", CUT + WHOLE)
def test_query_on_hot_key(spark, skewed, monkeypatch, name):
    find, found = scans._find_cuts, []

    def early(df, keys, order, rows):
        found.append(find(df, keys, order, EARLIER.get(name, 40)))
        return found[-1]

    monkeypatch.setattr(scans, "_find_cuts", early)
    got = entry.queries()[name](spark, skewed)
    assert compare(got, connect(skewed), entry.oracle_sql()[name]) is None
    assert any(found) == (name in CUT)
