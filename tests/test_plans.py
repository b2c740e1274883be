"""Properties of the physical plans that matter at scale."""

import os
import re

import pytest

import __spark_entry__ as driver
from demandspark.operators import kpis, medians
from demandspark.plans import registry, testdata

TABLES = "/root/testdata/sf0.001"
pytestmark = [
    pytest.mark.skipif(not os.path.isdir(TABLES), reason="shared tables are not here"),
    pytest.mark.usefixtures("one_ranking_input"),
]
MODEL_QUERIES = {n for n in driver.queries() if n not in driver.oracle_sql()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - MODEL_QUERIES))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(driver.queries()[name](spark, TABLES))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "NestedLoopJoin"):
        assert node not in text, node


def scan_of(text, column):
    return next(line for line in text.splitlines() if "FileScan" in line and column in line)


def test_window_filter_and_columns_reach_the_scan(spark):
    scan = scan_of(plan(kpis.hourly_timeseries(registry.trips(spark, TABLES))), "event_id")
    assert re.search(r"GreaterThanOrEqual\(ts,.*LessThan\(ts,", scan)
    assert "event_type" not in scan.split("ReadSchema")[1]


def test_shipment_scan_reads_only_what_it_needs(spark):
    scan = scan_of(plan(kpis.trips_by_hour(registry.shipments(spark, TABLES))), "l_shipdate")
    for unused in ("l_discount", "l_linestatus", "l_returnflag"):
        assert unused not in scan.split("ReadSchema")[1]


def test_lookup_joins_aggregated_rows(spark):
    """The zone lookup must sit above the aggregation, so a hot zone cannot skew the join."""
    text = plan(kpis.zone_analysis(registry.trips(spark, TABLES), testdata.customer_zones(spark, TABLES)))
    depth = {name: text.index(name) for name in ("HashAggregate", "Join")}
    assert depth["Join"] < depth["HashAggregate"]


def test_medians_read_the_trips_twice_and_keep_little(spark, monkeypatch):
    """One scan for totals and sketches, one for what lies inside the brackets; values become a key only there."""
    written = {}
    write = medians.materialize

    def noting(df, label):
        written.setdefault(label, []).append(plan(df))
        return write(df, label)

    monkeypatch.setattr(medians, "materialize", noting)
    kpis.kpis_monthly(registry.shipments(spark, TABLES))
    assert {label: len(plans) for label, plans in written.items()} == {"sketches": 1, "bracketed-values": 1, "quantiles": 1}
    raw = [text.count("l_shipdate") > 0 and len([x for x in text.splitlines() if "FileScan" in x and "l_shipdate" in x]) for texts in written.values() for text in texts]
    assert raw == [1, 1, 0]
    keyed = written["bracketed-values"][0]
    exchange = next(line for line in keyed.splitlines() if "Exchange hashpartitioning" in line)
    below = keyed[keyed.index(exchange) :]
    assert below.index("BroadcastHashJoin") < below.index("FileScan")


def test_panel_windows_share_one_shuffle(spark):
    data = registry.ranking_data(spark, TABLES)
    text = plan(registry.features.training_panel(data, 7))
    # Lines of scalar subqueries (the calendar's distinct hours) start with a colon; the placement by zone comes first.
    lines = text[: text.index("REPARTITION_BY_COL")].splitlines()
    above = "\n".join(line for line in lines if not line.lstrip().startswith(":"))
    assert above.count("Window [") == 2 and text.count("REPARTITION_BY_COL") == 1
    assert above.count("Exchange hashpartitioning") == 1  # the placement by zone itself
