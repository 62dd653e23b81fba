"""What the plans must and must not hold."""

from tripline.operators import geo_join
from tripline.plans import journeys, places, tables, visits

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_radius_join_is_no_nested_loop(spark):
    p = places.places(spark, DATA)
    found = plan(geo_join.radius_join(p, p, "id", 10.0))
    assert "NestedLoop" not in found and "Cartesian" not in found


def test_pairs_share_one_window(spark):
    found = plan(visits.pairs(spark, DATA))
    assert found.count("Window [") + found.count("Window(") == 1
    assert "Python" not in found


def test_columns_are_pruned(spark):
    found = plan(visits.pairs(spark, DATA).select("user_id", "delta_hours"))
    assert "props" not in found.split("ReadSchema")[1]


def test_edges_of_a_matrix_are_added_up_once(spark):
    """Before, the final plan alone had the edges' aggregate three times, and each numbering once more."""
    found = plan(tables.coo_matrix(spark, DATA))
    assert "Aggregate" not in found and "lineitem" not in found


def test_entry_points_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ranking_input_shuffles_no_wide_rows(spark):
    found = plan(journeys.ranking_data(spark, DATA))
    assert "Exchange" not in found and "Window" not in found


def test_hours_are_read_by_many_tasks_and_once_a_place(spark):
    rows = journeys.venues(spark, DATA).select("hours", "has_late_night", "is_24hr")
    found = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 4" in found and found.count("regexp_extract(") <= 8
