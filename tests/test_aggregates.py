"""Group-key, tie, empty-group and filter semantics (FIXTURES §4.5)."""

from punctual.functions.features import prepare_features
from punctual.operators import aggregates as A
from punctual.operators import filters as P
from punctual.operators import reshape as R
from punctual.schema import LATE_CATEGORIES

SCHEMA = ("FlightDate string, Airline string, Origin string, Dest string, CRSDepTime int, "
          "ArrDelayMinutes double, DepDelayMinutes double, Cancelled int, Diverted int, Distance double")
ROWS = [("2018-01-01", "A", "X", "Y", 900, 10.0, 5.0, 0, 0, 300.0),
        ("2018-01-02", "B", "X", "Y", 1000, 10.0, 5.0, 0, 0, 300.0),
        ("2018-01-03", None, "X", "Y", 1100, 100.0, 90.0, 0, 0, 300.0),
        ("2018-01-04", "A", "X", "Z", 1200, None, None, 1, 0, 700.0)]


def feat(spark):
    return prepare_features(spark.createDataFrame(ROWS, SCHEMA))


def test_null_airline_excluded_but_counted_globally(spark):
    f = feat(spark)
    airlines = {r.Airline for r in A.airline_performance(f, min_flights=1).collect()}
    assert airlines == {"A", "B"}
    assert A.kpi_overview(f).first().total_flights == 4


def test_ties_ordered_by_name(spark):
    f = feat(spark).filter("Airline IS NOT NULL AND Cancelled = 0")
    assert [r.Airline for r in A.airline_performance(f, min_flights=1).collect()] == ["A", "B"]


def test_rates_use_all_rows(spark):
    r = A.airline_performance(feat(spark), min_flights=1).filter("Airline = 'A'").first()
    assert r.total_flights == 2 and r.cancel_rate == 0.5 and r.avg_arr_delay == 10.0


def test_dense_categories(spark):
    out = A.distance_by_category(feat(spark), spark).collect()
    assert [r.ArrDelayCategory for r in out] == LATE_CATEGORIES
    empty = [r for r in out if r.flights == 0]
    assert empty and all(r.mean_distance is None for r in empty)


def test_empty_in_list_means_no_filter_and_empty_match_gives_nulls(spark):
    f = feat(spark)
    assert P.filtered_kpis(f, P.explore_predicate(airlines=[])).first().kept_flights == 4
    r = P.filtered_kpis(f, P.explore_predicate(airlines=["nobody"])).first()
    assert r.kept_flights == 0 and r.avg_arr_delay is None and r.on_time_rate is None


def test_best_worst_overlap_when_few_airlines(spark):
    out = R.best_worst_categories(feat(spark), min_flights=1, k=5).collect()
    sides = {(r.side, r.Airline) for r in out}
    assert ("worst", "A") in sides and ("best", "A") in sides


def test_category_distribution_sums_to_100(spark):
    for r in A.category_distribution(feat(spark), "Airline").collect():
        assert abs(sum(v for k, v in r.asDict().items() if k != "Airline") - 100.0) < 1e-9
