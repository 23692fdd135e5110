"""Several groupings in one pass, against one at a time."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from brightledger.functions.exprs import known, month_label
from brightledger.operators.aggregate import breakdown, monthly
from brightledger.operators.groupings import WHOLE, cut_table
from brightledger.operators.joins import JoinSpec
from brightledger.operators.profile import profile_table
from brightledger.plans.dashboards import default_charts, kpi_dashboard
from brightledger.plans.derived import derive_dataset, read_lineage
from brightledger.plans.insights import generate_insights
from brightledger.session import load_table

FOLDER = "/root/testdata/sf0.001"


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("parquet")


def test_cuts_are_breakdowns(spark):
    rows = [(i % 3 if i % 7 else None, "xyz"[i % 2 :][:1], float(i) if i % 5 else None, f"2024-0{i % 4 + 1}-03") for i in range(60)] + [(9, None, None, "2024-09-01")]
    df = spark.createDataFrame(rows, "a long, `b.c` string, `v w` double, d string").withColumn("d", F.col("d").cast("timestamp_ntz"))
    cuts = cut_table(df, [known(df, "a"), known(df, "b.c"), month_label(F.col("d"))], [("sum", "v w"), ("mean", "v w"), ("count", None)], {"last": F.col("d")}, whole=True)
    got = {(r.cut, r.label): r for r in cuts.collect()}
    for cut, name in ((0, "a"), (1, "b.c")):
        for i, agg in enumerate(("sum", "mean")):
            want = {str(r[0]): r[1] for r in breakdown(df, name, agg, "v w").collect()}
            assert {label: r[f"v{i}"] for (k, label), r in got.items() if k == cut and r[f"v{i}"] is not None} == pytest.approx(want)
    assert {label: r.v0 for (k, label), r in got.items() if k == 2} == pytest.approx({r.period: r.value for r in monthly(df, "d", "sum", "v w").collect()})
    assert got[WHOLE, None].rows == 61 and got[WHOLE, None]["last"].month == 9 and got[0, "9"].v0 == 0.0
    assert {type(r.k0) for (k, _), r in got.items() if k == 0} == {int}
    assert cut_table(df.limit(0), [known(df, "a")], [("count", None)]).count() == 0
    with pytest.raises(ValueError):
        cut_table(df, [known(df, "a")], [("median", "v w")])


def test_one_scan_for_all_charts_of_a_table(spark):
    lines = load_table(spark, FOLDER, "lineitem")
    profile = profile_table(lines, "lineitem")
    assert _scans(default_charts(lines, profile)) == 1
    assert _scans(kpi_dashboard(lines, profile)) == 1
    # Groups, months and age take one; the last pass over one column is that of outliers.
    assert _scans(generate_insights(lines, profile, date(2024, 6, 1))) <= 3


def test_a_join_found_in_another_root_is_read_there(spark, orders, customers, tmp_path):
    one, other = str(tmp_path / "one"), str(tmp_path / "other")
    spec = JoinSpec("customer_id", "customer_id", "inner", "orders", "customers")
    made, _ = derive_dataset(orders(12), customers, spec, one, "d1", "u1")
    again, row = derive_dataset(orders(12), customers, spec, other, "d2", "u1", lineage_root=one)
    assert row.first()["derived_id"] == "d1" and again.count() == made.count() and read_lineage(spark, other).count() == 0
    fresh, row = derive_dataset(orders(12), customers, spec, other, "d3", "u1")
    assert row.first()["derived_id"] == "d3" and fresh.count() == made.count()
