from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from brightledger.operators.geo import country_columns, resolve_countries, unmatched_places
from brightledger.operators.profile import (
    duplicate_rows,
    infer_types,
    numeric_stats,
    profile_frame,
    profile_table,
    quality_summary,
    row_print,
    table_rows,
    top_values,
    unique_counts,
)
from brightledger.plans.dashboards import chart_label, chart_title, cross_table_charts, default_charts, kpi_dashboard, merge_charts
from brightledger.plans.derived import read_lineage
from brightledger.plans.insights import generate_insights, order_findings, outlier_sample, iqr_anomalies
from brightledger.plans.kpis import discover_kpis, kpi_label, rank_metrics
from brightledger.sources.datasets import read_dataset
from tests.conftest import as_dicts, order_rows


def types(df, strict=False):
    return {r["column_name"]: r["inferred_type"] for r in infer_types(df, strict).collect()}


def test_types_of_orders(orders):
    assert types(orders(30)) == {
        "order_id": "identifier", "date": "date", "customer_id": "identifier", "amount": "numeric", "region": "categorical",
    }


def test_types_from_text(spark):
    rows = [(f"${1000 + i:,}.50", f"{i % 28 + 1:02d}/01/2024", f"note number {i}", f"C-{i}", "9:00 AM", None) for i in range(30)]
    df = spark.createDataFrame(rows, "amount string, day string, notes string, code string, clock string, gap string")
    assert types(df) == {
        "amount": "numeric", "day": "date", "notes": "text", "code": "identifier", "clock": "categorical", "gap": "unknown",
    }


def test_strong_ending_and_strict_mode(spark):
    df = spark.createDataFrame([(1.5, 2, 3), (2.5, 2, 3), (3.5, 2, 4)], "amount_paid double, SalesTerritoryKey int, monkey int")
    assert types(df) == {"amount_paid": "identifier", "SalesTerritoryKey": "identifier", "monkey": "identifier"}
    assert types(df, strict=True) == {"amount_paid": "numeric", "SalesTerritoryKey": "identifier", "monkey": "numeric"}


def test_profile_numbers(orders):
    profile = profile_table(orders(20), "o")
    amount = profile.column("amount")
    assert (amount["min_value"], amount["max_value"], amount["mean_value"], amount["median_value"]) == (110.0, 300.0, 205.0, 205.0)
    assert amount["std_value"] == pytest.approx(59.1608, abs=1e-4)
    region = profile.column("region")
    assert region["cardinality"] == 4 and region["top_values"][0] == {"value": "East", "count": 5, "percentage": 25.0}
    day = profile.column("date")
    assert (day["min_date"], day["max_date"], day["date_coverage_days"]) == ("2024-01-15T00:00:00", "2024-06-15T00:00:00", 152)
    assert profile.duplicate_row_count == 0


def test_one_value_has_no_deviation(spark):
    df = spark.createDataFrame([(5.0,), (None,)], "x double")
    assert numeric_stats(df, ["x"]).first()["std_value"] == 0.0


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (0.0,), (-0.0,)], "x double")
    column = profile_table(df, "t").column("x")
    assert (column["missing_count"], column["unique_count"], column["missing_percentage"]) == (2, 2, 40.0)


def test_whole_texts_decide_distinct_counts(spark):
    long = "x" * 100
    df = spark.createDataFrame([(long + "a", 1), (long + "b", 2), (long + "a", 3), ("s", 4)], "t string, n int")
    assert dict(map(tuple, unique_counts(df).collect())) == {"t": 3, "n": 4}
    top = as_dicts(top_values(df, ["t"]))
    assert top[0]["value"] == long + "a" and top[0]["count"] == 2


def test_duplicate_rows_by_row_and_by_print(spark):
    rows = [("a", None, 1.0), ("a", None, 1.0), (None, "a", 1.0), ("a|", "b", 2.0), ("a", "|b", 2.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "x string, y string, z double")
    assert duplicate_rows(df).first()["duplicate_row_count"] == 2
    assert df.select(row_print(df)).distinct().count() == 4
    wide = df.select("*", *[F.lit(i).alias(f"c{i}") for i in range(20)])
    assert duplicate_rows(wide).first()["duplicate_row_count"] == 2


def test_duplicates_with_nested_columns(spark):
    df = spark.sql("SELECT map('a', 1) AS m, array(1, 2) AS l UNION ALL SELECT map('a', 1), array(1, 2)")
    assert duplicate_rows(df).first()["duplicate_row_count"] == 1


def test_quality_rating(spark):
    df = spark.createDataFrame([("1", None), ("2", None), ("1", None), ("1", "x")], "n string, gap string")
    profile = profile_table(df, "q", duplicate_headers=["n"])
    row = quality_summary(profile_frame(spark, [profile]), table_rows(spark, [profile])).first()
    # one of four rows repeats (25), one column mostly missing (15), one text number (5), one header (5)
    assert (row["duplicate_row_percentage"], row["score"], row["rating"]) == (25.0, 50.0, "poor")
    assert len(row["notes"]) == 4


def test_empty_table(spark):
    profile = profile_table(spark.createDataFrame([], "a string, b double"), "e")
    assert profile.row_count == 0 and [c["inferred_type"] for c in profile.columns] == ["unknown", "unknown"]


# --- KPIs -------------------------------------------------------------------------


def profile_rows(spark, *columns):
    rows = [("d", i, name, kind, 100, 100, 0, 0.0, 10) for i, (name, kind) in enumerate(columns)]
    return spark.createDataFrame(
        rows,
        "dataset_id string, position int, column_name string, inferred_type string, row_count long, non_null_count long,"
        " missing_count long, missing_percentage double, unique_count long",
    )


def test_metric_ranking(spark):
    names = ["Year", "Month_Number", "Years_At_Company", "unit_price", "order_no", "Revenue", "notes", "gross_margin"]
    ranked = as_dicts(rank_metrics(profile_rows(spark, *[(n, "numeric") for n in names])))
    assert [r["column_name"] for r in sorted(ranked, key=lambda r: r["rank"])] == ["Revenue", "gross_margin", "unit_price", "Years_At_Company", "notes"]
    assert {r["column_name"]: r["aggregation"] for r in ranked}["Years_At_Company"] == "mean"


@pytest.mark.parametrize(
    "agg, name, label",
    [
        ("sum", "sales_amount", "Total Sales"),
        ("mean", "unit_price", "Average Unit Price"),
        ("sum", "Realized_Revenue_NGN", "Total Realized Revenue"),
        ("mean", "Average_Unit_Cost_NGN", "Average Unit Cost"),
        ("nunique", "city", "Distinct City"),
        ("sum", "Total_Sales_NGN", "Total Sales"),
        ("mean", "Unit_Cost_NGN", "Average Unit Cost"),
    ],
)
def test_labels(spark, agg, name, label):
    assert spark.range(1).select(kpi_label(F.lit(agg), F.lit(name)).alias("x")).first()["x"] == label


def test_kpis_of_orders(orders):
    df = orders(20)
    out = as_dicts(discover_kpis(df, profile_table(df, "orders")))
    by_name = {r["name"]: r["preview_value"] for r in out}
    assert by_name["Total Amount"] == 4100.0 and by_name["Average Amount"] == 205.0
    assert by_name["Distinct Customers"] == 5.0
    assert {"Total Amount by Region", "Amount Trend"} <= by_name.keys()


def test_given_aggregations_win(spark):
    rows = [(f"E{i}", 25 + i % 30, 50000.0 + i * 1000, ["Engineering", "Sales"][i % 2]) for i in range(20)]
    df = spark.createDataFrame(rows, "employee_id string, age int, salary double, department string")
    profile = profile_table(df, "hr")
    names = {r["name"] for r in as_dicts(discover_kpis(df, profile))}
    assert {"Total Salary", "Average Age"} <= names
    names = {r["name"] for r in as_dicts(discover_kpis(df, profile, overrides={"salary": "mean", "age": "exclude"}))}
    assert "Average Salary" in names and not any("Age" in n.split() for n in names)


def test_record_count_without_usable_columns(spark):
    df = spark.createDataFrame([(f"a very long unique description {i}",) for i in range(30)], "free_text string")
    assert [(r["name"], r["preview_value"]) for r in as_dicts(discover_kpis(df, profile_table(df, "t")))] == [("Record Count", 30.0)]


def test_similar_amount_dropped_after_sales(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 3.0, "b")], "sales double, extended_amount double, k string")
    names = [r["name"] for r in as_dicts(discover_kpis(df, profile_table(df, "t"))) if r["aggregation"] == "sum"]
    assert "Total Sales" in names and "Total Extended Amount" not in names


# --- findings -----------------------------------------------------------------------


def findings(df, as_of=date(2024, 7, 1)):
    return as_dicts(order_findings(generate_insights(df, profile_table(df, "t"), as_of)))


def test_concentration(spark):
    rows = [("North", 100.0)] * 18 + [("South", 10.0)] * 2
    found = findings(spark.createDataFrame(rows, "region string, amount double"))
    kinds = [f["category"] for f in found]
    assert "concentration_risk" in kinds and "top_performer" in kinds
    assert next(f for f in found if f["category"] == "top_performer")["supporting_values"]["share_pct"] == "98.9"


def test_no_concentration_when_even(spark):
    rows = [(k, 10.0) for k in "ABCD" for _ in range(5)]
    found = findings(spark.createDataFrame(rows, "region string, amount double"))
    assert "concentration_risk" not in [f["category"] for f in found]


def test_nothing_to_say_about_free_text(spark):
    df = spark.createDataFrame([(f"note {i} about {i * 7}",) for i in range(30)], "free_text string")
    assert findings(df) == []


def test_change_and_staleness(spark):
    rows = [(datetime(2024, 1, 5), 100.0)] * 4 + [(datetime(2024, 2, 5), 150.0)] * 4
    found = findings(spark.createDataFrame(rows, "day timestamp_ntz, amount double"), date(2024, 7, 1))
    change = next(f for f in found if f["category"] == "significant_change")
    assert change["supporting_values"]["pct_change"] == "50.0"
    assert next(f for f in found if f["subject"] == "day")["supporting_values"]["days_old"] == "147"
    assert found[0]["category"] == "significant_change"


def test_outliers(spark):
    rows = [(float(i % 10),) for i in range(50)] + [(1000.0,), (-500.0,)]
    df = spark.createDataFrame(rows, "x double")
    row = iqr_anomalies(df, "x").first()
    assert row["outlier_count"] == 2 and row["total_considered"] == 52
    assert [r["outlier_value"] for r in outlier_sample(df, "x").collect()] == [1000.0, -500.0]
    assert iqr_anomalies(df.limit(9), "x").count() == 0
    assert iqr_anomalies(spark.createDataFrame([(1.0,)] * 20, "x double"), "x").count() == 0


# --- dashboards -----------------------------------------------------------------------


def test_three_charts(spark):
    modes = ["Standard", "Express", "Same Day"]
    rows = [(*r, modes[i % 3]) for i, r in enumerate(order_rows(60))]
    df = spark.createDataFrame(rows, "order_id long, date string, customer_id long, amount double, region string, shipping_mode string")
    profile = profile_table(df, "two")
    charts = default_charts(df, profile)
    heads = [tuple(r) for r in charts.select("chart_no", "chart_type", "title").distinct().orderBy("chart_no").collect()]
    assert heads == [(1, "line", "Monthly Amount Trend"), (2, "ranking", "Total Amount by Region"), (3, "donut", "Total Amount by Shipping Mode")]
    merged = merge_charts([charts, charts])
    assert merged.count() == charts.count()
    assert {r["result_type"] for r in as_dicts(kpi_dashboard(df, profile))} == {"scalar", "table", "timeseries"}


def test_single_figures_when_nothing_else(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "sales double, profit double")
    rows = as_dicts(default_charts(df, profile_table(df, "t")))
    assert {(r["chart_type"], r["title"], r["y_value"]) for r in rows} == {("kpi_card", "Total Sales", 4.0), ("kpi_card", "Total Profit", 6.0)}


def test_large_table_gives_small_result(spark):
    df = spark.range(50_000).select(
        F.col("id").alias("order_id"), (10 + F.col("id") % 97).cast("double").alias("amount"), F.element_at(F.array(*map(F.lit, "abcd")), (F.col("id") % 4 + 1).cast("int")).alias("region")
    )
    assert default_charts(df, profile_table(df, "big")).count() <= 100


@pytest.mark.parametrize("n, label", [(5, "donut"), (12, "donut"), (13, "bar")])
def test_donut_limit(spark, n, label):
    assert spark.range(1).select(chart_label("table", F.lit(n), requested="donut").alias("x")).first()["x"] == label


def test_title_without_doubled_word(spark):
    title = chart_title(F.lit("mean"), F.lit("Average_Unit_Cost_NGN"), F.lit("category"), F.lit("bar"))
    assert spark.range(1).select(title.alias("x")).first()["x"] == "Average Unit Cost by Category"


def test_countries(spark):
    rows = [("Nigeria", 1), ("U.S.A.", 2), (" united_kingdom ", 3), ("fra", 4), ("Wakanda", 5), (None, 6)]
    df = spark.createDataFrame(rows, "country string, revenue long")
    found = {r["revenue"]: r["iso2"] for r in as_dicts(resolve_countries(df, "country"))}
    assert found == {1: "NG", 2: "US", 3: "GB", 4: "FR", 5: None, 6: None}
    assert [r["value"] for r in as_dicts(unmatched_places(df, "country"))] == ["Wakanda"]
    names = profile_rows(spark, ("Country_Code", "categorical"), ("county", "categorical"))
    assert [r["column_name"] for r in as_dicts(country_columns(names))] == ["Country_Code"]


def test_columns_with_dots_and_blanks(spark):
    rows = [(float(i), "ab"[i % 2], f"2024-0{i % 3 + 1}-01", f"{i}") for i in range(12)]
    df = spark.createDataFrame(rows, ["net.price", "my dim", "order date", "line.no"])
    profile = profile_table(df, "odd")
    assert {c["column_name"]: c["inferred_type"] for c in profile.columns} == {
        "net.price": "numeric", "my dim": "categorical", "order date": "date", "line.no": "identifier",
    }
    assert profile.column("net.price")["median_value"] == 5.5
    titles = {r["title"] for r in as_dicts(default_charts(df, profile))}
    assert len(titles) == 2 and generate_insights(df, profile, date(2024, 3, 2)).count() >= 1


def test_joins_of_a_dashboard_are_written_once(spark, orders, customers, tmp_path):
    tables = {"orders": orders(40), "customers": customers}
    profiles = {name: profile_table(df, name, parts=()) for name, df in tables.items()}
    first = cross_table_charts(tables, profiles, str(tmp_path))
    made = sorted(p.name for p in tmp_path.iterdir())
    again = cross_table_charts(tables, profiles, str(tmp_path))
    assert len(first) == 1 and sorted(p.name for p in tmp_path.iterdir()) == made and len(made) == 2
    assert as_dicts(first[0].orderBy("chart_no", "x_value")) == as_dicts(again[0].orderBy("chart_no", "x_value"))
    lineage = as_dicts(read_lineage(spark, str(tmp_path)))
    assert [(r["left_id"], r["right_id"], r["created_by"]) for r in lineage] == [("orders", "customers", "dashboard")]
    # A table derived from another is not joined with it again.
    wide = read_dataset(spark, str(tmp_path), lineage[0]["derived_id"])
    tables = {lineage[0]["derived_id"]: wide, "orders": tables["orders"]}
    assert cross_table_charts(tables, {name: profile_table(df, name, parts=()) for name, df in tables.items()}, str(tmp_path)) == []


def test_profile_in_parts(orders):
    df = orders(20)
    whole, bare = profile_table(df, "o"), profile_table(df, "o", parts=())
    measured = {"min_value", "max_value", "mean_value", "median_value", "std_value", "top_values", "min_date", "max_date", "date_coverage_days"}
    assert bare.duplicate_row_count is None and whole.duplicate_row_count == 0
    for a, b in zip(whole.columns, bare.columns):
        assert {k: v for k, v in a.items() if k not in measured} == {k: v for k, v in b.items() if k not in measured}
        assert all(b[k] is None for k in measured)


def test_trend_chart_has_all_months(spark):
    rows = [(i, f"{1990 + i % 130 // 12}-{i % 130 % 12 + 1:02d}-15", 100.0 + i, "NS"[i % 2]) for i in range(260)]
    table = spark.createDataFrame(rows, "order_id long, date string, amount double, region string")
    months = [r.x_value for r in default_charts(table, profile_table(table, "orders")).where("chart_type = 'line'").collect()]
    assert len(months) == 130 and max(months) == "2000-10"
