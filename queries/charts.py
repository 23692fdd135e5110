"""K1-K7, I1-I9, T8, T9, D1-D6, G1, G2."""

from datetime import date

from pyspark.sql import functions as F

from brightledger.operators.aggregate import breakdown
from brightledger.operators.geo import country_columns, map_points, resolve_countries, unmatched_places
from brightledger.operators.profile import batch_reprofile, infer_types, profile_frame, profile_table, table_rows
from brightledger.plans.dashboards import (
    chart_label,
    chart_title,
    cross_table_charts,
    default_charts,
    kpi_dashboard,
    merge_charts,
)
from brightledger.plans.insights import (
    anomaly,
    concentration,
    dominant_category,
    generate_insights,
    iqr_anomalies,
    order_findings,
    outlier_sample,
    quality_findings,
    significant_change,
    staleness,
    top_group,
)
from brightledger.plans.kpis import (
    AVERAGED_WORDS,
    choose_aggregation,
    discover_kpis,
    entity_count,
    kpi_label,
    rank_dimensions,
    rank_metrics,
)
from brightledger.session import load_table
from queries import query
from queries.joining import _plain_names

AS_OF = date(2024, 6, 1)


def _profiled(spark, d, table, *parts):
    df = load_table(spark, d, table)
    return df, profile_table(df, table, parts=parts)


def _round(df, *names, digits=2):
    for name in names:
        df = df.withColumn(name, F.round(name, digits))
    return df


# --- KPIs -------------------------------------------------------------------------


@query(
    "k1_rank_metrics",
    """SELECT * FROM (VALUES (1, 'l_quantity', 'sum'), (2, 'l_extendedprice', 'mean'), (3, 'l_linenumber', 'sum'), (4, 'l_discount', 'sum'),
         (5, 'l_tax', 'sum')) AS t(rank, column_name, aggregation)""",
)
def k1_rank_metrics(spark, d):
    rows = infer_types(load_table(spark, d, "lineitem")).withColumn("dataset_id", F.lit("lineitem"))
    return rank_metrics(rows).drop("dataset_id")


@query(
    "k2_rank_dimensions",
    """WITH c AS (SELECT 1 AS i, 'l_returnflag' AS column_name, count(DISTINCT l_returnflag) AS cardinality FROM lineitem
         UNION ALL SELECT 2, 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem)
       SELECT CAST(row_number() OVER (ORDER BY i) AS INTEGER) AS rank, column_name, cardinality FROM c WHERE cardinality BETWEEN 2 AND 50""",
)
def k2_rank_dimensions(spark, d):
    rows = infer_types(load_table(spark, d, "lineitem")).withColumns({"dataset_id": F.lit("lineitem"), "cardinality": F.col("unique_count")})
    return rank_dimensions(rows).drop("dataset_id")


@query(
    "k3_sum_or_mean",
    f"""SELECT DISTINCT p_name || '_' || p_type AS column_name,
          CASE WHEN regexp_matches(lower(p_name || '_' || p_type), '{"|".join(AVERAGED_WORDS)}') THEN 'mean' ELSE 'sum' END AS aggregation FROM part""",
)
def k3_sum_or_mean(spark, d):
    names = load_table(spark, d, "part").select(F.concat_ws("_", "p_name", "p_type").alias("column_name")).distinct()
    return names.select("column_name", choose_aggregation(F.col("column_name")).alias("aggregation"))


@query(
    "k4_kpis",
    """WITH s AS (SELECT sum(l_quantity) AS q, avg(l_extendedprice) AS p, sum(l_linenumber) AS n, sum(l_discount) AS dc, sum(l_tax) AS tx, avg(l_quantity) AS aq FROM lineitem)
       SELECT CAST(no AS INTEGER) AS kpi_no, name, m AS metric_column, a AS aggregation, dim AS dimension_column, dt AS date_column, round(CAST(v AS DOUBLE), 2) AS preview_value
       FROM s, LATERAL (VALUES (1, 'Total L Quantity', 'l_quantity', 'sum', NULL, NULL, q), (2, 'Average L Extendedprice', 'l_extendedprice', 'mean', NULL, NULL, p),
         (3, 'Total L Linenumber', 'l_linenumber', 'sum', NULL, NULL, CAST(n AS DOUBLE)), (4, 'Total L Discount', 'l_discount', 'sum', NULL, NULL, dc), (5, 'Total L Tax', 'l_tax', 'sum', NULL, NULL, tx),
         (6, 'Total L Quantity by L Returnflag', 'l_quantity', 'sum', 'l_returnflag', NULL, NULL), (7, 'L Quantity Trend', 'l_quantity', 'sum', NULL, 'l_shipdate', NULL),
         (8, 'Average L Quantity', 'l_quantity', 'mean', NULL, NULL, aq)) AS t(no, name, m, a, dim, dt, v)""",
)
def k4_kpis(spark, d):
    return _round(discover_kpis(*_profiled(spark, d, "lineitem")), "preview_value")


@query(
    "k5_entity_count",
    """SELECT 'o_custkey' AS column_name, count(DISTINCT o_custkey) AS distinct_count, count(*) AS row_count FROM orders
       HAVING count(DISTINCT o_custkey) <= 0.3 * count(*)""",
)
def k5_entity_count(spark, d):
    return entity_count(load_table(spark, d, "orders"), "o_custkey")


@query(
    "k6_kpi_companions",
    """WITH s AS (SELECT avg(o_totalprice) AS p, CAST(count(DISTINCT o_custkey) AS DOUBLE) AS c FROM orders)
       SELECT CAST(no AS INTEGER) AS kpi_no, name, a AS aggregation, round(v, 2) AS preview_value FROM s, LATERAL (VALUES
         (1, 'Average Total Price', 'mean', p), (2, 'Distinct Customers', 'nunique', c), (3, 'Average Total Price by Status', 'mean', NULL),
         (4, 'Total Price Trend', 'mean', NULL)) AS t(no, name, a, v)""",
)
def k6_kpi_companions(spark, d):
    names = ["order_key", "customer_key", "status", "total_price", "order_date", "priority"]
    orders = load_table(spark, d, "orders").toDF(*names)
    out = discover_kpis(orders, profile_table(orders, "orders", parts=()))
    return _round(out, "preview_value").select("kpi_no", "name", "aggregation", "preview_value")


@query("k6_record_count", "SELECT 'Record Count' AS name, 'count' AS aggregation, CAST(count(*) AS DOUBLE) AS preview_value FROM conversations")
def k6_record_count(spark, d):
    turns = load_table(spark, d, "conversations").select("conv_id", "role")
    return discover_kpis(turns, profile_table(turns, "turns", parts=())).select("name", "aggregation", "preview_value")


_CAP = "upper(string_split(p_name, ' ')[{i}][1]) || string_split(p_name, ' ')[{i}][2:]"
_TITLE = _CAP.format(i=1) + " || ' ' || " + _CAP.format(i=2)


@query(
    "k7_labels",
    f"SELECT DISTINCT p_name, 'Total ' || {_TITLE} AS summed, 'Average ' || {_TITLE} AS averaged, 'Total Sales' AS fixed FROM part",
)
def k7_labels(spark, d):
    names = load_table(spark, d, "part").select("p_name").distinct()
    column = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_USD"))
    return names.select(
        "p_name",
        kpi_label(F.lit("sum"), column).alias("summed"),
        kpi_label(F.lit("mean"), F.concat(F.lit("Average_"), column)).alias("averaged"),
        kpi_label(F.lit("sum"), F.lit("Sales_Amount_EUR")).alias("fixed"),
    )


# --- insights -----------------------------------------------------------------------

_TOP = """SELECT k AS top_group, round(v, 2) AS top_value, round(sum(v) OVER (), 2) AS total, count(*) OVER () AS group_count,
  round(100 * v / sum(v) OVER (), 2) AS share_pct FROM (SELECT {k} AS k, CAST(sum({m}) AS DOUBLE) AS v FROM {t} GROUP BY 1) ORDER BY v DESC, k LIMIT 1"""


@query("i1_top_performer", _TOP.format(k="o_orderpriority", m="o_totalprice", t="orders"))
def i1_top_performer(spark, d):
    return _round(top_group(load_table(spark, d, "orders"), "o_orderpriority", "o_totalprice"), "top_value", "total")


@query("i2_concentration", f"SELECT * FROM ({_TOP.format(k='lang', m='n_chars', t='documents')}) WHERE share_pct > 40")
def i2_concentration(spark, d):
    return _round(concentration(load_table(spark, d, "documents"), "lang", "n_chars"), "top_value", "total")


@query(
    "i3_significant_change",
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1),
       l AS (SELECT lag(p) OVER (ORDER BY p) AS prior_period, lag(v) OVER (ORDER BY p) AS pv, p AS last_period, v FROM m)
       SELECT prior_period, round(pv, 2) AS prior_value, last_period, round(v, 2) AS last_value, round((v - pv) / pv * 100, 2) AS pct_change
       FROM (SELECT * FROM l ORDER BY last_period DESC LIMIT 1) WHERE abs(round((v - pv) / pv * 100, 2)) >= 15""",
)
def i3_significant_change(spark, d):
    return _round(significant_change(load_table(spark, d, "orders"), "o_orderdate", "o_totalprice"), "prior_value", "last_value")


_IQR = """WITH q AS (SELECT quantile_cont({m}, 0.25) AS q1, quantile_cont({m}, 0.75) AS q3 FROM {t}),
  b AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
  s AS (SELECT b.*, count(*) AS n, count(*) FILTER (x.{m} > hi) AS hc, count(*) FILTER (x.{m} < lo) AS lc, sum(x.{m}) AS tot,
    coalesce(sum(x.{m}) FILTER (x.{m} > hi OR x.{m} < lo), 0) AS osum FROM {t} x, b GROUP BY ALL)
  SELECT round(q1, 2) AS q1, round(q3, 2) AS q3, round(iqr, 2) AS iqr, round(lo, 2) AS lower_bound, round(hi, 2) AS upper_bound, n AS total_considered,
    hc + lc AS outlier_count, round(100.0 * (hc + lc) / n, 2) AS outlier_share_pct, hc AS high_count, lc AS low_count,
    round(100 * abs(osum) / abs(tot), 1) AS outlier_contribution_pct{extra} FROM s WHERE n >= 10 AND iqr <> 0 AND hc + lc > 0"""


@query("i4_iqr_outliers", _IQR.format(m="value", t="events", extra=""))
def i4_iqr_outliers(spark, d):
    return iqr_anomalies(load_table(spark, d, "events"), "value")


@query(
    "i4_outlier_values",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
       SELECT round(value, 2) AS outlier_value FROM events, q WHERE value > q3 + 1.5 * (q3 - q1) OR value < q1 - 1.5 * (q3 - q1)
       ORDER BY greatest(value - (q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1) - value) DESC LIMIT 20""",
)
def i4_outlier_values(spark, d):
    return outlier_sample(load_table(spark, d, "events"), "value")


@query(
    "i5_anomaly",
    _IQR.format(m="n_chars", t="documents", extra=", CASE WHEN hc > lc THEN 'high' WHEN lc > 0 THEN 'low' ELSE 'none' END AS direction")
    + " AND (round(100.0 * (hc + lc) / n, 2) >= 1 OR hc + lc >= 10)",
)
def i5_anomaly(spark, d):
    return anomaly(load_table(spark, d, "documents"), "n_chars")


@query(
    "i6_data_quality",
    """WITH r AS (SELECT count(*) AS n, count(*) FILTER (n_chars > 2000) AS c FROM documents), g AS (SELECT count(*) AS k FROM documents GROUP BY lang, CASE WHEN n_chars > 2000 THEN source END)
       SELECT 'data_quality' AS category, 'docs' AS subject, round(100.0 * sum(k - 1) / sum(k), 2) AS percentage FROM g HAVING round(100.0 * sum(k - 1) / sum(k), 2) > 5
       UNION ALL SELECT 'data_quality', 'far_source', round(100.0 * (n - c) / n, 2) FROM r WHERE round(100.0 * (n - c) / n, 2) > 30""",
)
def i6_data_quality(spark, d):
    docs = load_table(spark, d, "documents").select("lang", F.when(F.col("n_chars") > 2000, F.col("source")).alias("far_source"))
    profile = profile_table(docs, "docs", parts=["dup"])
    found = quality_findings(profile_frame(spark, [profile]), table_rows(spark, [profile]))
    return found.select("category", "subject", F.col("supporting_values")["percentage"].cast("double").alias("percentage"))


@query(
    "i7_staleness",
    """SELECT strftime(max(ts), '%Y-%m-%d') AS latest_date, CAST(DATE '2024-06-01' - CAST(max(ts) AS DATE) AS INTEGER) AS days_old FROM events
       HAVING DATE '2024-06-01' - CAST(max(ts) AS DATE) >= 30""",
)
def i7_staleness(spark, d):
    return staleness(load_table(spark, d, "events"), "ts", AS_OF)


@query(
    "i8_dominant_category",
    """SELECT * FROM (SELECT role AS top_value, count(*) AS top_count, CAST(sum(count(*)) OVER () AS BIGINT) AS total, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share_pct
       FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) WHERE share_pct >= 50""",
)
def i8_dominant_category(spark, d):
    return dominant_category(load_table(spark, d, "conversations"), "role")


_FINDINGS = f"""SELECT 'top_performer' AS category, top_group AS subject, share_pct AS figure FROM ({_TOP.format(k='event_type', m='value', t='events')})
  UNION ALL SELECT 'concentration_risk', top_group, share_pct FROM ({_TOP.format(k='event_type', m='value', t='events')}) WHERE share_pct > 40
  UNION ALL SELECT 'anomaly', 'value', outlier_share_pct FROM ({_IQR.format(m='value', t='events', extra='')}) WHERE outlier_share_pct >= 1 OR outlier_count >= 10
  UNION ALL SELECT 'data_quality', 'ts', CAST(DATE '2024-06-01' - CAST(max(ts) AS DATE) AS DOUBLE) FROM events"""


def _event_findings(spark, d):
    df, profile = _profiled(spark, d, "events", "dup")
    found = generate_insights(df, profile, AS_OF)
    values = F.col("supporting_values")
    figure = F.coalesce(values["share_pct"], values["outlier_share_pct"], values["days_old"]).cast("double")
    return found.withColumn("figure", figure)


@query("i9_all_insights", _FINDINGS)
def i9_all_insights(spark, d):
    return _event_findings(spark, d).select("category", "subject", "figure")


@query(
    "t9_finding_order",
    f"""SELECT category, subject, CAST(CASE category WHEN 'significant_change' THEN 0 WHEN 'anomaly' THEN 1 WHEN 'top_performer' THEN 2 WHEN 'concentration_risk' THEN 3 ELSE 4 END AS INTEGER) AS priority
        FROM ({_FINDINGS})""",
)
def t9_finding_order(spark, d):
    return order_findings(_event_findings(spark, d)).select("category", "subject", "priority")


# --- dashboards ----------------------------------------------------------------------

_TREND = "SELECT strftime(o_orderdate, '%Y-%m') AS x_value, round(avg(o_totalprice), 2) AS y_value FROM orders GROUP BY 1"
_BY = "SELECT {k} AS x_value, round({a}, 2) AS y_value FROM {t} GROUP BY 1"


@query(
    "d1_default_charts",
    f"""SELECT 1 AS chart_no, 'line' AS chart_type, 'Monthly O Totalprice Trend' AS title, x_value, y_value FROM ({_TREND})
        UNION ALL SELECT 2, 'ranking', 'Average O Totalprice by O Orderstatus', x_value, y_value FROM ({_BY.format(k='o_orderstatus', a='avg(o_totalprice)', t='orders')})
        UNION ALL SELECT 3, 'donut', 'Average O Totalprice by O Orderpriority', x_value, y_value FROM ({_BY.format(k='o_orderpriority', a='avg(o_totalprice)', t='orders')})""",
)
def d1_default_charts(spark, d):
    charts = default_charts(*_profiled(spark, d, "orders", "span"))
    return _round(charts, "y_value").select("chart_no", "chart_type", "title", "x_value", "y_value")


_CO = "orders JOIN customer ON o_custkey = c_custkey"


@query(
    "d2_cross_table_charts",
    f"""SELECT 'customers ⋈ orders' AS dataset_id, 'line' AS chart_type, 'Monthly Total Price Trend' AS title, x_value, y_value FROM ({_TREND})
        UNION ALL SELECT 'customers ⋈ orders', 'ranking', 'Average Total Price by Segment', x_value, y_value FROM ({_BY.format(k='c_mktsegment', a='avg(o_totalprice)', t=_CO)})
        UNION ALL SELECT 'customers ⋈ orders', 'donut', 'Average Balance by Status', x_value, y_value FROM ({_BY.format(k='o_orderstatus', a='avg(c_acctbal)', t=_CO)})
        UNION ALL SELECT 'nations ⋈ customers', 'donut', 'Average Balance by Segment', x_value, y_value FROM ({_BY.format(k='c_mktsegment', a='avg(c_acctbal)', t='customer')})""",
)
def d2_cross_table_charts(spark, d):
    tables = _plain_names(spark, d)
    profiles = dict(zip(tables, batch_reprofile(tables, parts=())))
    out = None
    for chart in cross_table_charts(tables, profiles):
        out = chart if out is None else out.unionByName(chart)
    return _round(out, "y_value").select("dataset_id", "chart_type", "title", "x_value", "y_value")


@query(
    "t8_merged_charts",
    f"""SELECT 1 AS place, 'orders' AS dataset_id, 'line' AS chart_type, x_value, y_value FROM ({_TREND})
        UNION ALL SELECT 2, 'orders', 'ranking', x_value, y_value FROM ({_BY.format(k='o_orderstatus', a='avg(o_totalprice)', t='orders')})
        UNION ALL SELECT 3, 'orders', 'donut', x_value, y_value FROM ({_BY.format(k='o_orderpriority', a='avg(o_totalprice)', t='orders')})
        UNION ALL SELECT 4, 'events', 'ranking', x_value, y_value FROM ({_BY.format(k='event_type', a='sum(value)', t='events')})""",
)
def t8_merged_charts(spark, d):
    """D3: the charts of several tables, repeats dropped, trends first."""
    orders = default_charts(*_profiled(spark, d, "orders", "span"))
    events = default_charts(*_profiled(spark, d, "events", "span"))
    return _round(merge_charts([orders, events, orders]), "y_value").select("place", "dataset_id", "chart_type", "x_value", "y_value")


@query(
    "d4_kpi_dashboard",
    f"""SELECT 1 AS kpi_no, 'scalar' AS result_type, NULL AS x_value, round(avg(o_totalprice), 2) AS y_value FROM orders
        UNION ALL SELECT 2, 'table', x_value, y_value FROM ({_BY.format(k='o_orderstatus', a='avg(o_totalprice)', t='orders')})
        UNION ALL SELECT 3, 'timeseries', x_value, y_value FROM ({_TREND})""",
)
def d4_kpi_dashboard(spark, d):
    return _round(kpi_dashboard(*_profiled(spark, d, "orders")), "y_value").drop("name")


@query(
    "d5_chart_labels",
    """SELECT p_brand, n AS types, 'bar' AS plain, 'ranking' AS top, CASE WHEN n > 12 THEN 'bar' ELSE 'donut' END AS as_donut,
         CASE WHEN n > 4 THEN 'stacked_bar' ELSE 'grouped_bar' END AS two_way FROM (SELECT p_brand, count(DISTINCT p_name) AS n FROM part GROUP BY 1)""",
)
def d5_chart_labels(spark, d):
    counts = load_table(spark, d, "part").groupBy("p_brand").agg(F.count_distinct("p_name").alias("types"))
    n = F.col("types")
    return counts.select(
        "p_brand",
        "types",
        chart_label("table", n).alias("plain"),
        chart_label("table", n, is_ranking=True).alias("top"),
        chart_label("table", n, requested="donut").alias("as_donut"),
        chart_label("two_way", n, series_count=n).alias("two_way"),
    )


@query(
    "d6_titles",
    f"SELECT DISTINCT p_name, 'Monthly ' || {_TITLE} || ' Trend' AS trend, 'Maximum ' || {_TITLE} || ' by Order Status' AS by_group FROM part",
)
def d6_titles(spark, d):
    names = load_table(spark, d, "part").select("p_name").distinct()
    metric = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_GBP"))
    none = F.lit(None).cast("string")
    return names.select(
        "p_name",
        chart_title(F.lit("sum"), metric, none, F.lit("line")).alias("trend"),
        chart_title(F.lit("max"), metric, F.lit("order_status"), F.lit("bar")).alias("by_group"),
    )


# --- geography --------------------------------------------------------------------------

_PLACES = ["U.S.A.", "germany", "Wakanda", "Cote_d'Ivoire", "GB", "republic of  korea", "jpn", "Atlantis"]
_PLACE_SQL = "(c_nationkey % 8) AS i"
_PLACE_ROWS = """(VALUES (0, 'U.S.A.', 'United States', 39.83, -98.58), (1, 'germany', 'Germany', 51.17, 10.45), (3, 'Cote_d''Ivoire', 'Ivory Coast', 7.54, -5.55),
  (4, 'GB', 'United Kingdom', 55.38, -3.44), (5, 'republic of  korea', 'South Korea', 35.91, 127.77), (6, 'jpn', 'Japan', 36.20, 138.25)) AS g(i, place, country, lat, lng)"""


def _placed(spark, d):
    place = F.element_at(F.array(*[F.lit(p) for p in _PLACES]), (F.col("c_nationkey") % 8 + 1).cast("int"))
    return load_table(spark, d, "customer").withColumn("place", place)


@query(
    "g1_countries",
    f"""SELECT c_custkey, country, CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng FROM (SELECT c_custkey, {_PLACE_SQL} FROM customer) LEFT JOIN {_PLACE_ROWS} USING (i)""",
)
def g1_countries(spark, d):
    return resolve_countries(_placed(spark, d), "place").select("c_custkey", "country", "lat", "lng")


@query(
    "g1_unmatched",
    f"SELECT DISTINCT CASE i WHEN 2 THEN 'Wakanda' ELSE 'Atlantis' END AS value FROM (SELECT {_PLACE_SQL} FROM customer) WHERE i IN (2, 7)",
)
def g1_unmatched(spark, d):
    return unmatched_places(_placed(spark, d), "place")


@query(
    "g1_map_chart",
    f"""SELECT country AS label, CAST(any_value(lat) AS DOUBLE) AS lat, CAST(any_value(lng) AS DOUBLE) AS lng, round(sum(c_acctbal), 2) AS value
        FROM (SELECT c_acctbal, {_PLACE_SQL} FROM customer) JOIN {_PLACE_ROWS} USING (i) GROUP BY 1""",
)
def g1_map_chart(spark, d):
    groups = breakdown(_placed(spark, d), "place", "sum", "c_acctbal")
    return _round(map_points(groups, "place", "sum_c_acctbal"), "value")


@query("g2_country_columns", "SELECT 'c' AS dataset_id, 'Country_Code' AS column_name")
def g2_country_columns(spark, d):
    rows = infer_types(_placed(spark, d).withColumnRenamed("place", "Country_Code")).withColumn("dataset_id", F.lit("c"))
    return country_columns(rows)
