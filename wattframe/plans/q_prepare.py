
from __future__ import annotations

from pyspark.sql import functions as F

from wattframe.functions import scalars as S
from wattframe.operators import clean, summary
from wattframe.operators.selection import quantiles
from wattframe.plans import sql_tables as Q
from wattframe.plans import standins as SI
from wattframe.plans.catalog import query
from wattframe.plans.common import rounded


@query("drop_columns", oracle="SELECT * EXCLUDE (l_shipdate, l_linestatus) FROM lineitem")
def drop_columns(spark, sf_dir):
    return clean.drop_columns(SI.table(spark, sf_dir, "lineitem"), ["l_shipdate", "l_linestatus"])


_LI_NULLS_SQL = """
SELECT l_orderkey, l_linenumber, l_quantity, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax,
       l_returnflag FROM lineitem"""


def _lineitem_with_nulls(spark, sf_dir):
    li = SI.table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_quantity",
                     F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
                     F.nullif("l_tax", F.lit(0.0)).alias("l_tax"), "l_returnflag")


@query("drop_null_rows", oracle=f"""
SELECT * FROM ({_LI_NULLS_SQL}) t
WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_quantity IS NOT NULL
  AND l_discount IS NOT NULL AND l_tax IS NOT NULL AND l_returnflag IS NOT NULL""")
def drop_null_rows(spark, sf_dir):
    return clean.drop_null_rows(_lineitem_with_nulls(spark, sf_dir))


@query("split_features_target", oracle=Q.with_(Q.REGRESSION) + """
SELECT l_extendedprice AS label, l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, p_size, p_retailprice, p_type
FROM reg""")
def split_features_target(spark, sf_dir):
    return clean.split_features_target(SI.regression_table(spark, sf_dir), "l_extendedprice")


@query("select_numeric", oracle="SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def select_numeric(spark, sf_dir):
    return clean.select_numeric(SI.table(spark, sf_dir, "orders"))


_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _detect_sql(labels):
    lab = ", ".join(f"'{x}'" for x in labels)
    parts = [f"SELECT {i + 1} AS position, '{c}' AS label_column, "
             f"coalesce(bool_or(lower(CAST({c} AS VARCHAR)) IN ({lab})), false) AS hit FROM orders"
             for i, c in enumerate(_ORDER_COLS)]
    return ("SELECT label_column, position FROM (" + " UNION ALL ".join(parts)
            + ") WHERE hit ORDER BY position LIMIT 1")


@query("detect_label_column", oracle=_detect_sql(["f", "o"]))
def detect_label_column(spark, sf_dir):
    return clean.detect_label_column(SI.table(spark, sf_dir, "orders"), ["f", "o"])


@query("label_map_strict", oracle="""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 0 END AS label FROM orders""")
def label_map_strict(spark, sf_dir):
    o = SI.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.label_map_strict("o_orderstatus", "F", "O").alias("label"))


@query("label_indicator", oracle="""
SELECT o_orderkey, coalesce(CAST(lower(o_orderstatus) = 'f' AS INTEGER), 0) AS label FROM orders""")
def label_indicator(spark, sf_dir):
    o = SI.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", S.label_indicator("o_orderstatus", "f").alias("label"))


@query("class_count", oracle="""
SELECT count(DISTINCT coalesce(CAST(lower(o_orderstatus) = 'f' AS INTEGER), 0)) AS num_classes FROM orders""")
def class_count(spark, sf_dir):
    o = SI.table(spark, sf_dir, "orders").select(S.label_indicator("o_orderstatus", "f").alias("label"))
    return summary.class_count(o, "label")


_PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("one_hot_drop_first", oracle="SELECT p_partkey, p_name, p_brand, p_size, p_retailprice, "
       + ", ".join(f"coalesce(CAST(p_type = '{t}' AS INTEGER), 0) AS p_type_{t}" for t in _PART_TYPES[1:])
       + " FROM part")
def one_hot_drop_first(spark, sf_dir):
    return clean.one_hot_drop_first(SI.table(spark, sf_dir, "part"), "p_type")


@query("binarize_by_median", oracle="""
SELECT l_orderkey, l_linenumber, CAST(l_extendedprice > m AS INTEGER) AS above_median
FROM lineitem, (SELECT median(l_extendedprice) AS m FROM lineitem)""")
def binarize_by_median(spark, sf_dir):
    li = SI.table(spark, sf_dir, "lineitem")
    med = quantiles(li, "l_extendedprice", {"m": 0.5}).first()["m"]
    return li.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") > F.lit(med)).cast("int").alias("above_median"))


_Z_SQL = "(o_totalprice - 200000.0) / 100000.0"


def _score(spark, sf_dir):
    o = SI.table(spark, sf_dir, "orders")
    z = (F.col("o_totalprice") - F.lit(200000.0)) / F.lit(100000.0)
    return o.select("o_orderkey", z.alias("z")).withColumn("probability", S.sigmoid("z"))


@query("sigmoid_score", oracle=f"""
SELECT o_orderkey, round({_Z_SQL}, 12) AS z, round(1.0 / (1.0 + exp(-({_Z_SQL}))), 12) AS probability FROM orders""")
def sigmoid_score(spark, sf_dir):
    return rounded(_score(spark, sf_dir), {"z": 12, "probability": 12})


@query("threshold_predictions", oracle=f"""
SELECT o_orderkey, CAST(p > 0.5 AS INTEGER) AS pred_gt, CAST(p >= 0.5 AS INTEGER) AS pred_ge
FROM (SELECT o_orderkey, 1.0 / (1.0 + exp(-({_Z_SQL}))) AS p FROM orders)""")
def threshold_predictions(spark, sf_dir):
    s = _score(spark, sf_dir)
    return s.select("o_orderkey", S.threshold("probability", 0.5, inclusive=False).alias("pred_gt"),
                    S.threshold("probability", 0.5, inclusive=True).alias("pred_ge"))


@query("rename_columns", oracle=Q.with_(Q.BOARD) + """
SELECT l_orderkey, l_linenumber, Library AS Library_Name, Model_Type FROM board""")
def rename_columns(spark, sf_dir):
    b = SI.board_runs(spark, sf_dir).select("l_orderkey", "l_linenumber", "Library", "Model_Type")
    return clean.rename_columns(b, {"Library": "Library_Name"})


@query("sentinel_to_null", oracle=Q.with_(Q.BOARD) + """
SELECT l_orderkey, l_linenumber, Library, Model_Type,
       nullif(Duration_ns, -999999) AS Duration_ns, nullif(CPU_Energy_J, -999999) AS CPU_Energy_J,
       nullif(Accuracy_Pct, -999999) AS Accuracy_Pct, nullif(Precision_Pct, -999999) AS Precision_Pct,
       nullif(MSE, -999999) AS MSE, nullif(r2_score, -999999) AS r2_score
FROM board""")
def sentinel_to_null(spark, sf_dir):
    return clean.sentinel_to_null(SI.board_runs(spark, sf_dir))


@query("value_or_sentinel", oracle=f"""
SELECT l_orderkey, l_linenumber, coalesce(l_discount, -999999.0) AS l_discount,
       coalesce(nullif(l_returnflag, 'N'), 'FAILED') AS Model_Name
FROM ({_LI_NULLS_SQL})""")
def value_or_sentinel(spark, sf_dir):
    t = _lineitem_with_nulls(spark, sf_dir)
    return t.select("l_orderkey", "l_linenumber",
                    S.value_or_sentinel("l_discount", float(S.SENTINEL)).alias("l_discount"),
                    S.value_or_sentinel(F.nullif("l_returnflag", F.lit("N")), "FAILED").alias("Model_Name"))


@query("guarded_ratio", oracle="""
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN l_tax / l_discount END AS tax_per_discount FROM lineitem""")
def guarded_ratio(spark, sf_dir):
    li = SI.table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", S.guarded_ratio("l_tax", "l_discount").alias("tax_per_discount"))


@query("plain_ratio", oracle="""
SELECT l_orderkey, l_linenumber, l_tax / nullif(l_discount, 0) AS tax_per_discount,
       (l_discount * 100.0) / nullif(l_extendedprice / 1000.0, 0) AS M5_Energy_Efficiency FROM lineitem""")
def plain_ratio(spark, sf_dir):
    li = SI.table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     S.plain_ratio("l_tax", "l_discount").alias("tax_per_discount"),
                     S.plain_ratio(F.col("l_discount") * F.lit(100.0), F.col("l_extendedprice") / F.lit(1000.0))
                     .alias("M5_Energy_Efficiency"))


@query("unit_convert", oracle="""
SELECT l_orderkey, l_linenumber, CAST(l_quantity * 1000000000 AS BIGINT) / 1e9 AS Duration_s,
       l_discount * 100.0 AS discount_pct,
       (epoch_us(l_shipdate) - epoch_us(TIMESTAMP '1992-01-01 00:00:00')) / 1e6 AS ship_offset_s
FROM lineitem""")
def unit_convert(spark, sf_dir):
    li = SI.table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     S.ns_to_s((F.col("l_quantity") * F.lit(1_000_000_000)).cast("bigint")).alias("Duration_s"),
                     S.fraction_to_pct("l_discount").alias("discount_pct"),
                     S.interval_seconds(F.lit("1992-01-01 00:00:00").cast("timestamp_ntz"), "l_shipdate")
                     .alias("ship_offset_s"))


@query("tag_platform", oracle="SELECT l_orderkey, l_linenumber, l_returnflag, 'CPU' AS Platform FROM lineitem")
def tag_platform(spark, sf_dir):
    li = SI.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return clean.tag_platform(li, "CPU")


@query("build_key", oracle="""
SELECT l_orderkey, l_linenumber, concat_ws('_', l_returnflag, l_linestatus) AS run_key,
       split_part(concat_ws('_', l_returnflag, l_linestatus), '_', 1) AS library
FROM lineitem""")
def build_key(spark, sf_dir):
    li = SI.table(spark, sf_dir, "lineitem")
    k = li.select("l_orderkey", "l_linenumber", S.build_key("l_returnflag", "l_linestatus").alias("run_key"))
    return k.withColumn("library", S.key_prefix("run_key"))


@query("parse_power_time", oracle="""
SELECT event_id,
       concat(year(ts), '-', month(ts), '-', day(ts), ' ', hour(ts), ':', minute(ts), ':', second(ts), '.',
              (epoch_us(ts) // 1000) % 1000) AS power_text,
       date_trunc('millisecond', ts) AS parsed_ts
FROM events""")
def parse_power_time(spark, sf_dir):
    ev = SI.table(spark, sf_dir, "events")
    t = ev.select("event_id", S.power_time_text("ts").alias("power_text"))
    return t.withColumn("parsed_ts", S.parse_power_time("power_text", "integer"))


@query("derive_laptop_metrics", oracle=Q.with_(Q.LAPTOP) + """
SELECT l_orderkey, l_linenumber, Platform, Library_Name, M2_Total_Energy_J, M3_Execution_Time_s,
       M4_Model_Accuracy, M5_Energy_Efficiency FROM lm""")
def derive_laptop_metrics(spark, sf_dir):
    return SI.laptop_metrics(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "Platform", "Library_Name", "M2_Total_Energy_J", "M3_Execution_Time_s",
        "M4_Model_Accuracy", "M5_Energy_Efficiency")


@query("derive_board_metrics", oracle=Q.with_(Q.BOARD) + """
SELECT l_orderkey, l_linenumber, Library_Name, Duration_s, M1_Avg_Power_W, M2_Total_Energy_J, M3_Exec_Time_s,
       M5_Energy_Efficiency FROM bm""")
def derive_board_metrics(spark, sf_dir):
    return SI.board_metrics(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "Library_Name", "Duration_s", "M1_Avg_Power_W", "M2_Total_Energy_J",
        "M3_Exec_Time_s", "M5_Energy_Efficiency")


@query("filter_not_null", oracle=Q.with_(Q.BOARD) + """
SELECT l_orderkey, l_linenumber, Library_Name, Accuracy_Pct FROM bm WHERE Accuracy_Pct IS NOT NULL""")
def filter_not_null(spark, sf_dir):
    b = SI.board_metrics(spark, sf_dir)
    return b.where(F.col("Accuracy_Pct").isNotNull()).select("l_orderkey", "l_linenumber", "Library_Name", "Accuracy_Pct")


@query("format_label", oracle=Q.with_(Q.BOARD) + """
SELECT Library_Name,
       CASE WHEN avg(MSE) > 1000 THEN printf('%.2e', avg(MSE)) ELSE printf('%.2f', avg(MSE)) END AS mse_label,
       CASE WHEN avg(Duration_ns) > 1000 THEN printf('%.2e', avg(Duration_ns)) ELSE printf('%.2f', avg(Duration_ns)) END
         AS duration_label,
       printf('%.2f%%', avg(Accuracy_Pct)) AS accuracy_label,
       printf('%.3f', avg(r2_score)) AS r2_label
FROM bm GROUP BY Library_Name""")
def format_label(spark, sf_dir):
    b = SI.board_metrics(spark, sf_dir)
    g = b.groupBy("Library_Name").agg(F.avg("MSE").alias("m"), F.avg("Duration_ns").alias("d"),
                                      F.avg("Accuracy_Pct").alias("a"), F.avg("r2_score").alias("r"))
    return g.select("Library_Name", S.format_sci_or_fixed("m").alias("mse_label"),
                    S.format_sci_or_fixed("d").alias("duration_label"),
                    S.format_fixed("a", 2, "%%").alias("accuracy_label"),
                    S.format_fixed("r", 3).alias("r2_label"))
