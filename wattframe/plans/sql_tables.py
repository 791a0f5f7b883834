"""DuckDB text of the stand-in tables (mirrors ``standins``), used by the oracles."""

LAPTOP = """
laptop AS (
  SELECT l_orderkey, l_linenumber, l_returnflag AS Platform, l_linestatus AS Library_Name,
         l_extendedprice / 1000.0 AS Total_Energy_J, l_quantity AS Time_Taken_s,
         l_discount * 100.0 AS Accuracy_Pct
  FROM lineitem),
lm AS (
  SELECT *, Total_Energy_J AS M2_Total_Energy_J, Time_Taken_s AS M3_Execution_Time_s,
         Accuracy_Pct AS M4_Model_Accuracy, Accuracy_Pct / nullif(Total_Energy_J, 0) AS M5_Energy_Efficiency
  FROM laptop)"""

BOARD = """
board AS (
  SELECT l_orderkey, l_linenumber, l_returnflag AS Library, l_linestatus AS Model_Type,
         CAST(l_quantity * 1000000000 AS BIGINT) AS Duration_ns,
         l_extendedprice / 1000.0 AS CPU_Energy_J,
         CASE WHEN l_linestatus = 'O' THEN l_discount * 100.0 ELSE -999999.0 END AS Accuracy_Pct,
         CASE WHEN l_linestatus = 'O' AND l_tax > 0 THEN l_tax * 100.0 ELSE -999999.0 END AS Precision_Pct,
         CASE WHEN l_linestatus <> 'O' THEN l_quantity * l_tax ELSE -999999.0 END AS MSE,
         CASE WHEN l_linestatus <> 'O' THEN 1.0 - l_discount ELSE -999999.0 END AS r2_score
  FROM lineitem),
bc AS (
  SELECT l_orderkey, l_linenumber, Library AS Library_Name, Model_Type,
         nullif(Duration_ns, -999999) AS Duration_ns, nullif(CPU_Energy_J, -999999) AS CPU_Energy_J,
         nullif(Accuracy_Pct, -999999) AS Accuracy_Pct, nullif(Precision_Pct, -999999) AS Precision_Pct,
         nullif(MSE, -999999) AS MSE, nullif(r2_score, -999999) AS r2_score
  FROM board),
bd AS (SELECT *, Duration_ns / 1e9 AS Duration_s FROM bc),
bm AS (
  SELECT *, CASE WHEN Duration_s > 0 THEN CPU_Energy_J / Duration_s END AS M1_Avg_Power_W,
         CPU_Energy_J AS M2_Total_Energy_J, Duration_s AS M3_Exec_Time_s,
         CASE WHEN CPU_Energy_J > 0 THEN Accuracy_Pct / CPU_Energy_J END AS M5_Energy_Efficiency
  FROM bd)"""

REGRESSION = """
reg AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, p_size, p_retailprice, p_type, l_extendedprice
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n"
