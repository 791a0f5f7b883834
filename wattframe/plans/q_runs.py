"""Design, lookup, latest-row, run order, ranks, unions and the run table."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattframe.operators import energy, runs
from wattframe.operators.ranking import value_counts_ranked
from wattframe.plans import standins as SI
from wattframe.plans.catalog import query
from wattframe.plans.common import rounded

REPS = 15

_DESIGN_SQL = f"""
WITH f1 AS (SELECT DISTINCT l_returnflag AS v FROM lineitem),
f2 AS (SELECT DISTINCT l_linestatus AS v FROM lineitem),
c AS (SELECT f1.v AS Library, f2.v AS Model_Type,
             CAST((dense_rank() OVER (ORDER BY f1.v) - 1) * (SELECT count(*) FROM f2)
                  + (dense_rank() OVER (ORDER BY f2.v) - 1) AS INTEGER) AS combo
      FROM f1 CROSS JOIN f2),
design AS (
  SELECT Library, Model_Type, combo, CAST(r.rep AS INTEGER) AS rep,
         'run_' || combo || '_repetition_' || r.rep AS run_id
  FROM c CROSS JOIN range(0, {REPS}) r(rep))
"""


def _design(spark, sf_dir):
    li = SI.table(spark, sf_dir, "lineitem")
    return runs.design_matrix(li, ["l_returnflag", "l_linestatus"], REPS, ["Library", "Model_Type"])


@query("design_matrix", oracle=_DESIGN_SQL + "SELECT * FROM design")
def design_matrix(spark, sf_dir):
    return _design(spark, sf_dir)


@query("design_exclude", oracle=_DESIGN_SQL + "SELECT * FROM design WHERE NOT (Library = 'R' AND Model_Type = 'F')")
def design_exclude(spark, sf_dir):
    excl = spark.createDataFrame([("R", "F")], "Library string, Model_Type string")
    return runs.design_exclude(_design(spark, sf_dir), excl, ["Library", "Model_Type"])


@query("shuffle_design", oracle=_DESIGN_SQL + """,
h AS (SELECT *, ('0x' || substr(md5('42:' || run_id), 1, 8))::BIGINT AS order_key FROM design)
SELECT *, CAST(row_number() OVER (ORDER BY order_key, run_id) - 1 AS BIGINT) AS position FROM h""")
def shuffle_design(spark, sf_dir):
    return runs.shuffle_design(_design(spark, sf_dir), "run_id", seed=42)


@query("lookup_by_key", oracle="""
SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def lookup_by_key(spark, sf_dir):
    cust = SI.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nat = SI.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return runs.lookup_by_key(cust, nat, "c_nationkey", "n_nationkey").select("c_custkey", "c_nationkey", "n_name")


@query("latest_per_key", oracle="""
SELECT user_id, event_type, ts, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_key(spark, sf_dir):
    ev = SI.table(spark, sf_dir, "events")
    return runs.latest_per_key(ev, ["user_id", "event_type"], ["ts", "event_id"], ["value"])


@query("run_blocks", oracle="""
WITH r AS (SELECT user_id AS run_id, min(ts) AS start_ts FROM events GROUP BY user_id),
n AS (SELECT *, row_number() OVER (ORDER BY start_ts, run_id) AS run_number FROM r)
SELECT run_id, start_ts, run_number, CAST(ceil(run_number / 45) AS BIGINT) AS block,
       (run_number % 45 = 0) AND run_number < 150 AS block_end
FROM n""")
def run_blocks(spark, sf_dir):
    s = SI.power_samples(spark, sf_dir)
    r = energy.first_sample(s, ["run_id"], [], order_cols=["seq"])
    return runs.run_blocks(r, ["start_ts", "run_id"])


@query("rank_with_ties", oracle="""
WITH c AS (SELECT l_quantity, count(*) AS n_ties FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY l_quantity),
s AS (SELECT *, CAST(sum(n_ties) OVER (ORDER BY l_quantity) - n_ties AS BIGINT) AS cum_before,
             CAST(sum(n_ties) OVER () AS BIGINT) AS n_group FROM c)
SELECT l_quantity, n_ties, cum_before, cum_before + (n_ties + 1) / 2.0 AS mid_rank, n_group FROM s""")
def rank_with_ties(spark, sf_dir):
    return value_counts_ranked(SI.table(spark, sf_dir, "lineitem"), "l_quantity")


_ENERGY_RUN_SQL = """
WITH s AS (SELECT user_id AS run_id, event_id AS seq, ts, value AS cpu_w FROM events),
d AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY run_id ORDER BY ts, seq)) / 1e6 AS dt FROM s),
f AS (SELECT *, coalesce(dt, ((epoch_us(max(ts) OVER w) - epoch_us(min(ts) OVER w)) / 1e6)
                              / nullif(count(*) OVER w - 1, 0)) AS dt_fill FROM d WINDOW w AS (PARTITION BY run_id)),
e AS (SELECT run_id, min(ts) AS start_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS span_s,
             coalesce(sum(cpu_w * dt_fill), 0) AS energy_j FROM f GROUP BY run_id),
m AS (SELECT o_custkey, o_orderpriority AS model, o_totalprice / 5000.0 AS accuracy_pct FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
"""


@query("assemble_run_table", oracle=_ENERGY_RUN_SQL + """
SELECT c_custkey AS run_id, c_mktsegment AS Library, start_ts AS Timestamp_Start,
       coalesce(CAST(round(span_s * 1e9) AS BIGINT), -999999) AS Duration_ns,
       round(coalesce(energy_j, 0.0), 2) AS CPU_Energy_J, coalesce(accuracy_pct, -999999.0) AS Accuracy_Pct,
       coalesce(model, 'FAILED') AS Model_Name
FROM customer LEFT JOIN e ON c_custkey = e.run_id LEFT JOIN m ON c_custkey = m.o_custkey""")
def assemble_run_table(spark, sf_dir):
    return rounded(assembled_run_table(spark, sf_dir), {"CPU_Energy_J": 2})


def assembled_run_table(spark, sf_dir):
    s = SI.power_samples(spark, sf_dir)
    e = energy.energy_per_run(s, ["run_id"], ["cpu_w"], order_cols=["seq"]).select(
        F.col("run_id").alias("e_run"), "start_ts", "span_s", F.col("cpu_w_energy_j").alias("energy_j"))
    o = SI.table(spark, sf_dir, "orders")
    m = runs.latest_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderpriority", "o_totalprice"])
    m = m.select(F.col("o_custkey").alias("m_run"), F.col("o_orderpriority").alias("model"),
                 (F.col("o_totalprice") / F.lit(5000.0)).alias("accuracy_pct"))
    r = SI.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("Library"))
    return runs.assemble_run_table(r, e, m, "c_custkey", "e_run", "m_run")


@query("union_platforms", oracle="""
SELECT l_orderkey, l_linenumber, l_returnflag AS Library_Name, l_extendedprice / 1000.0 AS Total_Energy_J,
       l_quantity AS Time_Taken_s, 'CPU' AS Platform FROM lineitem WHERE l_linestatus = 'F'
UNION ALL BY NAME
SELECT l_orderkey, l_linenumber, l_returnflag AS Library_Name, l_extendedprice / 1000.0 AS Total_Energy_J,
       l_discount * 100.0 AS Accuracy_Pct, 'GPU' AS Platform FROM lineitem WHERE l_linestatus = 'O'""")
def union_platforms(spark, sf_dir):
    li = SI.table(spark, sf_dir, "lineitem")
    base = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag").alias("Library_Name"),
            (F.col("l_extendedprice") / F.lit(1000.0)).alias("Total_Energy_J")]
    cpu = li.where(F.col("l_linestatus") == "F").select(*base, F.col("l_quantity").alias("Time_Taken_s"))
    gpu = li.where(F.col("l_linestatus") == "O").select(*base, (F.col("l_discount") * F.lit(100.0)).alias("Accuracy_Pct"))
    from wattframe.operators.clean import tag_platform
    return runs.union_by_name([tag_platform(cpu, "CPU"), tag_platform(gpu, "GPU")])


_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
_LOGS_SQL = f"""
logs AS (
  SELECT ts AS timestamp, event_type AS model, value / 500.0 AS accuracy, {_K} / 100.0 AS precision,
         (value + {_K}) / 600.0 AS recall, (value / 500.0 + {_K} / 100.0) / 2.0 AS f1
  FROM events WHERE event_type IN ('click', 'view', 'signup')
  UNION ALL BY NAME
  SELECT ts AS timestamp, event_type AS model, value / 500.0 AS accuracy, (value + {_K}) / 600.0 AS recall,
         (value / 500.0 + {_K} / 100.0) / 2.0 AS f1, 2 AS num_classes
  FROM events WHERE event_type NOT IN ('click', 'view', 'signup'))
"""


def _metrics_layouts(spark, sf_dir):
    """The two metrics-log layouts (F1 spelled ``f1`` / ``f1_score``; precision or class count)."""
    ev = SI.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    acc = F.col("value") / F.lit(500.0)
    recall = (F.col("value") + k) / F.lit(600.0)
    f1 = (acc + k / F.lit(100.0)) / F.lit(2.0)
    a_types = ["click", "view", "signup"]
    log_a = ev.where(F.col("event_type").isin(a_types)).select(
        F.col("ts").alias("timestamp"), F.col("event_type").alias("model"), acc.alias("accuracy"),
        (k / F.lit(100.0)).alias("precision"), recall.alias("recall"), f1.alias("f1"))
    log_b = ev.where(~F.col("event_type").isin(a_types)).select(
        F.col("ts").alias("timestamp"), F.col("event_type").alias("model"), acc.alias("accuracy"),
        recall.alias("recall"), f1.alias("f1_score"), F.lit(2).alias("num_classes"))
    return log_a, log_b


def _metrics_logs(spark, sf_dir):
    log_a, log_b = _metrics_layouts(spark, sf_dir)
    return runs.union_by_name([log_a, log_b], renames={"f1_score": "f1"})


@query("union_metrics_logs", oracle="WITH " + _LOGS_SQL + " SELECT * FROM logs")
def union_metrics_logs(spark, sf_dir):
    return _metrics_logs(spark, sf_dir)


@query("unpack_metrics", oracle="WITH " + _LOGS_SQL + """
SELECT timestamp, model, recall, f1, num_classes,
       coalesce(accuracy * 100.0, -999999.0) AS Accuracy_Pct, coalesce(precision * 100.0, -999999.0) AS Precision_Pct,
       CAST(-999999 AS DOUBLE) AS MSE, CAST(-999999 AS DOUBLE) AS r2_score,
       accuracy IS NOT NULL OR precision IS NOT NULL AS measurements_class, false AS measurements_reg,
       NOT (accuracy IS NOT NULL OR precision IS NOT NULL) AS failed
FROM logs""")
def unpack_metrics(spark, sf_dir):
    return runs.unpack_metrics(_metrics_logs(spark, sf_dir))


_MODEL_SQL = f"""
k AS (SELECT event_type AS model, ts, event_id, value, {_K} AS g FROM events),
lastm AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY model ORDER BY ts DESC, event_id DESC) = 1),
lib AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal,
               list_extract(['click', 'view', 'purchase', 'none'], CAST(c_custkey % 4 AS INTEGER) + 1) AS asked FROM customer)
"""


def _last_metrics(spark, sf_dir):
    """The latest metrics row of every model (event type): classification values for
    one type, regression values for the others."""
    ev = SI.table(spark, sf_dir, "events").withColumn("g", F.get_json_object("props", "$.k").cast("double"))
    last = runs.latest_per_key(ev, ["event_type"], ["ts", "event_id"], ["value", "g"])
    cls = F.col("event_type") == "click"
    log = last.select(F.col("event_type").alias("model"), F.when(cls, F.col("value") / F.lit(500.0)).alias("accuracy"),
                      F.when(cls, F.col("g") / F.lit(100.0)).alias("precision"), F.when(~cls, F.col("value")).alias("MSE"),
                      F.when(~cls, F.lit(1.0) - F.col("g") / F.lit(100.0)).alias("r2_score"))
    return runs.unpack_metrics(log)


BOARD_RUN_TABLE_SQL = (_ENERGY_RUN_SQL + "," + _MODEL_SQL + """
SELECT 'run_' || c_custkey AS __run_id, 'DONE' AS __done, c_mktsegment AS Library, 'NN' AS Model_Type, start_ts AS Timestamp_Start,
       coalesce(CASE WHEN c_acctbal > 0 THEN CAST(round(c_acctbal * 1e9) AS BIGINT) END, CAST(round(span_s * 1e9) AS BIGINT), -999999) AS Duration_ns,
       round(coalesce(energy_j, 0.0), 2) AS CPU_Energy_J,
       CASE WHEN lastm.model = 'click' THEN value / 500.0 * 100.0 ELSE -999999.0 END AS Accuracy_Pct,
       CASE WHEN lastm.model = 'click' THEN g / 100.0 * 100.0 ELSE -999999.0 END AS Precision_Pct,
       CASE WHEN lastm.model <> 'click' THEN value ELSE -999999.0 END AS MSE,
       CASE WHEN lastm.model <> 'click' THEN 1.0 - g / 100.0 ELSE -999999.0 END AS r2_score, coalesce(lastm.model, 'FAILED') AS Model_Name
FROM lib LEFT JOIN e ON c_custkey = e.run_id LEFT JOIN lastm ON asked = lastm.model""")


@query("assemble_board_run_table", oracle=BOARD_RUN_TABLE_SQL)
def assemble_board_run_table(spark, sf_dir):
    return rounded(board_run_table(spark, sf_dir), {"CPU_Energy_J": 2})


def board_run_table(spark, sf_dir):
    """Run = customer: its samples' energy, the balance (if positive) as measured seconds,
    the latest metrics of the model it asked for (one in four asks for none)."""
    s = SI.power_samples(spark, sf_dir)
    e = energy.energy_per_run(s, ["run_id"], ["cpu_w"], order_cols=["seq"]).select(
        F.col("run_id").alias("e_run"), "start_ts", "span_s", F.col("cpu_w_energy_j").alias("energy_j"))
    c = SI.table(spark, sf_dir, "customer")
    asked = F.get(F.array(*map(F.lit, ("click", "view", "purchase", "none"))), (F.col("c_custkey") % 4).cast("int"))
    r = c.select("c_custkey", F.col("c_mktsegment").alias("Library"), F.lit("NN").alias("Model_Type"), asked.alias("asked"),
                 F.when(F.col("c_acctbal") > 0, F.round(F.col("c_acctbal") * F.lit(1e9)).cast("bigint")).alias("duration_ns"))
    m = r.select(F.col("c_custkey").alias("m_run"), "asked").join(_last_metrics(spark, sf_dir), F.col("asked") == F.col("model")).drop("asked")
    return runs.assemble_board_run_table(r, e, m, "c_custkey", "e_run", "m_run")


LAPTOP_RUN_TABLE_SQL = ("""
WITH p AS (SELECT user_id, min(ts) AS start_ts, sum(value) AS cpu, sum(""" + _K + """) AS gpu FROM events GROUP BY user_id),
m AS (SELECT o_custkey, o_orderpriority AS model, o_totalprice / 5000.0 AS acc FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT 'run_' || c_custkey AS __run_id, 'DONE' AS __done, c_mktsegment || '_CPU' AS Block_Type, c_mktsegment AS Library_Name,
       start_ts AS Timestamp_Start, CAST(round(coalesce(cpu * abs(c_acctbal), 0) + coalesce(gpu * abs(c_acctbal), 0)) AS BIGINT) AS Total_Energy_J,
       CAST(round(coalesce(cpu * abs(c_acctbal), 0)) AS BIGINT) AS CPU_Energy_J, CAST(round(coalesce(gpu * abs(c_acctbal), 0)) AS BIGINT) AS GPU_Energy_J,
       abs(c_acctbal) AS Time_Taken_s, coalesce(acc, 0.0) AS Accuracy_Pct, coalesce(model, 'FAILED') AS Model_Name
FROM customer LEFT JOIN p ON c_custkey = user_id LEFT JOIN m ON c_custkey = o_custkey""")


@query("assemble_laptop_run_table", oracle=LAPTOP_RUN_TABLE_SQL)
def assemble_laptop_run_table(spark, sf_dir):
    return laptop_run_table(spark, sf_dir)


def laptop_run_table(spark, sf_dir):
    """Run = customer: constant-step energies over the balance as seconds, latest metrics."""
    s = SI.power_samples(spark, sf_dir)
    c = SI.table(spark, sf_dir, "customer").withColumn("seconds", F.abs(F.col("c_acctbal")))
    e = energy.energy_constant_step(s, c.select(F.col("c_custkey").alias("run_id"), "seconds"), ["run_id"], "seconds", "cpu_w", "gpu_w")
    starts = energy.first_sample(s, ["run_id"], [], order_cols=["seq"])
    e = e.join(starts, "run_id").select(F.col("run_id").alias("e_run"), "start_ts", F.col("cpu_energy_j").alias("cpu_j"), F.col("gpu_energy_j").alias("gpu_j"))
    o = SI.table(spark, sf_dir, "orders")
    m = runs.latest_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderpriority", "o_totalprice"]).select(
        F.col("o_custkey").alias("m_run"), F.col("o_orderpriority").alias("model"), (F.col("o_totalprice") / F.lit(5000.0)).alias("accuracy_pct"))
    r = c.select("c_custkey", F.concat("c_mktsegment", F.lit("_CPU")).alias("Block_Type"), "seconds")
    out = runs.assemble_laptop_run_table(r, e, m, "c_custkey", "e_run", "m_run")
    for j in ("Total_Energy_J", "CPU_Energy_J", "GPU_Energy_J"):
        out = out.withColumn(j, F.round(j).cast("bigint"))
    return out
