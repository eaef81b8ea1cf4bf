"""Bindings of the given tables to event logs, with the same bindings as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracemill.log import LogSpec, measure_hot

# Decision classes: 2 approved, 1 denied, 0 cancelled.
APPROVED, DENIED, CANCELLED = 2, 1, 0
E_DECISIONS = {"purchase": APPROVED, "error": DENIED, "signup": CANCELLED}
L_DECISIONS = {"R+O": APPROVED, "A+F": DENIED, "N+F": CANCELLED}

L_TIES = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    "l_quantity", "l_discount", "l_tax", "activity", "lifecycle",
)
L_KEY = ["case_id", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
STATICS = {"amount": "amount", "goal": "goal", "type": "type"}
OFFER = ["credit", "cost", "offered"]

_HOT: dict[tuple, LogSpec] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def data_key(spark: SparkSession, sf_dir: str) -> tuple:
    """What names the given tables as they are now: session, path, and length and time of each table's files."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = []
    for name in ("lineitem", "orders", "events", "customer", "part", "supplier", "nation", "region"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            for f in fs.listStatus(path):
                files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return (spark.sparkContext.applicationId, sf_dir, tuple(sorted(files)))


def measured(spark: SparkSession, sf_dir: str, name: str, df: DataFrame, spec: LogSpec) -> LogSpec:
    """Hot cases are measured once per log and session."""
    key = (data_key(spark, sf_dir), name)
    if key not in _HOT:
        _HOT[key] = measure_hot(df, spec)
    return _HOT[key]


def log_l(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, LogSpec]:
    """Order lines as a log: an order is a case, a shipped line an event."""
    is_offer = F.col("l_returnflag") == "N"
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_returnflag").alias("activity"),
        F.col("l_linestatus").alias("lifecycle"),
        F.concat("l_returnflag", F.lit("+"), "l_linestatus").alias("token"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
        F.when(is_offer, F.when(F.col("l_quantity") <= 5, 0.0).otherwise(F.col("l_quantity"))).alias("credit"),
        F.when(is_offer, F.col("l_discount")).alias("cost"),
        F.when(is_offer & (F.col("l_tax") > 0), F.col("l_tax")).alias("offered"),
    )
    spec = LogSpec(ties=L_TIES)
    return df, measured(spark, sf_dir, "L", df, spec)


def order_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case attributes of the order-line log; amounts under 50,000 count as zero."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        F.when(F.col("o_totalprice") < 50000, 0.0).otherwise(F.col("o_totalprice")).alias("amount"),
        F.col("o_orderpriority").alias("goal"),
        F.col("o_orderstatus").alias("type"),
    )


def log_lo(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, LogSpec]:
    """Order-line log with the case attributes repeated on every event."""
    df, spec = log_l(spark, sf_dir)
    return df.join(order_cases(spark, sf_dir), "case_id"), spec


def log_e(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, LogSpec]:
    """User events as a log: one user on one day is a case."""
    ts = F.col("ts").cast("timestamp")
    df = table(spark, sf_dir, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("case_id"),
        F.col("event_type").alias("activity"),
        ts.alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("amount"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("user_id").alias("resource"),
    )
    spec = LogSpec(lifecycle=None)
    return df, measured(spark, sf_dir, "E", df, spec)


def micros(col: str) -> Column:
    """Timestamps leave as epoch microseconds."""
    return F.unix_micros(col)


ORD = (
    "ts, l_linenumber, l_partkey, l_suppkey, l_extendedprice, "
    "l_quantity, l_discount, l_tax, activity, lifecycle"
)
L = """l AS (SELECT l_orderkey AS case_id, l_returnflag AS activity, l_linestatus AS lifecycle,
  l_returnflag || '+' || l_linestatus AS token, l_shipdate AS ts,
  l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax,
  CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_quantity <= 5 THEN 0.0 ELSE l_quantity END END AS credit,
  CASE WHEN l_returnflag = 'N' THEN l_discount END AS cost,
  CASE WHEN l_returnflag = 'N' AND l_tax > 0 THEN l_tax END AS offered
  FROM lineitem)"""
O = """o AS (SELECT o_orderkey AS case_id,
  CASE WHEN o_totalprice < 50000 THEN 0.0 ELSE o_totalprice END AS amount,
  o_orderpriority AS goal, o_orderstatus AS type FROM orders)"""
LO = f"{L}, {O}, lo AS (SELECT l.*, o.amount, o.goal, o.type FROM l JOIN o ON l.case_id = o.case_id)"
L_CLASS = "CASE token WHEN 'R+O' THEN 2 WHEN 'A+F' THEN 1 WHEN 'N+F' THEN 0 END"
# Events with position and the position of the last decision of the case.
LP = f"""lp AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {ORD}) - 1 AS pos,
  {L_CLASS} AS cls FROM l)"""
LD = """ld AS (SELECT *, max(CASE WHEN cls IS NOT NULL THEN pos END) OVER (PARTITION BY case_id) AS dpos FROM lp)"""
LC = "lc AS (SELECT * FROM ld WHERE dpos IS NULL OR pos <= dpos)"
CUT = f"{L}, {LP}, {LD}, {LC}"
E = """e AS (SELECT concat_ws(':', CAST(user_id AS VARCHAR), CAST(CAST(ts AS DATE) AS VARCHAR)) AS case_id,
  event_type AS activity, ts, event_id AS seq, value AS amount,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id AS resource FROM events)"""
E_CLASS = "CASE activity WHEN 'purchase' THEN 2 WHEN 'error' THEN 1 WHEN 'signup' THEN 0 END"
EP = f"""ep AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, seq) - 1 AS pos,
  {E_CLASS} AS cls FROM e)"""
# One row per case of the order-line log, cut at the last decision.
CASES = f"""{CUT}, {O},
  cases AS (SELECT lc.case_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS n_events,
    max(cls) FILTER (WHERE pos = dpos) AS outcome,
    max(token) FILTER (WHERE pos = dpos) AS outcome_event,
    max(o.amount) AS amount, max(o.goal) AS goal, max(o.type) AS type
    FROM lc JOIN o ON o.case_id = lc.case_id GROUP BY lc.case_id),
  decided AS (SELECT * FROM cases WHERE outcome IS NOT NULL)"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
