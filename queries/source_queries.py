"""Queries that go through the sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from queries.bindings import CASES, L, LD, LP, O, log_l, micros, order_cases, table, with_
from queries.encoding_queries import CANON, canonical
from queries.partition_queries import ALL_LAYOUTS, DESIGN, RECORDS, SPLIT, decided, layout_sql, records
from queries.profile_queries import rounded
from queries.registry import query
from tracemill.functions.quantiles import with_scalars
from tracemill.log import LogSpec
from tracemill.operators import partition as P
from tracemill.plans.partitioning import partition
from tracemill.session import shared_folder
from tracemill.sources import tables as S
from tracemill.sources.xes import read_xes


def _fresh(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tracemill/{name}-{uuid.uuid4().hex}"


def _xes_documents(spark, sf):
    """One trace per order: placed on its date (an hour ahead of UTC), closed a day later without optional attributes."""

    def attr(key, value):
        return F.struct(F.lit(key).alias("_key"), value.cast("string").alias("_value"))

    none = F.lit(None).cast("array<struct<_key:string,_value:string>>")
    day, nxt = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd")
    placed = F.struct(
        F.array(attr("concept:name", F.col("o_orderstatus"))).alias("string"),
        F.array(attr("time:timestamp", F.concat(day, F.lit("T10:30:00.250+01:00")))).alias("date"),
        F.array(attr("score", F.col("o_custkey"))).alias("int"),
        F.array(attr("first", F.lit("true"))).alias("boolean"),
    )
    closed = F.struct(
        F.array(attr("concept:name", F.lit("close"))).alias("string"),
        F.array(attr("time:timestamp", F.concat(nxt, F.lit("T00:00:00.000Z")))).alias("date"),
        none.alias("int"), none.alias("boolean"),
    )
    return table(spark, sf, "orders").select(
        F.array(attr("concept:name", F.col("o_orderkey")), attr("LoanGoal", F.col("o_orderpriority"))).alias("string"),
        F.array(attr("RequestedAmount", F.col("o_totalprice"))).alias("float"),
        F.array(placed, closed).alias("event"),
    )


_EVENT = {"concept:name": "string", "time:timestamp": "timestamp", "score": "long", "first": "boolean"}
_CASE = {"RequestedAmount": "double", "LoanGoal": "string"}
_XES_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS case_id, o_totalprice AS amount, o_orderpriority AS goal, 0 AS seq, o_orderstatus AS activity,
  epoch_us(o_orderdate) + 34200250000 AS us, o_custkey AS score, true AS first FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_totalprice, o_orderpriority, 1, 'close', epoch_us(o_orderdate) + 86400000000, NULL, NULL FROM orders"""


def _xes(spark, sf, split_files):
    path = _fresh(spark, "xes")
    _xes_documents(spark, sf).write.format("xml").option("rootTag", "log").option("rowTag", "trace").save(path)
    df = read_xes(spark, path, _EVENT, _CASE, split_files)
    return df.select(
        F.col("`case:concept:name`").alias("case_id"), F.col("`case:RequestedAmount`").alias("amount"), F.col("`case:LoanGoal`").alias("goal"),
        "seq", F.col("`concept:name`").alias("activity"), micros("time:timestamp").alias("us"), "score", "first",
    )


@query("S01_read_xes_split_files", _XES_SQL)
def read_xes_split(spark, sf):
    return _xes(spark, sf, True)


@query("S01_read_xes_many_files", _XES_SQL)
def read_xes_many(spark, sf):
    return _xes(spark, sf, False)


@query("S02_read_event_log", "SELECT count(*) AS events, count(DISTINCT user_id) AS cases, epoch_us(max(ts)) AS last_us FROM events")
def read_event_log(spark, sf):
    spec = LogSpec(case="user_id", activity="event_type", lifecycle=None, ties=("event_id",))
    df = S.read_event_log(spark, f"{sf}/events.parquet", spec)
    return with_scalars(S.log_totals(df, "user_id"), df.agg(F.max(micros("ts")).alias("last_us")))


_COUNT = "SELECT client_id AS bank, split, count(*) AS n_events, count(DISTINCT case_id) AS n_cases FROM canon GROUP BY client_id, split"


def _counts(df):
    per_case = df.groupBy("bank", "split", "case_id").agg(F.count(F.lit(1)).alias("n"))
    return per_case.groupBy("bank", "split").agg(F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_cases"))


@query("S03_scan_splits", with_(CANON) + _COUNT)
def scan_splits(spark, sf):
    """Files named by bank and split, found and read in one scan."""
    path = _fresh(spark, "named")
    events = canonical(spark, sf).select("case_id", "event_index", F.concat_ws("_", F.lit("L"), F.lit("bank"), "client_id", "split").alias("file"))
    events.write.partitionBy("file").parquet(path)
    return _counts(S.require_splits(S.scan_splits(spark, path, "L"), ["A", "B", "C"]))


@query("S03_missing_splits", with_(CANON) + """
, w AS (SELECT * FROM (VALUES ('A'), ('B'), ('D')) b(bank), (VALUES ('train'), ('val'), ('test')) s(split))
SELECT bank, split FROM w WHERE (bank, split) NOT IN (SELECT client_id, split FROM canon)
UNION ALL SELECT DISTINCT client_id, NULL FROM canon WHERE client_id NOT IN ('A', 'B', 'D')""")
def missing_splits(spark, sf):
    return S.missing_splits(canonical(spark, sf).withColumnRenamed("client_id", "bank"), ["A", "B", "D"])


@query("S04_write_splits", with_(CANON) + _COUNT)
def write_splits(spark, sf):
    path = _fresh(spark, "splits")
    S.write_splits(canonical(spark, sf).withColumnRenamed("client_id", "bank"), path)
    return _counts(S.read_splits(spark, path))


@query("S04_partition_stats", with_(CASES, layout_sql("q", "iid", 3)) + """
SELECT o.bank, count(*) AS n_cases, CAST(sum(n_events) AS BIGINT) AS n_events, count(*) FILTER (WHERE outcome = 2) AS n_approved
FROM decided d JOIN qout o ON o.case_id = d.case_id GROUP BY o.bank""")
def partition_stats(spark, sf):
    cases = decided(spark, sf)
    cut = P.temporal_split(cases.join(partition(cases, "iid", 3, DESIGN), "case_id"))
    stats = P.partition_summary(cut).select("bank", "n_cases", "n_events", "n_approved")
    path = _fresh(spark, "layout")
    S.write_layout(cut.select("case_id", "bank", "split"), stats, {"config": "iid_3banks", "seed": 42}, path)
    return spark.read.option("header", "true").schema("bank string, n_approved long, n_cases long, n_events long").csv(f"{path}/stats")


@query("S04_metadata", with_(CASES, ALL_LAYOUTS, SPLIT.format(by="config, bank", src="lay"), RECORDS) + """
, cc AS (SELECT count(*) AS n, count(*) FILTER (WHERE pos > dpos) AS removed, count(cls) AS d FROM ld GROUP BY case_id)
SELECT rec.config, strategy, n_banks::BIGINT AS n_banks, 0 AS margin, 42 AS seed, available, assigned, left_out, cap, dropped, fa AS final_ab_gap, fb AS final_bc_gap,
  ta AS target_ab_gap, tb AS target_bc_gap, (SELECT CAST(sum(removed) AS BIGINT) FROM cc) AS events_removed,
  (SELECT round(CAST(sum(removed) AS DOUBLE) / sum(n) FILTER (WHERE d > 0), 8) FROM cc) AS share_removed,
  coalesce(n_warnings, 0)::BIGINT AS n_warnings, coalesce(small, '') AS small FROM rec LEFT JOIN wl ON wl.config = rec.config""")
def metadata(spark, sf):
    """Records of all layouts, written and read back as a source."""
    path = _fresh(spark, "records")
    S.write_records(records(spark, sf), path)
    back = S.read_records(spark, path)
    small = F.array_join(F.transform("warnings", lambda w: F.concat_ws(":", w["bank"], w["split"], w["n"].cast("string"))), ",")
    return rounded(back.select(
        "config", "strategy", "n_banks", "settings.margin", "settings.seed", "cases.available", "cases.assigned", "cases.left_out",
        *[f"enforcement.{c}" for c in ("cap", "dropped", "final_ab_gap", "final_bc_gap", "target_ab_gap", "target_bc_gap")],
        "trace_cut.events_removed", "trace_cut.share_removed", F.size("warnings").cast("long").alias("n_warnings"), small.alias("small"),
    ), 8)


@query("S05_file_fingerprint")
def file_fingerprint(spark, sf):
    return S.file_fingerprint(spark, sf, "*.parquet")


@query("S06_table_fingerprint", """
WITH m AS (SELECT l_returnflag, md5(concat_ws(chr(31), CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
  coalesce(l_linestatus, '\\N'), CAST(epoch_us(l_shipdate) AS VARCHAR))) AS h FROM lineitem)
SELECT l_returnflag, count(*) AS n_rows, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(h, 17, 15) AS BIGINT)) AS VARCHAR) AS content_sum
FROM m GROUP BY l_returnflag""")
def table_fingerprint(spark, sf):
    lines = table(spark, sf, "lineitem")
    cols = ["l_orderkey", "l_partkey", "l_linenumber", "l_linestatus", F.unix_micros(F.col("l_shipdate").cast("timestamp"))]
    return S.table_fingerprint(lines, cols, ["l_returnflag"])


@query("S07_case_rows", with_(L, LP) + "SELECT case_id, token, l_partkey, credit FROM lp WHERE pos = 0")
def case_rows(spark, sf):
    df, spec = log_l(spark, sf)
    return S.case_rows(df, spec, ["token", "l_partkey", "credit"])


@query("S09_write_summary", with_(O) + "SELECT goal, type, count(*) AS n, CAST(sum(CASE WHEN amount = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero FROM o GROUP BY goal, type")
def write_summary(spark, sf):
    path = _fresh(spark, "summary")
    summary = order_cases(spark, sf).groupBy("goal", "type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("amount") == 0).alias("n_zero"))
    S.write_summary(summary, ["goal", "type", "n", "n_zero"], path)
    return spark.read.option("header", "true").schema("goal string, type string, n long, n_zero long").csv(path)


@query("S09_write_json", with_(O) + """
, s AS (SELECT goal, type, count(*) AS n, CAST(sum(CASE WHEN amount = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero FROM o GROUP BY goal, type)
SELECT CAST(row_number() OVER (ORDER BY goal NULLS FIRST, type NULLS FIRST) AS INTEGER) AS line,
  CAST(json_object('goal', goal, 'n', n, 'n_zero', n_zero, 'type', type) AS VARCHAR) AS value FROM s""")
def write_json(spark, sf):
    """The lines of the written file, in their order."""
    path = _fresh(spark, "summary")
    summary = order_cases(spark, sf).groupBy("goal", "type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("amount") == 0).alias("n_zero"))
    S.write_summary(summary, ["goal", "type", "n", "n_zero"], path, "json")
    lines = spark.read.text(path, wholetext=True)
    return lines.select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("i", "value")).select((F.col("i") + 1).alias("line"), "value")
