"""Profiling: plans and edge cases the oracle rows don't show."""

from pyspark.sql import functions as F

from tracemill.log import LogSpec
from tracemill.operators import profile as Q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overview_counts_without_multiplying_rows(spark):
    df = spark.range(50).select(
        (F.col("id") % 7).alias("case_id"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("activity"),
        F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"), F.lit(None).cast("string").alias("who"))
    out = Q.log_overview(df, LogSpec(lifecycle=None), "who")
    assert "Expand" not in plan(out)
    row = out.first().asDict()
    assert (row["cases"], row["events"], row["activities"], row["resources"], row["n_columns"]) == (7, 50, 2, 0, 5)
    none = Q.log_overview(df.limit(0), LogSpec(lifecycle=None), "who").first()
    assert (none["cases"], none["events"], none["first_ts"]) == (0, 0, None)


def test_histogram_has_every_bin(spark):
    some = spark.createDataFrame([(float(x),) for x in (0, 0, 1, 100)] + [(None,)], "days double")
    rows = {r["bin"]: r["n"] for r in Q.duration_histogram(some, 10, 1.0).collect()}
    assert rows == {**dict.fromkeys(range(10), 0), 0: 3, 9: 1}
    equal = spark.createDataFrame([(5.0,)] * 4, "days double")
    rows = {r["bin"]: r["n"] for r in Q.duration_histogram(equal).collect()}
    assert len(rows) == 60 and rows[0] == 4 and sum(rows.values()) == 4
    assert [r["n"] for r in Q.duration_histogram(equal.limit(0)).collect()] == [0] * 60
