"""Expressions and helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import tracemill
from tracemill.session import settle

# Workers need not have this package on their path: functions travel by value.
cloudpickle.register_pickle_by_value(tracemill)

#: A word is a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def fold(doc_id: Column, parts: int) -> Column:
    """``crc32`` of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def row_key(df: DataFrame) -> list[Column]:
    """128 bits that identify a row by id and text. Rows equal in both share a key and a result."""
    return [
        F.xxhash64("doc_id", "text").alias("_k1"),
        F.xxhash64(F.lit("row"), "text", "doc_id").alias("_k2"),
    ]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where lambdas refer to it many times."""
    return F.transform(F.array(value), use)[0]


def settle_and_free(df: DataFrame) -> DataFrame:
    """``settle``, then let the shuffle files of what was just written go.

    They go when the driver collects their handles, which may not happen for long
    in a driver with little to do; so it is asked to.
    """
    out = settle(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected links ``(a, b)``: one row ``(node, root)`` per node.

    ``root`` is the smallest node of the component. Alternates large-star and
    small-star steps until the links no longer change. A step is a minimum per
    node (combined map-side) and a join back; every step is written to the shared
    folder, so a lost executor repeats one step only. Null ends and loops are
    left out; without links the result is empty.
    """
    links = settle(
        edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = _mark(links)
    while seen[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.filter("b > a").join(least, "a").filter("b != m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        large = settle(large)
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        links = settle(
            large.join(small, "a").select(F.explode(F.array("a", "b")).alias("a"), "m")
            .filter("a != m").select("a", F.col("m").alias("b")).distinct()
        )
        now = _mark(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _mark(links: DataFrame) -> tuple[int, str]:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")
    ).first()
    return row["n"], str(row["h"])
