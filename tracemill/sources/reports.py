"""Run reports as nested rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracemill.operators.runs import REPORT_SCHEMA


def read_run_reports(
    spark: SparkSession, root: str, subtrees: Sequence[str], forbidden: Sequence[str] = (),
    glob: str = "*_run_report.json", multi_line: bool = True, schema: str = REPORT_SCHEMA,
) -> DataFrame:
    """Reports below the allowed subtrees, with their path relative to ``root``.

    The schema is fixed, so nothing is inferred. A report in a forbidden subtree
    raises.
    """
    base = root.rstrip("/")
    df = (
        spark.read.schema(schema)
        .option("multiLine", str(multi_line).lower())
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .json([f"{base}/{s}" for s in subtrees])
    )
    path = F.url_decode(F.element_at(F.split("_metadata.file_path", F.lit(base + "/")), -1))
    bad = F.lit(False)
    for f in forbidden:
        bad = bad | F.contains(F.concat(F.lit("/"), path), F.lit(f"/{f.strip('/')}/"))
    checked = F.when(bad, F.raise_error(F.lit("run report in a forbidden subtree")).cast("string")).otherwise(path)
    return df.select("*", checked.alias("report_path"))
