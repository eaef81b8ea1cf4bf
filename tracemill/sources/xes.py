"""XES documents as flat events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_TYPED = ("string", "date", "int", "float", "boolean", "id")
_ATTRS = ",".join(f"`{t}` array<struct<_key:string,_value:string>>" for t in _TYPED)
TRACE_SCHEMA = f"{_ATTRS}, event array<struct<{_ATTRS.replace('` array', '`:array')}>>"


# Typed children in which a value of each kind is looked for first.
_FIRST = {"timestamp": ("date",), "long": ("int", "float"), "int": ("int", "float"), "double": ("float", "int"),
          "boolean": ("boolean",), "string": ("string", "id")}


def _value(owner: str, key: str, kind: str) -> Column:
    """Last value of a key. The type of a key may differ between events, so the other typed children follow."""
    first = _FIRST.get(kind, ())
    found = []
    for t in (*first, *[t for t in _TYPED if t not in first]):
        hits = F.filter(F.col(f"{owner}.{t}" if owner else t), lambda a: a["_key"] == key)
        found.append(F.try_element_at(hits, F.lit(-1))["_value"])
    value = F.coalesce(*found)
    return value if kind == "string" else value.try_cast(kind)


def parse_traces(traces: DataFrame, event_cols: Mapping[str, str], case_cols: Mapping[str, str], case_key: str = "concept:name") -> DataFrame:
    """Flat events of parsed traces: ``case:`` attributes repeated, file order kept as ``seq``.

    Column maps give the Spark type of each attribute; values that do not fit
    their type become null. Offsets in times are converted to the session zone.
    """
    case = {case_key: "string", **case_cols}
    flat = traces.select(
        *[_value("", k, t).alias(f"case:{k}") for k, t in case.items()],
        # The outer form keeps the optimizer from parsing each trace once more to test for events.
        F.posexplode_outer("event").alias("seq", "e"),
    ).filter("seq is not null")
    return flat.select(
        *[F.col(f"`case:{k}`") for k in case], "seq",
        *[_value("e", k, t).alias(k) for k, t in event_cols.items()],
    )


def read_xes(
    spark: SparkSession, paths: str | Sequence[str], event_cols: Mapping[str, str], case_cols: Mapping[str, str],
    split_files: bool = True,
) -> DataFrame:
    """Read XES files as flat events.

    With ``split_files`` a file is cut at trace ends, so one large file is read
    by many tasks; otherwise the XML source reads each file in one task.
    """
    if not split_files:
        traces = spark.read.format("xml").option("rowTag", "trace").schema(TRACE_SCHEMA).load(paths)
        return parse_traces(traces, event_cols, case_cols)
    text = spark.read.option("lineSep", "</trace>").text(paths if isinstance(paths, str) else list(paths))
    body = F.regexp_extract("value", r"(?s)(<trace[\s>].*)$", 1)
    one = text.filter(F.contains("value", F.lit("<trace"))).select(
        F.from_xml(F.concat(body, F.lit("</trace>")), TRACE_SCHEMA, {"rowTag": "trace"}).alias("x")
    )
    return parse_traces(one.select("x.*"), event_cols, case_cols)
