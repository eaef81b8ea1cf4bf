"""Sources and sinks."""

import datetime as dt
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracemill.log import LogSpec
from tracemill.sources import tables as S
from tracemill.sources.xes import read_xes

XES = """<?xml version="1.0" encoding="UTF-8"?>
<log xes.version="1.0" xmlns="http://www.xes-standard.org/">
  <global scope="trace"><string key="concept:name" value="name"/></global>
  <trace>
    <string key="concept:name" value="t1"/>
    <float key="RequestedAmount" value="500.5"/>
    <event>
      <string key="concept:name" value="A &amp; B"/>
      <date key="time:timestamp" value="2016-01-01T10:51:15.304+01:00"/>
      <int key="score" value="7"/>
      <boolean key="ok" value="true"/>
    </event>
    <event>
      <string key="concept:name" value="late"/>
      <date key="time:timestamp" value="2016-01-01T09:00:00.000+01:00"/>
      <float key="score" value="8.5"/>
    </event>
  </trace>
  <trace><string key="concept:name" value="t2"/><event><string key="concept:name" value="only"/><date key="time:timestamp" value="2016-02-01T00:00:00Z"/></event></trace>
  <trace><string key="concept:name" value="empty"/></trace>
</log>
"""


@pytest.mark.parametrize("split_files", [True, False])
def test_read_xes(spark, tmp_path, split_files):
    (tmp_path / "log.xes").write_text(XES)
    df = read_xes(spark, str(tmp_path / "log.xes"), {"concept:name": "string", "time:timestamp": "timestamp", "score": "double", "ok": "boolean"},
                  {"RequestedAmount": "double"}, split_files)
    rows = {(r["case:concept:name"], r.seq): r for r in df.collect()}
    assert set(rows) == {("t1", 0), ("t1", 1), ("t2", 0)}
    first = rows[("t1", 0)]
    assert first["concept:name"] == "A & B" and first.score == 7.0 and first.ok is True and first["case:RequestedAmount"] == 500.5
    # File order is kept although the second event is earlier; 01:00 offsets become UTC.
    assert rows[("t1", 1)].score == 8.5 and rows[("t1", 1)].ok is None
    utc = df.filter("seq = 0 and `case:concept:name` = 't1'").select(F.date_format("time:timestamp", "yyyy-MM-dd HH:mm:ss.SSS")).first()[0]
    assert utc == "2016-01-01 09:51:15.304"
    assert rows[("t2", 0)]["case:RequestedAmount"] is None


def test_expected_totals(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 2)), ("b", dt.datetime(2024, 1, 1))], "case_id string, ts timestamp").write.parquet(path)
    assert S.read_event_log(spark, path, LogSpec(), 3, 2).count() == 3
    with pytest.raises(ValueError, match="expected 4 events, found 3"):
        S.read_event_log(spark, path, LogSpec(), 4)


def test_splits_by_name_and_by_folder(spark, tmp_path):
    rows = [("A", "train", 1), ("A", "val", 2), ("A", "test", 3), ("B", "train", 4), ("B", "val", 5), ("B", "test", 6)]
    df = spark.createDataFrame(rows, "bank string, split string, x int")
    S.write_splits(df, str(tmp_path / "t"))
    back = S.read_splits(spark, str(tmp_path / "t"), banks=["A"], splits=["val", "test"])
    assert sorted(r.x for r in back.collect()) == [2, 3]
    for b, s, x in rows[:-1]:
        df.filter(F.col("x") == x).select("x").toPandas().to_parquet(tmp_path / f"L_bank_{b}_{s}.parquet")
    found = S.scan_splits(spark, [str(p) for p in tmp_path.glob("L_bank_*")], "L")
    assert {(r.bank, r.split, r.x) for r in found.collect()} == set(rows[:-1])
    with pytest.raises(ValueError, match="missing or unexpected"):
        S.require_splits(found, ["A", "B"])
    with pytest.raises(ValueError, match="missing or unexpected"):
        S.require_splits(found.filter("bank = 'A'"), ["A", "C"])
    assert S.require_splits(found.filter("bank = 'A'"), ["A"]) is not None


def test_fingerprints(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    found = S.file_fingerprint(spark, str(tmp_path), "*.bin")
    assert found.first().sha256 == hashlib.sha256(b"abc").hexdigest()
    want = spark.createDataFrame([("f.bin", hashlib.md5(b"abc").hexdigest()), ("g.bin", "0")], "file_name string, checksum string")
    assert [r.file_name for r in S.verify_fingerprints(found, want).collect()] == ["g.bin"]
    a = spark.createDataFrame([(1, None), (2, "")], "a int, b string")
    one = S.table_fingerprint(a, ["a", "b"]).first()
    assert one == S.table_fingerprint(a.orderBy(F.desc("a")), ["a", "b"]).first()
    assert one != S.table_fingerprint(a.fillna(""), ["a", "b"]).first()


def test_file_fingerprint_in_many_chunks(spark, tmp_path):
    rng = random.Random(3)
    bom, noise = b"\xef\xbb\xbf", rng.randbytes(3_000_000)
    files = {
        "noise.bin": noise, "ends.bin": noise + b"\n", "two.bin": noise[:70_000] + b"\n\n", "marked.bin": bom + noise[:90_000],
        "marked_ends.bin": bom + b"a\r\nb\rc\n", "mark.bin": bom, "marks.bin": bom + bom, "newline.bin": b"\n", "newlines.bin": b"\n" * 5000, "empty.bin": b"",
        "long line.bin": b"x" * 400_000, "zeros%20.bin": bytes(300_000), "utf.bin": b"\xff\xfe\x00" * 999, "packed.bin.gz": gzip.compress(noise[:5000]),
    }
    for i, (name, data) in enumerate(files.items()):
        (tmp_path / f"d{i % 2}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 2}" / name).write_bytes(data)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.sources.binaryFile.maxLength")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        # A file read into one cell would fail at this length.
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", "10000")
        got = {r.file_name: (r.length, r.md5, r.sha256) for r in S.file_fingerprint(spark, str(tmp_path)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {n: (len(d), hashlib.md5(d).hexdigest(), hashlib.sha256(d).hexdigest()) for n, d in files.items() if d}


@pytest.mark.parametrize("laid_open", [True, False])
def test_file_fingerprint_reads_a_chunk_a_task(spark, tmp_path, monkeypatch, laid_open):
    rng = random.Random(4)
    bom, noise = b"\xef\xbb\xbf", rng.randbytes(900_000)
    files = {
        "noise.bin": noise, "ends.bin": noise[:500_000] + b"\n", "marked.bin": bom + noise[:450_000], "marked_ends.bin": bom + noise[:450_000] + b"\n",
        # Splits without the start of a line, in the middle and at the end.
        "long lines.bin": b"x" * 350_000 + b"\n" + b"y" * 350_000, "one.bin": b"x" * 400_000, "newlines.bin": b"\n" * 300_000,
        "two.bin": noise[:250_000], "exact.bin": noise[:100_000], "short.bin": b"a", "mark.bin": bom,
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(S, "CHUNK_BYTES", 100_000, raising=False)
    if laid_open:
        # No file's bytes in one task exceed a chunk, the split that starts in it and the line that ends beyond it.
        for name in ("_digests", "_states"):
            monkeypatch.setattr(S, name, _bounded(getattr(S, name, None), 600_000), raising=False)
    else:
        monkeypatch.setattr(S, "_hands_over", lambda: False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        got = {r.file_name: (r.length, r.md5, r.sha256) for r in S.file_fingerprint(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {n: (len(d), hashlib.md5(d).hexdigest(), hashlib.sha256(d).hexdigest()) for n, d in files.items()}


def _bounded(step, limit):
    """The step, which fails if a file sends it more bytes than the limit."""

    def checked(batches):
        seen = {}

        def watched():
            for batch in batches:
                for path, line in zip(batch.column("path").to_pylist(), batch.column("line").to_pylist()):
                    seen[path] = seen.get(path, 0) + len(line)
                    if seen[path] > limit:
                        raise ValueError(f"{path}: over {limit} bytes in one task")
                yield batch

        yield from step(watched())

    return checked


def test_digest_states_are_handed_over():
    data = random.Random(5).randbytes(1000)
    for name, want in (("MD5", hashlib.md5), ("SHA256", hashlib.sha256)):
        for cut in (0, 1, 63, 64, 65, 127, 128, 999, 1000):
            one = S._Digest(name)
            one.update(data[:cut])
            rest = S._Digest(name, one.state())
            rest.update(data[cut:])
            assert rest.hexdigest() == want(data).hexdigest()


def test_case_rows_keep_nulls(spark):
    df = spark.createDataFrame([("a", 2, 1, "x"), ("a", 1, 2, None), ("b", 1, 1, "y")], "case_id string, ts int, seq int, v string")
    assert {(r.case_id, r.v) for r in S.case_rows(df, LogSpec(), ["v"]).collect()} == {("a", None), ("b", "y")}


def test_summary_order(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    S.write_summary(df, ["b", "a"], str(tmp_path / "s"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "s")).columns == ["b", "a"]
    many = spark.createDataFrame([(3, "x"), (1, None), (2, "y"), (2, "a")], "a int, b string").repartition(4)
    for name in ("j", "k"):
        S.write_summary(many, ["a", "b"], str(tmp_path / name), "json")
    files = [sorted((tmp_path / name).glob("part-*")) for name in ("j", "k")]
    assert [len(f) for f in files] == [1, 1] and files[0][0].read_text() == files[1][0].read_text()
    assert files[0][0].read_text() == '{"a":1,"b":null}\n{"a":2,"b":"a"}\n{"a":2,"b":"y"}\n{"a":3,"b":"x"}\n'
    with pytest.raises(ValueError, match="unknown format"):
        S.write_summary(df, ["a"], str(tmp_path / "q"), "xls")


def test_fingerprint_sums_do_not_overflow(spark):
    df = spark.range(64).withColumn("t", F.lit("x"))
    a = S.table_fingerprint(df, ["id", "t"]).first()
    assert a.n_rows == 64 and all(int(x) > 2**63 for x in a.content_sum.split(":"))
    assert S.table_fingerprint(df.orderBy(F.desc("id")), ["id", "t"]).first() == a
    assert S.table_fingerprint(df.filter("id < 0"), ["id"]).first().content_sum == "0:0"


def test_layout_sink_writes_record_and_few_files(spark, tmp_path):
    df = spark.range(1000).repartition(8).select(
        "id", F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("bank"), F.lit("train").alias("split"))
    stats = df.groupBy("bank").agg(F.count(F.lit(1)).alias("n_cases"))
    S.write_layout(df, stats, {"seed": 42, "config": "iid"}, str(tmp_path / "l"))
    assert S.read_splits(spark, str(tmp_path / "l/events"), ["A"]).count() == 500
    assert {(r.bank, r.n_cases) for r in spark.read.csv(str(tmp_path / "l/stats"), header=True, inferSchema=True).collect()} == {("A", 500), ("B", 500)}
    assert spark.read.text(str(tmp_path / "l/metadata")).first().value == '{"config": "iid", "seed": 42}'
    assert len(list((tmp_path / "l/events").rglob("*.parquet"))) <= 4
