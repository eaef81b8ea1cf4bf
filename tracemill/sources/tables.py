"""Event tables, split layouts, fingerprints and summaries."""

from __future__ import annotations

import ctypes
import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

import tracemill
from tracemill.log import LogSpec
from tracemill.session import fine_shuffles, settle

# Workers need not have this package on their path: functions travel by value.
cloudpickle.register_pickle_by_value(tracemill)

#: Names that Spark's line reader unpacks.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|passthrough)$"

#: Bytes of one file that a task reads for its checksums, rounded up to whole splits.
CHUNK_BYTES = 64 << 20

BOM = b"\xef\xbb\xbf"
SUMS = "path string, md5 string, sha256 string"


def log_totals(df: DataFrame, case: str) -> DataFrame:
    """Events and cases of a log."""
    return df.agg(F.count(F.lit(1)).alias("events"), F.count_distinct(case).alias("cases"))


def read_event_log(
    spark: SparkSession, path: str, spec: LogSpec, expect_events: int | None = None, expect_cases: int | None = None
) -> DataFrame:
    """Read a parquet log with its time column as a timestamp.

    Expected totals are checked in one job over the case column; a difference
    raises.
    """
    df = spark.read.parquet(path).withColumn(spec.ts, F.col(spec.ts).cast("timestamp"))
    if expect_events is not None or expect_cases is not None:
        seen = log_totals(df, spec.case).first()
        for name, want in (("events", expect_events), ("cases", expect_cases)):
            if want is not None and seen[name] != want:
                raise ValueError(f"{path}: expected {want} {name}, found {seen[name]}")
    return df


def case_rows(df: DataFrame, spec: LogSpec, cols: Sequence[str]) -> DataFrame:
    """First row of each case in the log order, listed columns only.

    The rank limit runs before the shuffle, so a hot case sends one row per task.
    """
    w = Window.partitionBy(spec.case).orderBy(*spec.order)
    need = list(dict.fromkeys([spec.case, *spec.order, *cols]))
    first = df.select(*need).withColumn("__rank", F.row_number().over(w)).filter("__rank = 1")
    return first.select(spec.case, *[c for c in cols if c != spec.case])


def write_splits(df: DataFrame, root: str, bank: str = "bank", split: str = "split", max_records: int = 5_000_000) -> None:
    """One table partitioned by bank and split; the pooled copy is the same table without a bank filter.

    Rows of a folder come together before the write, so small folders get one file;
    Spark splits what is large, so a large bank is still written by many tasks.
    """
    df.hint("rebalance", F.col(bank), F.col(split)).write.mode("errorifexists").option("maxRecordsPerFile", max_records).partitionBy(bank, split).parquet(root)


#: Record of a run: configuration, cases, enforcement (null without), trace cut and warnings.
RECORD = (
    "config string, strategy string, n_banks long, settings struct<margin:int,mode:string,seed:int>, "
    "cases struct<available:long,assigned:long,left_out:long>, "
    "enforcement struct<cap:double,dropped:long,final_ab_gap:double,final_bc_gap:double,target_ab_gap:double,target_bc_gap:double>, "
    "trace_cut struct<cases_with_multiple_distinct_outcomes:long,cases_with_multiple_outcome_events:long,cases_with_outcome:long,"
    "events_after_cut:long,events_before_cut:long,events_removed:long,share_removed:double>, "
    "warnings array<struct<bank:string,kind:string,n:long,split:string>>"
)


def write_records(records: DataFrame, path: str) -> None:
    """Records of runs as one JSON document a line, in the order of their layouts, keys sorted at every depth."""
    write_summary(records, ["config", *[c for c in records.columns if c != "config"]], path, "json", ["config"])


def read_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Records of any number of runs in one scan. Unknown keys are left out, absent ones are null; a torn line raises."""
    return spark.read.schema(RECORD).option("mode", "FAILFAST").json(paths if isinstance(paths, str) else list(paths))


def write_layout(df: DataFrame, stats: DataFrame, settings: Mapping[str, object] | DataFrame, root: str) -> None:
    """A layout with its record: ``events`` by bank and split, ``stats`` as CSV, ``metadata`` as one JSON line.

    ``stats`` holds a row per bank; its columns are written in name order. ``settings`` are the layout's record, as
    ``plans.partitioning.run_records`` makes it, or the caller's own configuration with sorted keys.
    """
    write_splits(df, f"{root}/events")
    write_summary(stats, sorted(stats.columns), f"{root}/stats")
    if isinstance(settings, DataFrame):
        write_records(settings, f"{root}/metadata")
        return
    line = json.dumps(settings, sort_keys=True, default=str)
    df.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{root}/metadata")


def read_splits(spark: SparkSession, root: str, banks: Sequence[str] | None = None, splits: Sequence[str] | None = None) -> DataFrame:
    """Read a partitioned layout; bank and split filters prune folders."""
    df = spark.read.parquet(root)
    if banks is not None:
        df = df.filter(F.col("bank").isin(*banks))
    if splits is not None:
        df = df.filter(F.col("split").isin(*splits))
    return df


def scan_splits(spark: SparkSession, paths: str | Sequence[str], prefix: str) -> DataFrame:
    """Scan ``<prefix>_bank_<bank>_<split>`` files in one pass; bank and split come from the file name.

    Both plain files and folders of that name are found.
    """
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    pattern = rf"{prefix}_bank_([^_/]+)_(train|val|test)(?:\.parquet)?(?:/|$)"
    path = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(path, pattern, 1).alias("bank"), F.regexp_extract(path, pattern, 2).alias("split"))


def missing_splits(df: DataFrame, banks: Sequence[str], splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Expected (bank, split) pairs without rows, and unexpected banks (split null)."""
    pairs = [(b, s) for b in banks for s in splits]
    want = df.sparkSession.createDataFrame(pairs, "bank string, split string")
    seen = df.select(F.col("bank").cast("string").alias("bank"), F.col("split").cast("string").alias("split")).distinct()
    extra = seen.filter(~F.col("bank").isin(*banks)).select("bank", F.lit(None).cast("string").alias("split")).distinct()
    return want.join(seen, ["bank", "split"], "left_anti").unionByName(extra)


def require_splits(df: DataFrame, banks: Sequence[str], splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """The frame itself if every split is there; raises otherwise, naming up to 20 of them."""
    missing = missing_splits(df, banks, splits).limit(20).collect()
    if missing:
        raise ValueError(f"missing or unexpected splits: {sorted((m.bank, m.split or '') for m in missing)}")
    return df


class _Digest:
    """MD5 or SHA-256 whose state can be handed to another task as bytes: OpenSSL's public context, which ``hashlib`` hides."""

    SIZES = {"MD5": 16, "SHA256": 32}
    #: The contexts take 92 and 112 bytes.
    CONTEXT = 128

    def __init__(self, name: str, state: bytes = b"") -> None:
        # Names are looked up in the library that hashlib itself is linked to; some builds of Python have none.
        import _hashlib

        self.library, self.name = ctypes.CDLL(_hashlib.__file__), name
        self.context = ctypes.create_string_buffer(state, self.CONTEXT)
        if not state:
            self._call("Init", self.context)

    def _call(self, step: str, *args: object) -> None:
        if self.library[f"{self.name}_{step}"](*args) != 1:
            raise RuntimeError(f"{self.name}_{step} failed")

    def update(self, data: bytes) -> None:
        self._call("Update", self.context, data, ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self.context.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(self.SIZES[self.name])
        self._call("Final", out, self.context)
        return out.raw.hex()


def _hands_over() -> bool:
    """Whether this Python's hash library lays its state open (judged on the driver; workers have the same Python)."""
    try:
        return _Digest("MD5").hexdigest() == hashlib.md5().hexdigest() and _Digest("SHA256").hexdigest() == hashlib.sha256().hexdigest()
    except (AttributeError, ImportError, OSError):
        return False


#: A file while it is read: path, length, bytes read, (MD5, SHA-256) of the bytes alone and of a byte order mark before them.
_File = tuple[str, int, int, list[tuple]]


def _files(batches: Iterator[pa.RecordBatch], resumable: bool) -> Iterator[_File]:
    """The files of a stream of lines in file order, digests updated line by line. A state from an earlier chunk comes before its lines."""
    last, size, read, sums = None, 0, 0, []
    for batch in batches:
        paths, sizes, starts, lines = (batch.column(c).to_pylist() for c in ("path", "length", "start", "line"))
        i = 0
        while i < len(paths):
            first = paths[i] != last
            if first:
                if last is not None:
                    yield last, size, read, sums
                last, size, read = paths[i], sizes[i], 0
            if starts[i] < 0:
                states = [lines[i][k:k + _Digest.CONTEXT] for k in range(8, len(lines[i]), _Digest.CONTEXT)]
                read = int.from_bytes(lines[i][:8], "big")
                sums = [(_Digest("MD5", md5), _Digest("SHA256", sha256)) for md5, sha256 in zip(states[::2], states[1::2])]
                i += 1
                continue
            if first:
                sums = [(_Digest("MD5"), _Digest("SHA256")) if resumable else (hashlib.md5(), hashlib.sha256()) for _ in range(2)]
                for one in sums[1]:
                    one.update(BOM)
            e = i + 1
            while e < len(paths) and paths[e] == last:
                e += 1
            part = b"\n".join(lines[i:e])
            if not first:
                part = b"\n" + part
            read += len(part)
            for md5, sha256 in sums:
                md5.update(part)
                sha256.update(part)
            i = e
    if last is not None:
        yield last, size, read, sums


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files read so far as rows that lead the lines of their next chunk."""
    for path, size, read, sums in _files(batches, True):
        state = read.to_bytes(8, "big") + b"".join(one.state() for pair in sums for one in pair)
        yield pa.RecordBatch.from_arrays(
            [pa.array([path]), *(pa.array([n], pa.int64()) for n in (size, -1, -1)), pa.array([state], pa.binary())],
            names=["path", "length", "start", "seq", "line"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MD5 and SHA-256 of files read to their end."""
    for path, size, read, sums in _files(batches, False):
        # The line reader drops a byte order mark and doesn't tell whether the last line ends with a newline.
        if size - read not in (0, 1, 3, 4):
            raise ValueError(f"{path}: read {read} of {size} bytes")
        md5, sha256 = sums[size - read >= 3]
        if (size - read) % 3:
            md5.update(b"\n")
            sha256.update(b"\n")
        yield pa.RecordBatch.from_arrays(
            [pa.array([path]), pa.array([md5.hexdigest()]), pa.array([sha256.hexdigest()])], names=["path", "md5", "sha256"])


def _in_file_order(lines: DataFrame) -> DataFrame:
    # Within a split the ids follow the order of the lines.
    return lines.repartition("path").sortWithinPartitions("path", "start", "seq")


def _chunk_sums(lines: DataFrame) -> DataFrame:
    """Digests of long files. Each round reads the next chunk of every file, after the state that the round before has settled."""
    with fine_shuffles(lines.sparkSession):
        chunks = settle(lines.withColumn("chunk", F.floor(F.col("start") / CHUNK_BYTES)), "chunk")
        todo = lines.limit(0)
        *numbers, end = sorted(r.chunk for r in chunks.select("chunk").distinct().collect())
        for number in numbers:
            todo = todo.unionByName(chunks.filter(F.col("chunk") == number).drop("chunk"))
            todo = settle(_in_file_order(todo).mapInArrow(_states, lines.schema))
        todo = todo.unionByName(chunks.filter(F.col("chunk") == end).drop("chunk"))
        return settle(_in_file_order(todo).mapInArrow(_digests, SUMS))


def file_fingerprint(spark: SparkSession, paths: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """MD5 and SHA-256 of raw file bytes, one row per file.

    Files are read in splits, as lines that end with the newline byte, and each file's lines go in order through
    updating digests, so no task holds a file; it holds the longest stretch without a newline byte (2 GB at most).
    Of files over ``CHUNK_BYTES`` a task reads one chunk (the splits that start in it) and hands the state of the digests on,
    so what it reads doesn't grow with the file; these rounds run when the function is called.
    Where Python's hash library doesn't lay its state open, one task reads a file to its end.
    Files named like compressed text, which Spark would unpack, are read whole.
    """

    def reader(kind: str) -> DataFrameReader:
        r = spark.read.format(kind).option("recursiveFileLookup", "true")
        return r.option("pathGlobFilter", glob) if glob else r

    def lines(of: Column) -> DataFrame:
        return reader("text").option("lineSep", "\n").load(given).filter(~packed & of).select(
            place, F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("line"),
        )

    given = [paths] if isinstance(paths, str) else list(paths)
    name, place = F.col("_metadata.file_name"), F.col("_metadata.file_path").alias("path")
    packed, long = F.lower(name).rlike(PACKED), F.col("_metadata.file_size") > CHUNK_BYTES
    listed = reader("binaryFile").load(given)
    files = listed.select(place, F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")
    chunked = _hands_over() and not listed.filter(~packed & long).select("length").isEmpty()
    sums = _in_file_order(lines(~long if chunked else F.lit(True))).mapInArrow(_digests, SUMS)
    if chunked:
        sums = sums.unionByName(_chunk_sums(lines(long)))
    whole = reader("binaryFile").load(given).filter(packed).select(
        place, F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))
    # A file of a mark alone has no line. Spark's listing leaves empty files out.
    mark = F.when(F.col("length") == 3, F.unhex(F.lit("EFBBBF")))
    return files.join(sums.unionByName(whole), "path", "left").select(
        "file_name", "length",
        F.coalesce("md5", F.md5(mark)).alias("md5"), F.coalesce("sha256", F.sha2(mark, 256)).alias("sha256"),
    )


def verify_fingerprints(found: DataFrame, expected: DataFrame, algorithm: str = "md5") -> DataFrame:
    """Files whose checksum differs from the expected ``(file_name, checksum)`` or that are absent."""
    if algorithm not in ("md5", "sha256"):
        raise ValueError(f"unknown algorithm: {algorithm!r}")
    return expected.join(found.select("file_name", F.col(algorithm).alias("actual")), "file_name", "left").filter(
        F.col("actual").isNull() | (F.lower("checksum") != F.col("actual"))
    )


def row_text(cols: Sequence[str | Column]) -> Column:
    """Unambiguous text of a row; null and empty differ."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\\N")) for c in cols]
    return F.concat_ws("\u001f", *parts)


def table_fingerprint(df: DataFrame, cols: Sequence[str | Column], by: Sequence[str] = ()) -> DataFrame:
    """Order-free content identity: row count and sums of the two halves of each row's MD5.

    Adds up map-side; equal content gives equal values wherever and whenever it is
    read. Each half counts 60 bits and is summed as a decimal, so no number of rows overflows.
    """
    digest = F.md5(row_text(cols))

    def half(start: int) -> Column:
        bits = F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)")
        return F.coalesce(F.sum(bits.cast("decimal(28,0)")), F.lit(0)).cast("string")

    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("n_rows"), F.concat_ws(":", half(1), half(17)).alias("content_sum")
    )


def _key_order(value: Column, of: DataType) -> Column:
    """The value with the fields of its structs in name order, at every depth."""
    if isinstance(of, StructType):
        fields = [_key_order(value[f.name], f.dataType).alias(f.name) for f in sorted(of.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(of, ArrayType):
        return F.transform(value, lambda x: _key_order(x, of.elementType))
    return value


def write_summary(
    df: DataFrame, cols: Sequence[str], path: str, fmt: str = "csv", order: Sequence[str] | None = None
) -> None:
    """Write a summary in a fixed column order (CSV with header), or as JSON with sorted keys and rows.

    A summary is small: JSON is one file with one object a line, keys in name order at every depth, nulls kept, rows in the order
    of ``order`` (``cols`` if none is given), so equal summaries give equal files.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"unknown format: {fmt!r}")
    rows = df.select(*cols)
    if fmt == "csv":
        rows.write.mode("overwrite").option("header", "true").csv(path)
        return
    by = list(order or cols)
    line = F.to_json(
        F.struct(*[_key_order(F.col(c), rows.schema[c].dataType).alias(c) for c in sorted(cols)]), {"ignoreNullFields": "false"}
    )
    # A range of one partition, which orders the rows without a sampling job for more.
    rows.repartitionByRange(1, *by).sortWithinPartitions(*by).select(line.alias("value")).write.mode("overwrite").text(path)
