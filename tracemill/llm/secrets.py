"""Secret scans by corpus-wide ownership frequency. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracemill.llm.common import bound, row_key
from tracemill.session import settle

#: Kinds in order, with pattern, the group whose length counts, and the least length of a match.
BASE = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Candidates of the method: long runs of key characters with a digit, an upper and a lower case letter.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: A value of this many owners or more is a widely copied example.
SHARED_OWNERS = 3
#: So is one in more repositories per owner than a credential of one owner shows up in.
SHARED_REPOSITORIES = 20
#: Running ends of a text with many matches are kept per run of so many, so work grows with the matches.
RUN = 128
MASK = "[SECRET]"
SPAN = "array<struct<kind:int,start:int,end:int>>"
FOUND = "array<struct<start:int,end:int,value:string,long:boolean>>"


def _runs(items: Column) -> Column:
    """The array in slices of up to ``RUN``; one empty slice for an empty array."""
    last = F.greatest(F.ceil(F.size(items) / F.lit(RUN)).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * RUN + 1, RUN))


def _before(numbers: Column) -> Column:
    """Sum of what stands before each place; one number per slice, so the array is short."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        numbers, start,
        lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, value, long enough), in code points.

    A match starts after the gaps and matches before it; the gaps are what ``split``
    leaves at the same matches. Lengths are added up per slice and within slices.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    none = F.array().cast("array<struct<start:int,end:int>>")

    def within(run: Column, at: Column) -> Column:
        return F.aggregate(
            run, F.struct(at.alias("at"), none.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["g"] + x["m"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct(
                    (acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + x["m"]).alias("end")
                ))).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    def over(runs: Column) -> Column:
        sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda acc, x: acc + x["g"] + x["m"]))
        return F.flatten(F.zip_with(runs, _before(sums), within))

    def placed(gaps: Column) -> Column:
        lengths = F.zip_with(
            F.transform(gaps, lambda g: F.length(g)), F.transform(found, lambda m: F.length(m)),
            lambda g, m: F.struct(g.alias("g"), m.alias("m")),
        )
        # The last gap has no match after it.
        lengths = F.filter(lengths, lambda x: x["m"].isNotNull())
        spans = bound(lengths, lambda x: bound(_runs(x), over))
        return F.zip_with(spans, value, lambda s, v: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), v.alias("value"), (F.length(v) >= least).alias("long")
        ))

    some = F.when(text.rlike(pattern), bound(F.split(text, pattern, -1), placed))
    return F.coalesce(some, F.array().cast(FOUND))


def scan(docs: DataFrame) -> DataFrame:
    """Row key, ``doc_id``, ``owner`` and per kind the matches of every whole text; ``token`` are the method's candidates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = [F.filter(matches(text, p, g, n), lambda x: x["long"]).alias(k) for k, p, g, n in BASE]
    mixed = F.filter(
        matches(text, TOKEN, 0, 20),
        lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[a-z]"),
    )
    return docs.select(*row_key(docs), "doc_id", F.col("source").alias("owner"), *kinds, mixed.alias("token"))


def ownership(
    scanned: DataFrame, shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES
) -> DataFrame:
    """``value_hash, n_repositories, n_owners, shared`` of every candidate value in the corpus.

    A document is a repository, its source the owner (null counts as one owner); equal rows are one repository.
    A value is shared if ``shared_owners`` owners hold it, or if it stands in more than ``shared_repositories``
    repositories per owner. Counted in three aggregations, by (value, owner, repository), by (value, owner) and by
    value, each map-side first, so a value that a third of all documents hold is no large group anywhere.
    """
    values = scanned.select(
        "_k1", "_k2", F.coalesce(F.concat(F.lit("="), "owner"), F.lit("null")).alias("owner"),
        F.explode(F.array_distinct(F.transform(
            F.concat("assign", "access", "hex", "token"), lambda x: F.sha2(x["value"].cast("binary"), 256)
        ))).alias("value_hash"),
    ).distinct()
    per_owner = values.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    wide = F.col("n_repositories") > shared_repositories * F.col("n_owners")
    return per_owner.groupBy("value_hash").agg(
        F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners")
    ).withColumn("shared", (F.col("n_owners") >= shared_owners) | wide)


def _base_spans() -> Column:
    """Base matches of a row as (kind, start, end), kind being the place in ``BASE``."""
    def placed(i: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(F.lit(i).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    return F.concat(*[placed(i, kind) for i, (kind, *_) in enumerate(BASE)])


def _joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("s"), s["kind"].alias("k"), s["end"].alias("e"))))
    names = F.array(*[F.lit(k) for k, *_ in BASE], F.lit("token"))
    return F.array_join(F.transform(
        ordered, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["s"].cast("string"), s["e"].cast("string"))
    ), ",")


def scan_secrets(
    docs: DataFrame, shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES
) -> DataFrame:
    """Row key, doc_id, base counts and spans, added spans, and how the corpus uses the values.

    ``added`` are candidates outside all base spans whose value few owners hold: live-looking
    and owner-specific. Candidates that are shared, see :func:`ownership`, are
    copied examples and are not added. ``n_live`` and ``n_example`` count the
    distinct values of a row, base ones included, by the same test; base spans
    stay whatever their ownership. Null and empty texts have no span. Repeated
    rows have equal results. Columns besides doc_id, text and source aren't read.
    """
    scanned = settle(scan(docs))
    owners = settle(ownership(scanned, shared_owners, shared_repositories))
    each = scanned.select("_k1", "_k2", F.explode(F.concat(
        F.transform(F.concat("assign", "access", "hex"), lambda x: F.struct(
            F.lit(-1).alias("at"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))),
        F.transform("token", lambda x, i: F.struct(
            i.alias("at"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))),
    )).alias("x"))
    each = each.select(
        "_k1", "_k2", F.sha2(F.col("x.value").cast("binary"), 256).alias("value_hash"), "x.at", "x.start", "x.end"
    ).distinct()
    # A candidate meets a base span that starts up to it and ends later, or one that starts before its end.
    by_start = Window.partitionBy("_k1", "_k2").orderBy("start")
    base = F.col("at") < 0
    reach = F.max(F.when(base, F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    coming = F.min(F.when(base, F.col("start"))).over(by_start.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    each = each.withColumn("inside", F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(coming < F.col("end"), F.lit(False)))
    judged = each.join(owners, "value_hash")
    extra = (F.col("at") >= 0) & ~F.col("inside") & ~F.col("shared")
    per_row = judged.groupBy("_k1", "_k2").agg(
        F.collect_set(F.when(extra, F.struct(F.lit(len(BASE)).alias("kind"), "start", "end"))).alias("added"),
        F.size(F.collect_set(F.when(~F.col("shared"), F.col("value_hash")))).cast("long").alias("n_live"),
        F.size(F.collect_set(F.when(F.col("shared"), F.col("value_hash")))).cast("long").alias("n_example"),
    )
    out = scanned.join(settle(per_row), ["_k1", "_k2"], "left")
    added = F.coalesce("added", F.array().cast(SPAN))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k, *_ in BASE]
    return out.select(
        "_k1", "_k2", "doc_id", *counts, _base_spans().alias("base"), added.alias("added"),
        F.coalesce("n_live", F.lit(0).cast("long")).alias("n_live"),
        F.coalesce("n_example", F.lit(0).cast("long")).alias("n_example"),
    )


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts per base kind, SHA-256 of the base spans, and all spans as text."""
    found = scan_secrets(docs)
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"), "n_live", "n_example",
    )


def _cut(text: Column, ordered: Column) -> Column:
    """The text with each span of the ordered array as ``MASK``; a span that starts inside an earlier one gives none.

    Spans are taken in slices, and a slice cuts its own stretch of the text, so long texts are not walked for each span.
    """
    def pieces(runs: Column) -> Column:
        # Where the text before each slice ends: the furthest end so far, one number per slice.
        ends = F.transform(runs, lambda r: F.coalesce(F.array_max(F.transform(r, lambda s: s["e"])), F.lit(0)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        froms = F.aggregate(
            ends, start,
            lambda acc, e: F.struct(F.greatest(acc["at"], e).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: F.concat(acc["out"], F.array(acc["at"])),
        )

        def one(run: Column, base: Column, local: Column) -> Column:
            zero = F.struct(base.alias("at"), F.array().cast("array<string>").alias("out"))
            return F.aggregate(
                run, zero,
                lambda acc, s: F.struct(
                    F.greatest(acc["at"], s["e"]).alias("at"),
                    F.when(s["s"] >= acc["at"], F.concat(
                        acc["out"], F.array(F.substring(local, acc["at"] - base + 1, s["s"] - acc["at"]), F.lit(MASK))
                    )).otherwise(acc["out"]).alias("out"),
                ),
                lambda acc: F.array_join(acc["out"], ""),
            )

        def all_of(f: Column) -> Column:
            cut = F.transform(runs, lambda r, i: bound(
                F.substring(text, f[i] + 1, f[i + 1] - f[i]), lambda local: one(r, f[i], local)
            ))
            rest = F.substring(text, F.element_at(f, -1) + 1, F.length(text))
            return F.concat(F.array_join(cut, ""), rest)

        return bound(froms, all_of)

    return bound(_runs(ordered), pieces)


def redact(
    docs: DataFrame, shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES
) -> DataFrame:
    """``docs`` with every base and added span replaced by ``MASK``; overlapping spans become one.

    All rows stay. ``n_chars``, where ``docs`` has it, follows the new text.
    """
    found = scan_secrets(docs, shared_owners, shared_repositories)
    spans = found.select("_k1", "_k2", F.concat("base", "added").alias("_spans")).filter(F.size("_spans") > 0).distinct()
    rows = docs.select(*[f"`{c}`" for c in docs.columns], *row_key(docs)).join(settle(spans), ["_k1", "_k2"], "left")
    ordered = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("s"), s["end"].alias("e"))))
    text = F.col("text")
    new = F.when(F.col("_spans").isNull(), text).otherwise(bound(ordered, lambda x: _cut(text, x)))
    rows = rows.withColumn("_text", new)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("_text").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(
                F.length("_text")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col(f"`{c}`"))
    return rows.select(*columns)


def _span_sql(kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind for DuckDB, placed by the gaps that a split leaves."""
    value = f"regexp_extract_all(t, '{pattern}', {group})"
    return f"""{kind} AS (SELECT doc_id, rn, '{kind}' AS kind, s::BIGINT AS start, (s + ml)::BIGINT AS "end" FROM (
    SELECT *, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda m: length(m))), 0) AS s,
      length(found[i]) AS ml, length(vals[i]) AS vl FROM (
      SELECT doc_id, rn, regexp_extract_all(t, '{pattern}', 0) AS found, {value} AS vals, string_split_regex(t, '{pattern}') AS gaps,
        unnest(range(1, len(regexp_extract_all(t, '{pattern}', 0)) + 1)) AS i FROM d)) WHERE vl >= {least})"""


def secret_sql() -> str:
    """Base counts and digest for DuckDB, and the method's added spans."""
    kinds = [(k, p.replace("\\x20", " ").replace("'", "''").replace('\\"', '"'), g, n) for k, p, g, n in BASE]
    parts = [_span_sql(*k) for k in kinds]
    token = _span_sql("token", TOKEN, 0, 20)
    order = "CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 ELSE 3 END"
    values = " UNION ALL ".join(
        [f"SELECT rn, rep, source, unnest(regexp_extract_all(t, '{p}', {g})) AS v, {n} AS least, false AS token FROM d" for _, p, g, n in kinds]
        + [f"SELECT rn, rep, source, unnest(regexp_extract_all(t, '{TOKEN}', 0)) AS v, 20 AS least, true AS token FROM d"]
    )
    good = "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS rn,
    coalesce('=' || source, 'null') || '|' || md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), 'null'), coalesce(text, ''))) AS rep FROM documents),
  {', '.join(parts)}, {token},
  base AS MATERIALIZED (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
  vals AS MATERIALIZED (SELECT DISTINCT rn, rep, source, v FROM ({values}) WHERE length(v) >= least AND (NOT token OR ({good}))),
  own AS (SELECT v, owners >= {SHARED_OWNERS} OR reps > {SHARED_REPOSITORIES} * owners AS shared FROM (
    SELECT v, count(DISTINCT coalesce('=' || source, 'null')) AS owners, count(DISTINCT rep) AS reps FROM vals GROUP BY v)),
  live AS (SELECT rn, count(*) FILTER (WHERE NOT shared) AS n_live, count(*) FILTER (WHERE shared) AS n_example
    FROM vals JOIN own USING (v) GROUP BY rn),
  added AS (SELECT k.* FROM token k JOIN d USING (rn) JOIN own o ON o.v = substr(d.t, k.start + 1, k."end" - k.start)
    WHERE NOT o.shared AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rn = k.rn AND b.start < k."end" AND k.start < b."end")),
  b AS (SELECT rn, count(*) FILTER (WHERE kind = 'assign') AS na, count(*) FILTER (WHERE kind = 'access') AS nc,
    count(*) FILTER (WHERE kind = 'hex') AS nh, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, {order}) AS s FROM base GROUP BY rn),
  e AS (SELECT rn, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, {order}) AS s
    FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY rn)
SELECT d.doc_id, coalesce(na, 0)::BIGINT AS n_assign, coalesce(nc, 0)::BIGINT AS n_access, coalesce(nh, 0)::BIGINT AS n_hex,
  sha256(coalesce(b.s, '')) AS base_sha256, coalesce(e.s, '') AS spans,
  coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN b USING (rn) LEFT JOIN e USING (rn) LEFT JOIN live USING (rn)"""
