"""Mixing sources to target weights by Pareto order sampling. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracemill.llm.common import WORD, words
from tracemill.session import settle

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
ROUNDS = 3
#: Slots per source in which sampled sizes are summed; only one slot of a source is ever ordered row by row.
SLOTS = 4096
STEPS = float(2**52)
#: However liked, a document's inclusion probability leaves this share of what its source's rate leaves open.
OPEN = 0.125


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.size(words(text)).cast("long")


def variety(text: Column) -> Column:
    """Preference by how varied a text is: a half and the share of its words that are distinct; 1 without words."""
    found = words(text)
    return F.when(F.size(found) > 0, F.lit(0.5) + F.size(F.array_distinct(found)) / F.size(found)).otherwise(F.lit(1.0))


def chance(doc_id: Column, seed: str) -> Column:
    """A repeatable uniform number in (0, 1) from the id: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(STEPS)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """``(source, source_size, target)`` from rows ``(source, size)``.

    Sources in code point order, null last, take the weights in turn. Together they
    share the sum of all sizes; a target stops at ``max_repeat`` times its source's
    size and the rest is shared again by weight. That fixed point needs no loop:
    sources fill up in the order of ``cap / weight``, so the level of the others
    follows from running sums over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumns({
        "total": F.sum("source_size").over(everything).cast("double"),
        "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # A source fills up if the level reached without it exceeds its cap per weight.
    per = per.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    per = per.withColumn("fills", F.col("level") * F.col("weight") > F.col("cap"))
    last = F.max(F.when(~F.col("fills"), F.col("level"))).over(everything)
    target = F.when(F.col("fills"), F.col("cap")).otherwise(F.least(F.col("cap"), last * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def plan_mix(sized: DataFrame, weights=WEIGHTS, max_repeat=MAX_REPEAT, slots: int = SLOTS, rounds: int = ROUNDS) -> DataFrame:
    """One row per source: target, whole copies, and up to which Pareto rank a further copy is taken.

    ``sized`` has ``source, size, chance, preference``. All documents of a source have
    the whole part of ``target / source_size`` as certain copies. A document's inclusion
    probability for one more is the fraction that is left times its preference, and
    documents are ranked by ``odds(chance) / odds(probability)``. The sample's size is fixed in words:
    ranks are taken until the target is reached. What a last long document leaves
    open is filled in ``rounds - 1`` further passes by later documents that fit it.
    Ties in rank stay together.
    """
    plan = settle(source_targets(sized, weights, max_repeat))
    rows = ranked(sized, plan, max_repeat)
    certain = rows.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    # Written, so that its size is known to the joins with the rows of a large source.
    cuts = settle(
        plan.join(certain, plan["source"].eqNullSafe(certain["source"]), "left").drop(certain["source"])
        .withColumn("gap0", F.greatest(F.col("target") - F.coalesce("certain", F.lit(0)), F.lit(0.0)))
        .withColumn("cut0", F.lit(-1.0))
    )
    for r in range(1, rounds + 1):
        cuts = settle(_cut(rows, cuts, r, slots, r == rounds))
    return cuts


def ranked(sized: DataFrame, plan: DataFrame, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Rows with source_size, target, whole (certain copies), place in (0, 1) and rank (place order)."""
    plan = plan.withColumnRenamed("source", "_source")
    rows = sized.join(plan, sized["source"].eqNullSafe(plan["_source"]), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rate = F.least(F.lit(float(max_repeat)), rate)
    rows = rows.withColumn("_rate", rate).withColumn("whole", F.floor("_rate").cast("long"))
    base = F.col("_rate") - F.col("whole")
    rows = rows.withColumn("_part", F.least(base * F.col("preference"), 1 - (1 - base) * OPEN))
    # Relative to the source's own fraction the rank is spread over (0, 1), so slots are even.

    def odds(p: Column) -> Column:
        return p / (1 - p)

    place = odds(F.col("chance")) / odds(F.col("_part")) * odds(base)
    rank = F.when(F.col("_part") > 0, place / (1 + place))
    return rows.withColumn("rank", rank).drop("_rate", "_part")


def _cut(rows: DataFrame, cuts: DataFrame, r: int, slots: int, last: bool) -> DataFrame:
    """Add ``cut{r}`` and ``gap{r}``: ranks above ``cut{r-1}`` of sizes up to ``gap{r-1}`` are taken up to ``cut{r}``."""
    now = cuts.select(F.col("source").alias("_s"), F.col(f"cut{r - 1}").alias("_cut"), F.col(f"gap{r - 1}").alias("_gap"))
    fits = F.col("rank").isNotNull() & (F.col("rank") > F.col("_cut")) & (F.col("size") > 0)
    if r > 1:
        fits = fits & (F.col("size") <= F.col("_gap"))
    some = rows.join(now, rows["source"].eqNullSafe(now["_s"])).filter(fits).select(
        "source", "size", "rank", "_gap", F.floor(F.col("rank") * slots).cast("int").alias("slot")
    )
    sums = some.groupBy("source", "slot", "_gap").agg(F.sum("size").alias("words"))
    run = F.sum("words").over(Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(run, F.lit(0)))
    reached = sums.filter(F.col("before") <= F.col("_gap"))
    edge = settle(
        reached.groupBy("source").agg(
            F.max(F.struct("slot", "before")).alias("e")
        ).select(F.col("source").alias("_s"), F.col("e.slot").alias("_slot"), F.col("e.before").alias("_before"))
    )
    inside = some.join(edge, some["source"].eqNullSafe(edge["_s"]) & (some["slot"] == edge["_slot"]))
    inside = inside.groupBy("source", "rank", "_gap", "_before", "_slot").agg(F.sum("size").alias("size"))
    upto = F.col("_before") + F.sum("size").over(
        Window.partitionBy("source", "_slot").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    )
    # The last round also takes the document at the edge if that ends nearer to the target.
    upto = inside.withColumn("upto", upto)
    kept = upto.filter(F.col("upto") - (F.col("size") / 2 if last else F.lit(0)) <= F.col("_gap"))
    best = kept.groupBy("source").agg(F.max("rank").alias("_rank"), F.max("upto").alias("_upto"))
    best = best.withColumnRenamed("source", "_b")
    out = cuts.join(edge, cuts["source"].eqNullSafe(edge["_s"]), "left").drop("_s")
    out = out.join(best, out["source"].eqNullSafe(best["_b"]), "left").drop("_b")
    # No row of the edge slot fits: everything below the slot is taken.
    cut = F.coalesce("_rank", F.greatest(F.col("_slot") / F.lit(float(slots)), F.col(f"cut{r - 1}")), F.col(f"cut{r - 1}"))
    gap = F.greatest(F.col(f"gap{r - 1}") - F.coalesce("_upto", "_before", F.lit(0)), F.lit(0.0))
    return out.withColumns({f"cut{r}": cut, f"gap{r}": gap}).drop("_slot", "_before", "_rank", "_upto")


def mix(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, max_repeat=MAX_REPEAT, preference: Column | None = None,
        slots: int = SLOTS, rounds: int = ROUNDS, keep_text: bool = True) -> DataFrame:
    """Documents with size, source_size, target, copies and taken (``copies * size``).

    Columns of ``docs`` with one of these names are replaced. A null or empty text
    has size 0 and is taken with 0 words; a null source is a source of its own, last
    in order; repeated rows with one id share a rank and stay together; an empty
    table gives an empty table. ``preference`` (positive, mean about 1, such as :func:`variety`) makes
    inclusion probabilities unequal within a source. No source is handled in one
    task: sizes are summed per slot of ranks first. ``keep_text=False`` reads texts once
    and returns id, source and the sizes only.
    """
    taken = ["size", "source_size", "target", "copies", "taken", "chance", "preference", "rank", "whole"]
    kept = [c for c in docs.columns if c not in taken]
    rows = docs.select(
        *([f"`{c}`" for c in kept] if keep_text else ["doc_id", "source"]),
        size_of(F.col("text")).alias("size"), chance(F.col("doc_id"), seed).alias("chance"),
        (F.lit(1.0) if preference is None else preference.cast("double")).alias("preference"),
    )
    sized = rows if keep_text else settle(rows)
    slim = settle(rows.select("source", "size", "chance", "preference")) if keep_text else sized
    plan = plan_mix(slim, weights, max_repeat, slots, rounds)
    out = ranked(sized, plan, max_repeat)
    more = F.col("rank") <= F.col("cut1")
    for r in range(2, rounds + 1):
        more = more | ((F.col("size") <= F.col(f"gap{r - 1}")) & (F.col("rank") <= F.col(f"cut{r}")))
    copies = (F.col("whole") + F.coalesce(more & (F.col("size") > 0), F.lit(False)).cast("long")).alias("copies")
    columns = kept if keep_text else ["doc_id", "source"]
    return out.select(
        *[f"`{c}`" for c in columns], "size", "source_size", "target", copies, (copies * F.col("size")).alias("taken"),
    )


def mix_sql(seed: str = "mix") -> str:
    """The mix by :func:`variety` for DuckDB, with plain running sums in place of slots."""
    rounds = []
    prior = "budget"
    for r in range(1, ROUNDS + 1):
        half = "size / 2.0" if r == ROUNDS else "0"
        fit = f"AND size <= gap{r - 1}" if r > 1 else ""
        rounds.append(f"""
  s{r} AS (SELECT source, rank, sum(size) AS size FROM {prior} WHERE rank > cut{r - 1} AND size > 0 {fit} GROUP BY ALL),
  w{r} AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM s{r}),
  b{r} AS (SELECT p.source, max(w.rank) AS mrank, max(w.upto) AS mupto FROM (SELECT DISTINCT source, gap{r - 1} FROM {prior}) p
    JOIN w{r} w ON w.source IS NOT DISTINCT FROM p.source AND w.upto - {half} <= p.gap{r - 1} GROUP BY p.source),
  r{r} AS (SELECT p.*, coalesce(b.mrank, cut{r - 1}) AS cut{r},
    greatest(gap{r - 1} - coalesce(b.mupto, 0), 0.0) AS gap{r}
    FROM {prior} p LEFT JOIN b{r} b ON b.source IS NOT DISTINCT FROM p.source)""")
        prior = f"r{r}"
    more = " OR ".join(
        ["rank <= cut1"] + [f"(size <= gap{r - 1} AND rank <= cut{r})" for r in range(2, ROUNDS + 1)]
    )
    return f"""WITH RECURSIVE d AS (SELECT doc_id, source, len(ws) AS size,
    CASE WHEN len(ws) > 0 THEN CAST(0.5 AS DOUBLE) + len(list_distinct(ws)) / CAST(len(ws) AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS preference,
    (CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5)::DOUBLE
      / {STEPS!r} AS chance FROM (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents)),
  per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
  wt AS (SELECT *, [{', '.join(f'{float(w)}::DOUBLE' for w in WEIGHTS)}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight,
    source_size * {float(MAX_REPEAT)}::DOUBLE AS cap FROM per),
  fill(step, source, source_size, weight, cap, target, done) AS (
    SELECT 0, source, source_size, weight, cap, 0.0::DOUBLE, false FROM wt
    UNION ALL
    SELECT step + 1, source, source_size, weight, cap,
      CASE WHEN done THEN target ELSE least(cap, lvl * weight) END, done OR lvl * weight > cap
    FROM (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) FILTER (WHERE done) OVER (), 0))::DOUBLE
        / sum(weight) FILTER (WHERE NOT done) OVER () AS lvl FROM fill WHERE step < 64) x),
  plan AS (SELECT source, source_size, target FROM fill WHERE step = 64),
  e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN least({float(MAX_REPEAT)}::DOUBLE, target / source_size) ELSE CAST(0 AS DOUBLE) END AS rate
    FROM d JOIN plan p ON p.source IS NOT DISTINCT FROM d.source),
  o AS (SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS base,
    least((rate - floor(rate)) * preference, 1 - (1 - (rate - floor(rate))) * {OPEN}::DOUBLE) AS part FROM e),
  q AS (SELECT *, CASE WHEN part > 0 THEN (chance / (1 - chance)) / (part / (1 - part)) * (base / (1 - base)) END AS place FROM o),
  f AS (SELECT *, place / (1 + place) AS rank FROM q),
  budget AS (SELECT *, greatest(target - sum(whole * size) OVER (PARTITION BY source), 0.0) AS gap0, -1.0 AS cut0 FROM f),
  {','.join(rounds).strip()},
  c AS (SELECT *, whole + (CASE WHEN size > 0 AND ({more}) THEN 1 ELSE 0 END) AS copies FROM {prior})
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, round(target::DOUBLE, 6) AS target, (copies * size)::BIGINT AS taken FROM c"""
