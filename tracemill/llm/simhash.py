"""SimHash near-duplicates: exact links between fingerprints found with vantage points."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracemill.llm.common import components, row_key
from tracemill.session import settle

BITS = 64
RADIUS = 2
#: Vantage points of the top levels; any words do, these are digits of a 64-bit hash of 1, 2, 3, ...
VANTAGE = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
#: Rows of one comparison group; larger shards are split into blocks that meet pairwise.
SHARD_ROWS = 200_000
#: In a shard, sets up to this size are compared directly.
LEAF = 256


def fingerprint(text: bytes) -> int:
    """Majority bits of the XXH64 (seed 42) of a text's 3-word shingles, repeats included."""
    import xxhash

    # bytes.lower and bytes.split know ASCII letters and the six ASCII blanks only.
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) < 3:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        end = np.cumsum(size + 1) - 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip((end - size)[:-2].tolist(), end[2:].tolist())]
    h = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65_536):
        part = h[i:i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = [fingerprint((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column("text")]
        signed = np.array(fps, np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_k1"), batch.column("_k2"), batch.column("doc_id"), pa.array(signed)],
            names=["_k1", "_k2", "doc_id", "fp"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``_k1, _k2`` (row key), ``doc_id`` and ``fp`` (the 64 bits as a signed long) of every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*row_key(docs), "doc_id", "text").mapInArrow(
        _fingerprints, f"_k1 long, _k2 long, doc_id {id_type}, fp long"
    )


def _levels(rows: int) -> int:
    """Vantage levels so that shards stay small; the links found are the same for any number."""
    return 3 if rows <= 5_000_000 else 4 if rows <= 100_000_000 else 5


def visits(fps: DataFrame, levels: int) -> DataFrame:
    """``(shard, fp, member)``: where a fingerprint is stored, and every shard its ball reaches into.

    A shard is a tuple of distances to the vantage points. Fingerprints 1 or 2 bits
    apart differ at each vantage point by at most that (triangle bound) and all
    distances move by an odd or all by an even number. Of two shards the one that is
    smaller as a tuple visits the other, so each pair of shards meets once.
    """
    rings = [
        F.bit_count(F.col("fp").bitwiseXOR(F.lit(v - 2**64 if v >= 2**63 else v))).cast("int") for v in VANTAGE[:levels]
    ]
    steps = [o for o in product((-2, 0, 2), repeat=levels) if o > (0,) * levels]
    steps += [o for o in product((-1, 1), repeat=levels) if o > (0,) * levels]
    rows = fps.select("fp", *[r.alias(f"r{i}") for i, r in enumerate(rings)])

    def shard(offset: tuple[int, ...]) -> Column:
        code = F.lit(0)
        for i, o in enumerate(offset):
            code = code * 128 + (F.col(f"r{i}") + o + 2)
        return code.cast("long")

    own = F.struct(shard((0,) * levels).alias("shard"), F.lit(True).alias("member"))
    others = [F.struct(shard(o).alias("shard"), F.lit(False).alias("member")) for o in steps]
    return rows.select("fp", F.explode(F.array(own, *others)).alias("v")).select("v.shard", "fp", "v.member")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each component of the links between ``n`` indices."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all() and (root[a] == root[b]).all():
            return root


class _Links:
    """Links inside a shard, kept as a forest so that dense groups stay small."""

    def __init__(self, n: int):
        self.n, self.a, self.b, self.held = n, [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.held += len(a)
        if self.held > 2_000_000:
            self.forest()

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        a = np.concatenate([*self.a, np.zeros(0, np.int64)])
        b = np.concatenate([*self.b, np.zeros(0, np.int64)])
        root = _roots(self.n, a, b)
        a = np.flatnonzero(root != np.arange(self.n))
        self.a, self.b, self.held = [a], [root[a]], len(a)
        return a, root[a]


def _search(fps: np.ndarray, members: np.ndarray, queries: np.ndarray, links: _Links) -> None:
    """Vantage-point tree over ``members``; all ``queries`` descend together where their ball reaches."""
    stack = [(members, queries)]
    while stack:
        m, q = stack.pop()
        if not len(m) or not len(q):
            continue
        if len(m) > LEAF:
            v = fps[m[len(m) // 2]]
            dm, dq = np.bitwise_count(fps[m] ^ v), np.bitwise_count(fps[q] ^ v)
            mid = np.int64(np.median(dm))
            inside = dm <= mid
            if not inside.all():
                stack.append((m[inside], q[dq <= mid + RADIUS]))
                stack.append((m[~inside], q[dq.astype(np.int64) > mid - RADIUS]))
                continue
        step = max(1, 4_000_000 // len(m))
        for i in range(0, len(q), step):
            near = np.bitwise_count(fps[q[i:i + step], None] ^ fps[None, m]) <= RADIUS
            a, b = np.nonzero(near)
            links.add(q[i + a], m[b])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest of links of every shard in a stream sorted by shard."""

    def solve(fps: np.ndarray, member: np.ndarray) -> pa.RecordBatch | None:
        if not member.any() or len(fps) < 2:
            return None
        links = _Links(len(fps))
        _search(fps, np.flatnonzero(member), np.arange(len(fps)), links)
        a, b = links.forest()
        if not len(a):
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], names=["a", "b"]
        )

    last, parts = None, []
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in ("shard", "part")], axis=1)
        fps = batch.column("fp").to_numpy().view(np.uint64)
        member = batch.column("member").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(fps)]
        for s, e in zip(cuts, cuts[1:]):
            if s == e:
                continue
            if last is not None and tuple(key[s]) != last:
                if out := solve(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])):
                    yield out
                parts = []
            last = tuple(key[s])
            parts.append((fps[s:e], member[s:e]))
    if parts:
        if out := solve(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])):
            yield out


def near_links(fps: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links ``(a, b)`` that connect just the distinct fingerprints with at most ``RADIUS`` differing bits.

    Exact: every such pair meets in a shard. Of a shard's links a spanning forest
    is returned, so a dense group costs one row per fingerprint and shard.
    """
    spread = visits(fps, _levels(fps.count()))
    large = settle(
        spread.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_rows)
        .select("shard", F.ceil(F.col("n") / shard_rows).cast("int").alias("blocks"))
    )
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    part = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(own, j) * 65_536 + F.greatest(own, j))
    rows = spread.join(large, "shard", "left").select("shard", "fp", "member", F.explode(part).alias("part"))
    rows = rows.repartition("shard", "part").sortWithinPartitions("shard", "part")
    return rows.mapInArrow(_pairs, "a long, b long").distinct()


def clusters(fps: DataFrame) -> DataFrame:
    """``fp, component_id`` and ``head`` (a fingerprint that names the component), one row per distinct fingerprint.

    ``component_id`` is the smallest doc_id of all documents of the component; null ids are passed over.
    """
    least = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    parts = components(near_links(least.select("fp")))
    heads = settle(
        least.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "first_id", F.coalesce("root", "fp").alias("head"))
    )
    ids = heads.groupBy("head").agg(F.min("first_id").alias("component_id"))
    return settle(heads.join(ids, "head").select("fp", "head", "component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` of every row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other. Repeated
    rows share fingerprint and component; an empty table gives an empty table.
    """
    fps = settle(fingerprints(docs).select("doc_id", "fp"))
    found = fps.join(clusters(fps), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that remain if each component keeps the document of smallest id.

    Of rows that share that id (or have none where all ids are null) one stays.
    """
    fps = settle(fingerprints(docs))
    return drop_copies(docs, fps.join(clusters(fps), "fp"))


def drop_copies(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``docs`` less the rows that ``marked`` (row key, doc_id, head and component_id of every row) shows to be copies."""
    first = settle(marked.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))
    several = settle(first.groupBy("head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("head"))
    drop = settle(
        marked.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("_k1", "_k2").distinct()
    )
    k = docs.select(*[f"`{c}`" for c in docs.columns], *row_key(docs))
    # Joined by shuffle at every size: the rows to drop grow with the corpus.
    kept = k.join(drop.hint("shuffle_hash"), ["_k1", "_k2"], "left_anti")
    if several.isEmpty():
        return kept.select(*[f"`{c}`" for c in docs.columns])
    keys = settle(first.join(several, "head").select("_k1", "_k2", "head").distinct())
    least = keys.groupBy("head").agg(F.min(F.struct("_k1", "_k2")).alias("k"))
    again = keys.join(least, "head").select("_k1", "_k2", (F.struct("_k1", "_k2") == F.col("k")).alias("stays"))
    kept = kept.join(again, ["_k1", "_k2"], "left")
    single = kept.filter(F.col("stays").isNull())
    one = kept.filter(F.col("stays")).dropDuplicates(["_k1", "_k2"])
    return single.unionByName(one).select(*[f"`{c}`" for c in docs.columns])
