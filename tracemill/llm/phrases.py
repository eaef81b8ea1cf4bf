"""Phrase mining: Rabin-Karp fingerprints of all word n-grams, verified against the text."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tracemill.llm.blocks import pack, pack_texts, unpack, unpack_texts
from tracemill.llm.common import settle_and_free
from tracemill.session import settle

#: Fewest occurrences of a phrase, most words in it, phrases reported per language, and share of
#: occurrences (in hundredths) inside one longer phrase from which the shorter one is dropped.
LEAST, MOST_WORDS, REPORTED, INSIDE = 30, 4, 2_000, 80
SCALE = 2_000_000
UNKNOWN = "und"
#: Words of one block of one language, and of all languages a task holds at once; fingerprints are counted inside a
#: block before they are shuffled.
BLOCK_WORDS, HELD_WORDS = 1_000_000, 4_000_000
#: Phrases of all blocks that meet in one bucket, on average.
BUCKET_PHRASES = 200_000
_BASE = 0x9E3779B97F4A7C15
_ENDS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"\n" * 10 + b" ")


def _words(text: str | None) -> list[bytes]:
    r"""Lower-cased (A-Z) words, with ``\n`` between pieces."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().translate(_ENDS)
    return [w for w in data.replace(b"\n", b" \n ").split(b" ") if w]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    r"""Blocks of one language: distinct words, and the texts as numbers into them (0 ends a piece)."""
    task, blocks, size = TaskContext.get().partitionId(), 0, 0
    held: dict[str, tuple[dict, list[np.ndarray]]] = {}
    sizes: Counter = Counter()

    def row(lang: str) -> pa.RecordBatch:
        nonlocal blocks, size
        known, parts = held.pop(lang)
        size -= sizes.pop(lang)
        codes = np.concatenate(parts)
        blocks += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([task << 32 | blocks], pa.int64()), pa.array([lang], pa.string()),
             pa.array([int(np.count_nonzero(codes))], pa.int64()), pa.array([len(codes)], pa.int64()),
             pa.array([list(known)], pa.list_(pa.binary())), pa.array([pack(codes)], pa.binary())],
            names=["block", "lang", "n", "places", "words", "codes"])

    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
            parts = _words(text.as_py())
            if not parts:
                continue
            lang = UNKNOWN if lang is None else lang
            if lang not in held:
                known = defaultdict()
                known.default_factory = known.__len__
                held[lang] = known, [np.array([known[b"\n"]], np.int32)]
            known, arrays = held[lang]
            arrays += [np.fromiter(map(known.__getitem__, parts), np.int32, len(parts)), np.zeros(1, np.int32)]
            size += len(parts)
            sizes[lang] += len(parts)
            if sizes[lang] >= BLOCK_WORDS:
                yield row(lang)
            elif size >= HELD_WORDS:
                yield row(max(sizes, key=sizes.get))
    for lang in list(held):
        yield row(lang)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ``wanted``."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


class _Block:
    """One block: fingerprints of its n-grams from prefix polynomials, modulo 2^64."""

    def __init__(self, row: dict):
        import xxhash

        self.words, self.lang = row["words"], row["lang"]
        self.codes = unpack(row["codes"], row["places"])
        seed = xxhash.xxh64_intdigest(self.lang.encode("utf-8", "surrogatepass"))
        self.known = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        size = len(self.codes)
        power = np.full(size, _BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        self.inverse = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        self.inverse[0] = 1
        self.inverse = np.cumprod(self.inverse)
        self.prefix = np.r_[np.uint64(0), np.cumsum(self.known[self.codes] * power)]

    def word_prints(self) -> np.ndarray:
        """Fingerprints of the distinct words; the first is the end of a piece."""
        return _mixed(self.known + np.uint64(1)).view(np.int64)

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        return _mixed((self.prefix[at + n] - self.prefix[at]) * self.inverse[at] + np.uint64(n)).view(np.int64)

    def frequent_words(self, prints: np.ndarray) -> np.ndarray:
        """Places whose word is frequent; ends of pieces never are."""
        good = _among(self.word_prints(), prints)
        good[0] = False
        return np.r_[good[self.codes], False]

    def longer(self, frequent: np.ndarray) -> np.ndarray:
        """Places where both parts of an n-gram, all but its last and all but its first word, are frequent: both lie in one piece."""
        return np.flatnonzero(frequent[:-1] & frequent[1:])

    def keep(self, at: np.ndarray, n: int, prints: np.ndarray) -> np.ndarray:
        """The places among ``at`` whose n-gram is frequent, as flags."""
        flags = np.zeros(len(self.codes) + 1, bool)
        flags[at[_among(self.prints(at, n), prints)]] = True
        return flags

    def texts(self, at: np.ndarray, n: int) -> Iterator[tuple[bytes, int]]:
        """Text and count of the n-grams at the places ``at``; those that only share a fingerprint are told apart by their words."""
        if not len(at):
            return
        found = self.prints(at, n)
        order = np.argsort(found, kind="stable")
        at, found = at[order], found[order]
        new = np.r_[True, found[1:] != found[:-1]]
        begin = np.flatnonzero(new)
        first = at[begin][np.cumsum(new) - 1]
        equal = np.ones(len(at), bool)
        for i in range(n):
            equal &= self.codes[at + i] == self.codes[first + i]
        words, codes = self.words, self.codes
        table = codes[at[begin][:, None] + np.arange(n)].tolist()
        for row, count in zip(table, np.add.reduceat(equal.astype(np.int64), begin).tolist()):
            yield b" ".join([words[c] for c in row]), count
        clashing = Counter(map(tuple, codes[at[~equal][:, None] + np.arange(n)].tolist()))
        for row, count in clashing.items():
            yield b" ".join([words[c] for c in row]), count

    def word_texts(self, prints: np.ndarray) -> Iterator[tuple[bytes, int]]:
        good = _among(self.word_prints(), prints)
        good[0] = False
        counts = np.bincount(self.codes, minlength=len(self.words))
        for i in np.flatnonzero(good).tolist():
            yield self.words[i], int(counts[i])


def _prints(table: pa.Table, n: int) -> np.ndarray:
    """The sorted fingerprints of ``n`` words among rows ``(block, words_in, print)``."""
    return np.unique(table.column("print").to_numpy()[table.column("words_in").to_numpy() == n])


def _count(n: int):
    """Fingerprints of ``n`` words in a block with their counts; the block is the pointer to where they occur."""

    def run(blocks: pa.Table, shorter: pa.Table) -> pa.Table:
        out = [pa.schema([("print", pa.int64()), ("block", pa.int64()), ("c", pa.int64())]).empty_table()]
        for row in blocks.to_pylist():
            block = _Block(row)
            if n == 1:
                found = block.word_prints()[1:]
                count = np.bincount(block.codes, minlength=len(block.words))[1:]
            else:
                known = _prints(shorter, n - 1)
                if n == 2:
                    frequent = block.frequent_words(known)
                else:
                    # Without the sets of still shorter parts a place is judged by its own fingerprint; ends of pieces stop it.
                    ends = np.concatenate([np.flatnonzero(block.codes == 0), [len(block.codes)]])
                    at = np.arange(len(block.codes))
                    frequent = block.keep(at[ends[np.searchsorted(ends, at)] - at >= n - 1], n - 1, known)
                found, count = np.unique(block.prints(block.longer(frequent), n), return_counts=True)
            out.append(pa.table({
                "print": found, "block": np.full(len(found), row["block"], np.int64), "c": count.astype(np.int64)}))
        return pa.concat_tables(out)

    return run


def _materialise(most: int, buckets: int):
    """Texts and counts of the frequent n-grams of a block by bucket, the same phrase always in the same one."""

    def run(blocks: pa.Table, prints: pa.Table) -> pa.Table:
        import xxhash

        out = []
        for row in blocks.to_pylist():
            block = _Block(row)
            held: dict[int, tuple[list, list, list]] = {}
            frequent = block.frequent_words(_prints(prints, 1))
            for n in range(1, most + 1):
                if n > 1:
                    frequent = block.keep(block.longer(frequent), n, _prints(prints, n))
                found = block.word_texts(_prints(prints, 1)) if n == 1 else block.texts(np.flatnonzero(frequent), n)
                for text, count in found:
                    texts, sizes, counts = held.setdefault(xxhash.xxh64_intdigest(text) % buckets, ([], [], []))
                    texts.append(text.decode("utf-8", "surrogatepass")), sizes.append(n), counts.append(count)
            out += [(b, row["lang"], len(t), pack_texts(t), pack(np.array(n)), pack(np.array(c))) for b, (t, n, c) in held.items()]
        columns = list(zip(*out)) or [[]] * 6
        return pa.table({
            "bucket": pa.array(columns[0], pa.int64()), "lang": pa.array(columns[1], pa.string()),
            "rows": pa.array(columns[2], pa.int64()), "phrases": pa.array(columns[3], pa.binary()),
            "sizes": pa.array(columns[4], pa.binary()), "counts": pa.array(columns[5], pa.binary())})

    return run


def _add_up(least: int):
    """Counts of phrases over blocks, in a stream sorted by bucket and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, words_in = None, Counter(), {}

        def rows() -> pa.RecordBatch:
            found = [(p, c) for p, c in total.items() if c >= least]
            return pa.RecordBatch.from_arrays(
                [pa.array([last[1]] * len(found), pa.string()), pa.array([words_in[p] for p, _ in found], pa.int32()),
                 pa.array([p for p, _ in found], pa.string()), pa.array([c for _, c in found], pa.int64())],
                names=["lang", "words_in", "phrase", "f"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if last != (row["bucket"], row["lang"]):
                    if total:
                        yield rows()
                    last, total, words_in = (row["bucket"], row["lang"]), Counter(), {}
                phrases = unpack_texts(row["phrases"])
                words_in.update(zip(phrases, unpack(row["sizes"], row["rows"]).tolist()))
                for phrase, count in zip(phrases, unpack(row["counts"], row["rows"]).tolist()):
                    total[phrase] += count
        if total:
            yield rows()

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, most: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``most`` words with at least ``least`` occurrences, and the words of each language.

    The first table is ``(lang, words_in, phrase, f)``, the second ``(lang, n)``. Texts become blocks of word
    numbers. In each round the n-grams of a block whose shorter parts are frequent are fingerprinted and counted there;
    a shuffle adds the counts of a fingerprint over blocks (one row per block, however hot the phrase) and
    keeps, with the blocks that hold them, those that occur often enough. A fingerprint's count is at least its phrases',
    so none is lost. Last, blocks write out the texts behind the kept fingerprints, told apart by their words, and texts are
    counted in buckets whose number follows theirs: fingerprints that clash, in a block or over blocks, change nothing.
    """
    blocks = settle(docs.select("text", "lang").mapInArrow(
        _split, "block long, lang string, n long, places long, words array<binary>, codes binary"))
    kept = frequent = docs.sparkSession.createDataFrame([], "block long, words_in int, print long")
    over = Window.partitionBy("print")
    for n in range(1, most + 1):
        counted = blocks.groupBy("block").cogroup(frequent.groupBy("block")).applyInArrow(_count(n), "print long, block long, c long")
        frequent = settle_and_free(
            counted.withColumn("total", F.sum("c").over(over)).filter(F.col("total") >= least)
            .select("block", F.lit(n).alias("words_in"), "print"))
        kept = frequent if n == 1 else kept.unionByName(frequent)
    buckets = -(-kept.count() // BUCKET_PHRASES) or 1
    found = blocks.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(
        _materialise(most, buckets), "bucket long, lang string, rows long, phrases binary, sizes binary, counts binary")
    counts = found.repartition("bucket").sortWithinPartitions("bucket", "lang").mapInArrow(
        _add_up(least), "lang string, words_in int, phrase string, f long")
    return settle_and_free(counts), blocks.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, reported: int = REPORTED) -> DataFrame:
    r"""The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs.
    A candidate is a phrase of 2 to 4 words with ``a >= least`` occurrences inside pieces. Cut after its
    first k words into parts with ``l`` and ``r`` occurrences it scores ``floor(2000000 a / (l + r))``; its lowest cut counts, the
    smallest k among equals. Candidates that mostly (80 %) occur inside one longer candidate go. Ranks follow score, ``a`` (both
    descending) and phrase. Null texts are empty, a null language is ``und``, repeated rows count each, other columns
    are ignored; a language without candidates, or an empty table, gives no row.
    """
    counts, sizes = phrase_counts(docs, least)
    parts = counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("pf"))
    long = (
        counts.filter("words_in > 1").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    )
    cuts = long.select(
        "lang", "phrase", "words_in", "a", F.explode(F.sequence(F.lit(1), F.col("words_in") - 1)).alias("k"), "w"
    ).select("lang", "phrase", "words_in", "a", "k", F.explode(F.array(
        F.struct(F.lit(True).alias("is_first"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("part")),
        F.struct(F.lit(False).alias("is_first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words_in") - F.col("k")), " ").alias("part")),
    )).alias("p")).select("lang", "phrase", "words_in", "a", "k", "p.*")
    scored = (
        cuts.join(parts, ["lang", "part"]).groupBy("lang", "phrase", "words_in", "a", "k")
        .agg(F.max(F.when(F.col("is_first"), F.col("pf"))).alias("l"), F.max(F.when(~F.col("is_first"), F.col("pf"))).alias("r"))
        .withColumn("score", F.expr(
            f"cast(a as decimal(19,0)) * {SCALE} div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
        .groupBy("lang", "phrase", "words_in", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    inner = long.filter("words_in > 2").select("lang", "a", "w", "words_in").select(
        "lang", "a", "w", "words_in", F.explode(F.sequence(F.lit(2), F.col("words_in") - 1)).alias("m")
    ).select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words_in") - F.col("m") + 1)).alias("s")).select(
        "lang", F.array_join(F.slice("w", F.col("s"), F.col("m")), " ").alias("phrase"), "a")
    longest = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    hundred = F.lit(100).cast("decimal(3,0)") * F.col("longer").cast("decimal(19,0)")
    mostly = hundred >= F.lit(INSIDE).cast("decimal(3,0)") * F.col("a").cast("decimal(19,0)")
    left = scored.join(longest, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | ~mostly)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn(
        "rank", F.row_number().over(order)).filter(F.col("rank") <= reported)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocation_sql(least: int = LEAST, reported: int = REPORTED) -> str:
    """The same over ``documents`` in DuckDB SQL."""
    grams = "\n  UNION ALL ".join(
        f"SELECT lang, {n} AS k, array_to_string(w[i:i + {n - 1}], ' ') AS p FROM places WHERE i + {n - 1} <= len(w)" for n in range(1, MOST_WORDS + 1))
    return f"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
 ws AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
 places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM ws),
 grams AS ({grams}),
 f AS (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {least}),
 n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM ws GROUP BY lang),
 c AS (SELECT lang, k AS m, p AS phrase, f AS a, string_split(p, ' ') AS w FROM f WHERE k > 1),
 cuts AS (SELECT *, unnest(range(1, m)) AS k FROM c),
 scored AS (SELECT c.lang, c.phrase, c.m, c.a, c.k, l.f AS l, r.f AS r, (c.a::HUGEINT * {SCALE} // (l.f + r.f))::BIGINT AS score
   FROM cuts c JOIN f l ON l.lang = c.lang AND l.p = array_to_string(c.w[1:c.k], ' ')
   JOIN f r ON r.lang = c.lang AND r.p = array_to_string(c.w[c.k + 1:c.m], ' ')),
 cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 subs AS (SELECT lang, a, w, m, unnest(range(2, m)) AS s FROM c),
 subs2 AS (SELECT lang, a, w, s, unnest(range(1, m - s + 2)) AS b FROM subs),
 longer AS (SELECT lang, array_to_string(w[b:b + s - 1], ' ') AS phrase, max(a) AS longer FROM subs2 GROUP BY ALL),
 kept AS (SELECT cut.* FROM cut LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer::HUGEINT < {INSIDE} * a::HUGEINT),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {reported}"""
