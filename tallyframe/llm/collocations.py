"""Phrases whose words occur together more often than apart, counted by sorting suffixes.

A suffix is the words from one place of a piece on, as deep as phrases are long. Suffixes are routed by their leading words to
buckets, so that all suffixes with one beginning meet, and each bucket is sorted by multikey three-way quicksort: partitions
are split into the suffixes whose next word is less than, equal to and greater than a pivot, and the equal ones go on with
the word after it. The size of an equal partition is the count of the phrase its suffixes begin with; a partition smaller
than the least count is abandoned, however much of it is still unsorted.

Words are counted first. A phrase cannot be more frequent than its words, so a suffix ends before a word below the least
count; tasks know such words by a table of bits of fixed size, which lets more of them pass the more words there are, and
never stops another. Equal suffixes of a task are one with a weight before they move. Buckets are measured before they are sorted: one that is
too large is dealt again by the same leading words, and if a hot beginning keeps it large, by all words, where the sums of
its parts give the counts of the shorter phrases. Words are compared by 64-bit hashes that hold the language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm import words as W
from tallyframe.llm.common import small_batches, total, written
from tallyframe.llm.interpolation import packed, unpacked
from tallyframe.llm.registry import query

READ_BYTES = 1 << 20  # texts cut into words together
CHUNK = 1 << 20  # suffixes brought together before they move
BUCKET = 3 << 18  # suffixes sorted together
BUCKETS = 4096  # of the first deal
LEADING = 2  # words that route a suffix
SIEVE_BITS = 24  # a word is looked up in a table of 2^SIEVE_BITS bits

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [*range(0x0A, 0x0E)]] = True
_INSIDE = ~_BREAK
_INSIDE[[0x20, 0x09]] = False
_GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Mine:
    """What is mined: phrases of 2 to `longest` words that occur `least` times; a phrase goes if a longer one has `inside`
    percent of its occurrences; the first `top` of each language are returned."""

    longest: int = 3
    least: int = 10
    inside: int = 50
    top: int = 2000


# ---- suffixes ------------------------------------------------------------------------------------------------------


class Cut:
    """The words of a batch of texts with their keys, texts and pieces."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = W.text_bytes(batch.column("text"))
        self.data = W.FOLD[data]
        self.words = W.Words(self.data, offsets, _INSIDE, False)
        lang = batch.column("lang_hash").to_numpy(zero_copy_only=False).view(np.uint64)
        self.keys = W.mixed(self.words.hash ^ lang[self.words.doc]) | np.uint64(1)
        self.batch = batch

    def suffixes(self, longest: int, sieve: np.ndarray) -> np.ndarray:
        """A row of word keys for each suffix of two words or more, 0 beyond its end."""
        n = len(self.keys)
        piece = np.cumsum(_BREAK[self.data])[self.words.start] if n else np.empty(0, np.int64)
        going = sieve[self.keys >> np.uint64(64 - SIEVE_BITS)]
        may = going.copy()
        keys = np.zeros((n, longest), np.uint64)
        keys[:, 0] = self.keys
        for d in range(1, min(longest, max(n, 1))):
            going[n - d :] = False
            going[: n - d] &= (piece[d:] == piece[: n - d]) & (self.words.doc[d:] == self.words.doc[: n - d]) & may[d:]
            at = np.flatnonzero(going)
            keys[at, d] = self.keys[at + d]
        return keys[keys[:, 1] != 0]

    def vocabulary(self) -> pa.Table:
        """(key, lang, word, times) of each different word."""
        names, first, times = np.unique(self.keys, return_index=True, return_counts=True)
        text, start, end = self.data.tobytes(), self.words.start[first], self.words.start[first] + self.words.length[first]
        word = pa.array([text[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)], pa.binary()).cast(pa.string())
        lang = self.batch.column("lang").take(pa.array(self.words.doc[first], pa.int64()))
        return pa.table([pa.array(names.view(np.int64)), lang, word, pa.array(times, pa.int64())], ["key", "lang", "word", "times"])


def routed(keys: np.ndarray, words: int, parts: int, salt: int) -> np.ndarray:
    """The part of each suffix, by its leading words."""
    value = np.full(len(keys), np.uint64(salt))
    for d in range(words):
        value = W.mixed(value * _GOLD + keys[:, d])
    return ((value >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def frames(keys: np.ndarray, weights: np.ndarray, words: int, parts: int, salt: int) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    """(part, suffixes, names, places, weights) of each part: equal suffixes are one, and words are places in a dictionary."""
    if not len(keys):
        return
    value = np.zeros(len(keys), np.uint64)
    for d in range(keys.shape[1]):
        value = W.mixed(value * _GOLD + keys[:, d])
    value >>= np.uint64(20)
    value |= routed(keys, words, parts, salt).astype(np.uint64) << np.uint64(44)
    order = np.argsort(value)
    part = (value[order] >> np.uint64(44)).astype(np.int32)
    del value
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for i, j in zip(edges, np.append(edges[1:], len(part)), strict=True):
        own, weight = keys[order[i:j]], weights[order[i:j]]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]).any(axis=1)
        heads = np.flatnonzero(new)
        own, weight = own[heads], np.add.reduceat(weight, heads)
        names, places = np.unique(own.T.ravel(), return_inverse=True)
        places = places.astype(np.uint32).reshape(keys.shape[1], -1)
        sort = np.argsort(places[0].astype(np.uint64) << np.uint64(32) | places[1])  # equal beginnings together: smaller when packed
        yield int(part[i]), len(own), packed(np.diff(names, prepend=np.uint64(0))), packed(places[:, sort].ravel()), packed(weight[sort])


def unframed(batch: pa.RecordBatch | pa.Table, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes and weights of some frames."""
    sizes = batch.column("n").to_pylist()
    keys, weights = np.empty((sum(sizes), longest), np.uint64), np.empty(sum(sizes), np.int64)
    at = 0
    for i, n in enumerate(sizes):
        names, places, weight = (batch.column(c)[i].as_py() for c in ("names", "places", "weights"))
        names = np.cumsum(unpacked(names, np.uint64), dtype=np.uint64)
        keys[at : at + n] = names[unpacked(places, np.uint32)].reshape(longest, n).T
        weights[at : at + n] = unpacked(weight, np.int64)
        at += n
    return keys, weights


FRAME = "bucket long, n long, names binary, places binary, weights binary"
WORD = "key long, lang string, word string, times long"
_FRAME = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), ("names", pa.binary()), ("places", pa.binary()), ("weights", pa.binary())])


def _framed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _FRAME, strict=True)], schema=_FRAME)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of some texts at a time, each once."""

    def together(held: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(held).combine_chunks()
        names, first, which = np.unique(table.column("key").to_numpy(), return_index=True, return_inverse=True)
        times = np.bincount(which, weights=table.column("times").to_numpy(), minlength=len(names)).astype(np.int64)
        table = table.take(pa.array(first)).set_column(3, "times", pa.array(times))
        return table.combine_chunks().to_batches()[0]

    held: list[pa.Table] = []
    for batch in W.chunks(batches, "text", READ_BYTES):
        found = Cut(batch).vocabulary()
        if len(found):
            held.append(found)
        if sum(map(len, held)) >= CHUNK // 3:
            yield together(held)
            held = []
            W.trim()
    if held:
        yield together(held)
    W.trim()


def _chunks(longest: int, parts: int, bits: bytes):
    """The frames of the suffixes of some texts at a time."""
    sieve = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)

    def joined(keys: list[np.ndarray]) -> np.ndarray:
        n = sum(map(len, keys))
        out = np.empty((n, longest), np.uint64)
        while keys:
            part = keys.pop()
            n -= len(part)
            out[n : n + len(part)] = part
        return out

    def rows(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        n = sum(map(len, keys))
        made = list(frames(joined(keys), np.ones(n, np.int64), LEADING, parts, 1))
        if made:
            yield _framed(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        for batch in W.chunks(batches, "text", READ_BYTES):
            keys.append(Cut(batch).suffixes(longest, sieve))
            if sum(map(len, keys)) >= CHUNK:
                yield from rows(keys)
                W.trim()
        yield from rows(keys)
        W.trim()

    return run


def _sieve(often: DataFrame) -> bytes:
    """The bits of the words' keys: 2^SIEVE_BITS of them, whatever the number of words."""
    bit = F.shiftrightunsigned("key", 64 - SIEVE_BITS) + 1
    parts = often.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out, size = bytearray(1 << (SIEVE_BITS - 3)), 1 << 12
    for r in parts:
        at = (r["part"] - 1) * size
        out[at : at + size] = r["bits"]
    return bytes(out)


def _again(longest: int, words: int):
    """Frames of too large buckets, which come in the order of buckets, dealt into `parts` each."""

    def deal(held: list[pa.RecordBatch], bucket: int, parts: int) -> pa.RecordBatch:
        keys, weights = unframed(pa.Table.from_batches(held), longest)
        return _framed([((bucket + 1) * 8192 + 1 + r[0], *r[1:]) for r in frames(keys, weights, words, parts, words + bucket % 1009 + 2)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, now = 0, (0, 0)
        for batch in batches:
            for i, (bucket, parts, n) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("bucket", "parts", "n")], strict=True)):
                if held and ((bucket, parts) != now or size >= BUCKET // 2):
                    yield deal(held, *now)
                    held, size = [], 0
                held.append(batch.slice(i, 1))
                size, now = size + n, (bucket, parts)
        if held:
            yield deal(held, *now)

    return run


# ---- the sort ------------------------------------------------------------------------------------------------------


def quicksorted(keys: np.ndarray, weights: np.ndarray, least: int, whole: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, words, weight) of the phrases of two words or more that suffixes begin with: a suffix that begins so, the length
    and the weight of all that do. Phrases of at least `whole` words have all their suffixes here and are returned from the
    weight `least` on; shorter ones are returned with whatever is here.

    All partitions are split at once, each by the median of three of its suffixes.
    """
    longest = keys.shape[1]
    row = np.arange(len(keys), dtype=np.int32)
    size, depth = np.array([len(keys)]), np.array([0], np.int8)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(row):
        start = np.cumsum(size) - size
        of = np.repeat(np.arange(len(size), dtype=np.int32), size)
        value = keys[row, depth[of]]
        three = np.sort(np.stack([value[start], value[start + size // 2], value[start + size - 1]]), axis=0)
        pivot = three[1]
        split = pivot[of]
        side = (value > split) * np.int8(2) + (value == split)
        del split, value
        counts = np.bincount(of * 3 + side, minlength=3 * len(size))
        offset = np.cumsum(counts) - counts
        moved = np.empty_like(row)
        for s in range(3):
            at = np.flatnonzero(side == s)
            own = counts[s::3]
            moved[(offset[s::3] - np.cumsum(own) + own)[of[at]] + np.arange(len(at))] = row[at]
        some = np.flatnonzero(counts)
        weight = np.add.reduceat(weights[moved], offset[some])
        parent, equal = some // 3, some % 3 == 1
        ends = equal & (pivot[parent] == 0)
        deep = (depth[parent] + equal).astype(np.int8)
        phrase = equal & ~ends & (deep >= 2) & ((weight >= least) | (deep < whole))
        found.append((moved[offset[some[phrase]]], deep[phrase], weight[phrase]))
        # all phrases yet to come out of a partition have deep + 1 words or more, and two at least
        keep = ~ends & (deep < longest) & ((weight >= least) | (np.maximum(deep + 1, 2) < whole))
        row = moved[np.repeat(keep, counts[some])]
        size, depth = counts[some[keep]], deep[keep]
    return tuple(np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]) for i in range(3))


def _counted(longest: int, least: int):
    def run(table: pa.Table) -> pa.Table:
        keys, weights = unframed(table, longest)
        row, words, weight = quicksorted(keys, weights, least, table.column("whole")[0].as_py())
        del weights
        ends = np.cumsum(words)
        flat = keys[np.repeat(row, words), np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - words, words)]
        split = pa.array(np.append(0, ends).astype(np.int32))
        W.trim()
        return pa.table({"key": pa.ListArray.from_arrays(split, pa.array(flat.view(np.int64))), "a": pa.array(weight, pa.int64())})

    return run


def counts(docs: DataFrame, mine: Mine) -> tuple[DataFrame, DataFrame]:
    """(phrases, words) of rows (lang, lang_hash, text): (key, a) of every phrase of two words or more with the least count,
    the key being its words' keys; and (key, lang, word, times) of every word."""
    size = total(docs, F.sum(F.octet_length("text")).alias("n"))["n"] or 0
    parts = min(BUCKETS, max(1, math.ceil(size / 6 / BUCKET)))
    words = docs.mapInArrow(_words, WORD).groupBy("key", "lang", "word").agg(F.sum("times").alias("times"))
    words = written(words, "words")
    bits = _sieve(words.filter(F.col("times") >= mine.least))
    rest = written(docs.select("lang_hash", "text").mapInArrow(_chunks(mine.longest, parts, bits), FRAME), "suffixes")
    ready = []
    for leading in (LEADING, mine.longest):
        sizes = rest.groupBy("bucket").agg(F.sum("n").alias("all"))
        over = sizes.filter(F.col("all") > 2 * BUCKET).select("bucket", F.least(F.ceil(F.col("all") / BUCKET), F.lit(8191)).cast("long").alias("parts"))
        over = written(over, "over")
        n = over.count()
        whole = F.lit(LEADING).alias("whole")
        ready.append(rest.join(over, "bucket", "left_anti").select("*", whole) if n else rest.select("*", whole))
        if not n:
            rest = None
            break
        dealt = rest.join(over, "bucket").repartition(max(1, min(n, 4 * BUCKETS)), "bucket").sortWithinPartitions("bucket")
        rest = written(dealt.mapInArrow(_again(mine.longest, leading), FRAME), "dealt")
    if rest is not None:
        ready.append(rest.select("*", F.lit(mine.longest).alias("whole")))
    together = ready[0]
    for more in ready[1:]:
        together = together.unionByName(more)
    found = together.groupBy("bucket").applyInArrow(_counted(mine.longest, mine.least), "key array<long>, a long")
    phrases = found.groupBy("key").agg(F.sum("a").alias("a")).filter(F.col("a") >= mine.least)
    return written(phrases, "phrases"), words


# ---- scores --------------------------------------------------------------------------------------------------------


def collocations(docs: DataFrame, mine: Mine = Mine(), text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases: occurrences of the phrase, of the two parts at
    its weakest cut, of all words; score floor(1000000 a a / (l r)) in exact decimals (for counts below 10^16).

    A NULL language is `und`, a NULL text is empty, repeated rows count as often as they stand. Ties in score and count are
    ordered by the phrase's bytes.
    """
    named = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    rows = docs.select(named.alias("lang"), F.xxhash64(named).alias("lang_hash"), F.col(text).cast("string").alias("text")).filter("text != ''")
    with small_batches(docs.sparkSession):
        phrases, words = counts(rows, mine)
    n = words.groupBy("lang").agg(F.sum("times").alias("n"))
    often = words.filter(F.col("times") >= mine.least)
    sizes = phrases.unionByName(often.select(F.array("key").alias("key"), F.col("times").alias("a")))

    cut = phrases.select("key", "a", F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k"))
    cut = cut.withColumn("left", F.slice("key", F.lit(1), F.col("k"))).withColumn("right", F.slice("key", F.col("k") + 1, F.size("key") - F.col("k")))
    cut = cut.join(sizes.select(F.col("key").alias("left"), F.col("a").alias("l")), "left").join(sizes.select(F.col("key").alias("right"), F.col("a").alias("r")), "right")
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    cut = cut.withColumn("over", (exact("a") * exact("a") * F.lit(1000000).cast("decimal(7,0)")).cast("decimal(38,0)")).withColumn("under", (exact("l") * exact("r")).cast("decimal(38,0)"))
    weakest = cut.groupBy("key").agg(F.min(F.struct(F.expr("over div under").cast("long").alias("score"), "k", "a", "l", "r")).alias("w"))

    # shorter phrases inside each longer one: the most frequent of those decides
    longer = phrases.filter(F.size("key") > 2)
    inner = longer.select("a", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("key") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.size("key") - m + 1), lambda i: F.slice("key", i, m)),
    ))).alias("key"), F.size("key").alias("longer")).groupBy("key").agg(F.max("a").alias("most"))
    kept = weakest.join(inner, "key", "left").filter(F.col("most").isNull() | (100 * F.col("most") < mine.inside * F.col("w.a"))).select("key", "w.*")

    # the best by score and count, all ties included, get their words; ties are then ordered by them
    first = kept.withColumn("first", F.get("key", F.lit(0))).join(words.select(F.col("key").alias("first"), "lang"), "first")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = first.withColumn("at", F.rank().over(order)).filter(F.col("at") <= mine.top).select("lang", "key", "score", "a", "l", "r")
    spelt = best.select("*", F.posexplode("key").alias("i", "one")).join(words.select(F.col("key").alias("one"), "word"), "one")
    spelt = spelt.groupBy("lang", "key", "score", "a", "l", "r").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w"))
    spelt = spelt.withColumn("phrase", F.array_join("w.word", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelt.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= mine.top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM t),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
f AS (SELECT lang, ws[i:i + m - 1] AS key, count(*) AS a FROM s, (VALUES (1), (2), (3)) AS x(m) WHERE i + m - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE len(key) = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE len(key) > 1 AND a >= 10),
ck AS MATERIALIZED (SELECT lang, key, a, k, key[1:k] AS lk, key[k + 1:len(key)] AS rk FROM (SELECT lang, key, a, unnest(range(1, len(key))) AS k FROM c)),
cut AS (SELECT ck.lang, ck.key, ck.a, k, l.a AS l, r.a AS r, CAST((1000000::HUGEINT * ck.a * ck.a) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
        FROM ck JOIN f AS l ON l.lang = ck.lang AND l.key = lk JOIN f AS r ON r.lang = ck.lang AND r.key = rk),
w AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, key ORDER BY score, k) = 1),
inner_ AS (SELECT lang, key[i:i + 1] AS key, max(a) AS most FROM (SELECT lang, key, a, unnest([1, 2]) AS i FROM c WHERE len(key) = 3) GROUP BY ALL),
kept AS (SELECT w.* FROM w LEFT JOIN inner_ USING (lang, key) WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(key, ' ')) AS rank, array_to_string(key, ' ') AS phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""


@query("op11_collocations", SQL)
def op11_collocations(spark, sf_dir):
    """Each language's first 2000 phrases of two and three words."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))
