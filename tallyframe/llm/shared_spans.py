"""Removal of byte strings that occur more than once in the corpus, by merged Burrows-Wheeler transforms.

Strings of SPAN bytes that are equal have equal anchors: the leftmost smallest of the hashes of their ANCHOR-byte pieces.
Runs of strings with one anchor are cut out of the texts; a run whose anchor occurs once cannot repeat. The other runs are
grouped by anchor, so equal strings meet in one group of bounded size, and each group is handled by one task:

* The runs are dealt to shards. Each shard's suffixes are ordered once and give its transform, over an alphabet of STEP-byte
  blocks: next to each suffix stands the block before it.
* The shards' transforms are merged by refining an interleave. It begins as "all of shard 0, all of shard 1, ..."; a round
  reads the blocks in the order of the interleave and deals the suffixes before them stably by block, which sorts them one
  block deeper. No suffix is compared or sorted again. Where neighbours stop sharing a round's prefix is noted, which gives
  the common prefixes; after SPAN / STEP rounds the intervals that still hold together are the repeated strings.

A group of one anchor too large for a task (a short passage in very many contexts) is settled by counting its strings'
hashes instead, which any number of tasks share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import words as W
from tallyframe.llm.common import small_batches, total, written
from tallyframe.llm.registry import query

SPAN = 200
STEP = 50  # SPAN is a multiple
ANCHOR = 32
SHARDS = 4
GROUP_BYTES = 2 << 20  # of runs handled together
HOT_BYTES = 2 << 20  # of runs with one anchor, beyond which they are counted by hash


# ---- anchors -------------------------------------------------------------------------------------------------------


def _rolled(x: np.ndarray, width: int, salt: int) -> np.ndarray:
    """A hash of the `width` (a power of two) values that start at each place."""
    factors = W.spread(64, salt) | np.uint64(1)
    size = 1
    while size < width:
        x = x[:-size] * factors[2 * size.bit_length()] + x[size:] * factors[2 * size.bit_length() + 1]
        size *= 2
    return W.mixed(x)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, key) of the runs: the text, the place in the text where the run's first string starts, the anchor's hash.
    A run ends where the next of its text starts, the last one with the text's last string."""
    empty = np.empty(0, np.int64)
    if len(data) < SPAN:
        return empty, empty, empty
    pieces = _rolled(W._BYTE[data], ANCHOR, 41)
    bits = np.uint64(len(pieces).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    best = (pieces & ~low) | np.arange(len(pieces), dtype=np.uint64)
    width, size = SPAN - ANCHOR + 1, 1
    while 2 * size <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    at = (best & low).astype(np.int64)
    strings = np.maximum(np.diff(offsets) - SPAN + 1, 0)
    doc = np.repeat(np.arange(len(strings)), strings)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(strings) - strings, strings)
    where = at[place + offsets[doc]]
    new = np.ones(len(doc), bool)
    new[1:] = (where[1:] != where[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], place[new], pieces[where[new]].view(np.int64)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.chunks(batches, "text"):
        data, offsets = W.text_bytes(batch.column("text"))
        doc, start, key = anchors(data, offsets)
        last = np.maximum(np.diff(offsets) - SPAN, 0)
        end = np.append(start[1:] - 1, 0)
        final = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) if len(doc) else np.empty(0, np.int64)
        end[final] = last[doc[final]]
        first = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
        runs = pa.StructArray.from_arrays([pa.array(key), pa.array(start * 1024 + (end - start))], ["key", "at"])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("rid"), batch.column("crc"), pa.ListArray.from_arrays(first, runs)], ["id", "rid", "crc", "runs"]
        )


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, to be moved."""
    for batch in W.chunks(batches, "text"):
        data, offsets = W.text_bytes(batch.column("text"))
        whole, bounds = data.tobytes(), offsets.tolist()
        zipped = pa.array([zstandard.compress(whole[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], zipped], [*names, "text"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs picked in each text: a row per occurrence, and a row with the bytes of each different run of a batch."""
    for batch in batches:
        picks = batch.column("picks")
        edges = (picks.offsets.to_numpy() - picks.offsets[0].as_py()).tolist()
        values = picks.flatten()
        keys, places = values.field("key").to_pylist(), values.field("at").to_pylist()
        rids, crcs = batch.column("rid").to_pylist(), batch.column("crc").to_pylist()
        occurrences: list[tuple] = []
        runs: dict[tuple[int, int], list] = {}
        for d, zipped in enumerate(batch.column("text")):
            text = zstandard.decompress(zipped.as_py())
            for i in range(edges[d], edges[d + 1]):
                start, more = divmod(places[i], 1024)
                run = text[start : start + more + SPAN]
                name = (keys[i], xxhash.xxh3_64_intdigest(run) - (1 << 63))
                occurrences.append((*name, rids[d], crcs[d], start))
                held = runs.get(name)
                if held:
                    held[1] += 1
                else:
                    runs[name] = [run, 1]
        m, n = len(runs), len(occurrences)
        column = lambda values, kind: pa.array(values, kind)
        both = [*runs, *((o[0], o[1]) for o in occurrences)]
        yield pa.RecordBatch.from_arrays(
            [
                column([k for k, _ in both], pa.int64()), column([s for _, s in both], pa.int64()),
                column([r[0] for r in runs.values()] + [None] * n, pa.binary()), column([r[1] for r in runs.values()] + [None] * n, pa.int64()),
                *[column([None] * m + [o[c] for o in occurrences], pa.int64()) for c in (2, 3, 4)],
            ],
            ["key", "run", "bytes", "times", "rid", "crc", "start"],
        )


# ---- transforms and their merge ------------------------------------------------------------------------------------


def stable_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of non-negative numbers. Keys that leave room for their places are sorted with these, as one number
    each; others by 16 bits at a time, which takes linear time."""
    keys = keys.astype(np.uint64, copy=False)
    top, bits = int(keys.max()) if len(keys) else 0, len(keys).bit_length()
    if top.bit_length() + bits <= 64:
        return _with_places(keys, bits)
    order = np.argsort((keys & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")
    for shift in range(16, 64, 16):
        if top >> shift == 0:
            break
        digit = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def _with_places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The order of numbers by all but their first `bits` bits from the top, each sorted with its place below them."""
    joined = keys << np.uint64(bits)
    joined |= np.arange(len(keys), dtype=np.uint64)
    joined.sort()
    joined &= (np.uint64(1) << np.uint64(bits)) - np.uint64(1)
    return joined.view(np.int64)


def ranked(keys: np.ndarray) -> np.ndarray:
    """The place of each number among the different ones."""
    return _ranked(keys, stable_order(keys))


def _ranked(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    inside = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.append(False, inside[1:] != inside[:-1])) if len(keys) else 0
    return rank


def named(hashes: np.ndarray) -> np.ndarray:
    """A number for each different hash, from 0. Hashes are sorted by what their places leave room for; should two differ in
    the rest alone, by all."""
    bits = len(hashes).bit_length()
    order = _with_places(hashes, bits)
    inside = hashes[order]
    differ = inside[1:] != inside[:-1]
    alike = (inside[1:] << np.uint64(bits)) == (inside[:-1] << np.uint64(bits))
    return ranked(hashes) if (differ & alike).any() else _ranked(hashes, order)


class Runs:
    """Some byte strings, each with one more row than bytes: a row is a suffix, the last one empty. `block` names the STEP
    bytes from a row on, 0 where fewer are left."""

    def __init__(self, strings: list[bytes], salt: int):
        self.length = np.array([len(s) for s in strings], np.int64)
        rows = self.length + 1
        self.first = np.cumsum(rows) - rows
        n = int(rows.sum())
        joined = b"\0".join(strings) + b"\0" * (SPAN + 9)
        self.words = np.ndarray(n + SPAN, "<u8", joined, 0, (1,)).copy()  # eight bytes from each row on
        self.string = np.repeat(np.arange(len(strings), dtype=np.int32), rows)
        self.end = np.repeat(self.first + self.length, rows)
        row = np.arange(n)
        full = row + STEP <= self.end
        self.block = np.zeros(n, np.int64)
        self.block[full] = named(self._hashes(n, salt)[full]) + 1
        self.before = np.full(n, -1, np.int64)  # the block before each row, -1 at the head of a string
        inside = np.flatnonzero(row[STEP:] - STEP >= np.repeat(self.first, rows)[STEP:])
        self.before[STEP + inside] = self.block[inside]
        self.is_string = row + SPAN <= self.end

    def _hashes(self, n: int, salt: int) -> np.ndarray:
        """A hash of the STEP bytes from each row on: of eight bytes, doubled while they fit, the last piece overlapping."""
        factors = W.spread(64, salt) | np.uint64(1)
        value, width, k = W.mixed(self.words + np.uint64(salt)), 8, 0
        while 2 * width <= STEP:
            value = value[:-width] * factors[k] + value[width:] * factors[k + 1]
            width, k = 2 * width, k + 2
        if width < STEP:
            value = W.mixed(value)
            value = value[: width - STEP] * factors[k] + value[STEP - width :] * factors[k + 1]
        return W.mixed(value[:n])


def shard_order(runs: Runs, lo: int, hi: int) -> np.ndarray:
    """The rows lo to hi (whole strings) in the order of their blocks, SPAN bytes deep; rows without a block come first."""
    block = runs.block[lo:hi]
    end = runs.end[lo:hi] - lo
    row = np.arange(hi - lo)

    def joined(rank: np.ndarray, then: np.ndarray, blocks: int) -> np.ndarray:
        key = rank * (int(then.max(initial=0)) + 1) + then[np.minimum(row + blocks * STEP, end)]
        key[block == 0] = 0
        return key

    key, depth, ranks = block, 1, {1: block}
    while depth < SPAN // STEP:
        more = max(d for d in ranks if d + depth <= SPAN // STEP)
        rank = ranks.get(depth)
        if rank is None:
            rank = ranks[depth] = ranked(key)
        key = joined(rank, ranks[more], depth)
        depth += more
    return lo + stable_order(key)


def merged_intervals(runs: Runs, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, common): all rows in merged order, and the bytes (up to SPAN, in blocks) each shares with the row before."""
    strings = len(runs.length)
    cuts = np.unique(np.linspace(0, strings, min(shards, strings) + 1).astype(np.int64))
    bounds = [*runs.first[cuts[:-1]].tolist(), len(runs.block)]
    orders = [shard_order(runs, lo, hi) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    # the transform: the block before each row, -1 at the head of a string
    before = runs.before[np.concatenate(orders)] if orders else np.empty(0, np.int64)
    heads, n = int((before < 0).sum()), len(before)
    ends = [int((runs.block[o] == 0).sum()) for o in orders]
    head = np.repeat(np.arange(len(orders), dtype=np.int16), ends)
    shard = np.repeat(np.arange(len(orders), dtype=np.int16), [len(o) for o in orders])
    group = np.zeros(n, np.int32)
    common = np.zeros(n, np.int64)
    for _ in range(SPAN // STEP):
        seen = np.empty(n, np.int64)
        seen[np.argsort(shard, kind="stable")] = before
        dealt = stable_order(seen + 1)[heads:]
        blocks, source = seen[dealt], group[dealt]
        new = np.ones(n, bool)
        new[1 : len(head)] = False
        new[len(head) + 1 :] = (blocks[1:] != blocks[:-1]) | (source[1:] != source[:-1])
        shard = np.concatenate([head, shard[dealt]])
        group = np.cumsum(new, dtype=np.int32)
        common += ~new
    common *= STEP
    rows = np.empty(n, np.int64)
    rows[np.argsort(shard, kind="stable")] = np.concatenate(orders) if orders else rows
    # ends are alike to the rounds, but no bytes
    shared = np.flatnonzero(common)
    at = rows[shared]
    common[shared] = np.minimum(common[shared], (runs.end[at] - at) // STEP * STEP)
    return rows, common


def repeated_rows(strings: list[bytes], times: np.ndarray, shards: int = SHARDS) -> tuple[Runs, np.ndarray]:
    """Whether the SPAN bytes from each row on stand in more than one place; times[i] counts the places of string i. Blocks
    are named by hash: neighbours are compared by their bytes, and should two blocks share a name others are tried."""
    for salt in range(1, 100):
        runs = Runs(strings, salt)
        rows, common = merged_intervals(runs, shards)
        same = (common >= SPAN) & runs.is_string[rows]
        a, b = rows[np.flatnonzero(same) - 1], rows[same]
        if all((runs.words[a + i] == runs.words[b + i]).all() for i in range(0, SPAN, 8)):
            break
    interval = np.cumsum(~same) - 1
    places = np.bincount(interval, weights=times[runs.string[rows]])
    found = np.zeros(len(rows), bool)
    found[rows] = (places[interval] > 1) & runs.is_string[rows]
    return runs, found


def _covered(place: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, end) of the maximal stretches covered by strings that start at the places, which rise per owner."""
    if not len(place):
        return owner, place, place
    new = np.ones(len(place), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] > place[:-1] + SPAN)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(place)) - 1
    return owner[heads], place[heads], place[tails] + SPAN


COVER = "key long, run long, starts array<long>, ends array<long>, bytes binary, times long"
_COVER = pa.schema([("key", pa.int64()), ("run", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("bytes", pa.binary()), ("times", pa.int64())])


def _merge_group(held: dict[tuple[int, int], list]) -> pa.RecordBatch:
    """The covers of the runs of some anchors."""
    names = list(held)
    runs, found = repeated_rows([held[k][0] for k in names], np.array([held[k][1] for k in names]))
    rows = np.flatnonzero(found)
    owner, start, end = _covered(rows - runs.first[runs.string[rows]], runs.string[rows])
    edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, np.int64)
    own, split = [names[i] for i in owner[edges].tolist()], pa.array(np.append(edges, len(owner)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in own], pa.int64()), pa.array([r for _, r in own], pa.int64()), pa.ListArray.from_arrays(split, pa.array(start)),
         pa.ListArray.from_arrays(split, pa.array(end)), pa.nulls(len(own), pa.binary()), pa.nulls(len(own), pa.int64())], schema=_COVER,
    )


def _merge_sorted(group_bytes: int, hot_bytes: int):
    """Covers of runs that come in the order of key and run. Whole anchors are gathered up to `group_bytes`; the runs of an
    anchor that passes `hot_bytes` are given back as they are, the first ones when that is seen and the others at once."""

    def back(held: dict) -> pa.RecordBatch:
        n = len(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in held], pa.int64()), pa.array([r for _, r in held], pa.int64()), pa.nulls(n, pa.list_(pa.int64())),
             pa.nulls(n, pa.list_(pa.int64())), pa.array([v[0] for v in held.values()], pa.binary()), pa.array([v[1] for v in held.values()], pa.int64())], schema=_COVER,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[tuple[int, int], list] = {}  # runs of anchors that have ended
        own: dict[tuple[int, int], list] = {}  # of the anchor being read
        size, own_size, key, hot = 0, 0, None, False
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "run", "bytes", "times")]
            for k, r, text, times in zip(*columns, strict=True):
                if k != key:
                    if hot and own:
                        yield back(own)
                    elif len(own) > 1 or any(v[1] > 1 for v in own.values()):
                        whole.update(own)
                        size += own_size
                    if size >= group_bytes:
                        yield _merge_group(whole)
                        whole, size = {}, 0
                    own, own_size, key, hot = {}, 0, k, False
                if (k, r) in own:
                    own[k, r][1] += times
                    continue
                if hot and len(own) >= 1000:  # sorted: the earlier runs are complete
                    yield back(own)
                    own = {}
                own[k, r] = [text, times]
                own_size += len(text)
                hot = hot or own_size > hot_bytes
        if hot and own:
            yield back(own)
        else:
            whole.update(own)
        if whole:
            yield _merge_group(whole)
        W.trim()

    return run


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string of each run: two hashes, and where it is."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            runs = part.column("bytes").to_pylist()
            hashes, owner, place = [], [], []
            for j, run in enumerate(runs):
                for p in range(len(run) - SPAN + 1):
                    hashes.append(xxhash.xxh3_128_intdigest(run[p : p + SPAN]))
                    owner.append(j)
                    place.append(p)
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([(h >> 64) - (1 << 63) for h in hashes], pa.int64()), pa.array([(h & ((1 << 64) - 1)) - (1 << 63) for h in hashes], pa.int64()),
                 part.column("key").take(take), part.column("run").take(take), part.column("times").take(take), pa.array(place, pa.int64())],
                ["h1", "h2", "key", "run", "times", "place"],
            )


def _hot_covers(runs: DataFrame) -> DataFrame:
    """The covers of runs whose anchor has too many of them for one task."""
    strings = written(runs.mapInArrow(_strings, "h1 long, h2 long, key long, run long, times long, place long"), "strings")
    often = strings.groupBy("h1", "h2").agg(F.sum("times").alias("places")).filter("places > 1").select("h1", "h2")
    found = strings.join(often, ["h1", "h2"]).groupBy("key", "run").agg(F.sort_array(F.collect_list("place")).alias("starts"))
    return found.select("key", "run", "starts", F.transform("starts", lambda p: p + SPAN).alias("ends"))


# ---- the operator --------------------------------------------------------------------------------------------------

KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, starts array<long>, ends array<long>, kept binary"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
        rows = {"n_bytes": [], "n_removed": [], "starts": [], "ends": [], "kept": []}
        for zipped, copies, spans in zip(batch.column("text"), batch.column("copies").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            text = zstandard.decompress(zipped.as_py())
            rows["n_bytes"].append(len(text))
            starts, ends = [], []
            if (copies or 0) > 1 and len(text) >= SPAN:
                spans = [{"start": 0, "end": len(text)}]
            for s in sorted((x["start"], x["end"]) for x in spans or ()):
                if starts and s[0] <= ends[-1]:
                    ends[-1] = max(ends[-1], s[1])
                else:
                    starts.append(s[0])
                    ends.append(s[1])
            edges = [0, *(x for pair in zip(starts, ends, strict=True) for x in pair), len(text)]
            rows["kept"].append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            rows["n_removed"].append(sum(ends) - sum(starts))
            rows["starts"].append(starts)
            rows["ends"].append(ends)
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(rows["n_bytes"], pa.int64()), pa.array(rows["n_removed"], pa.int64()),
             pa.array([len(s) for s in rows["starts"]], pa.int64()), pa.array(rows["starts"], longs), pa.array(rows["ends"], longs), pa.array(rows["kept"], pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "starts", "ends", "kept"],
        )


def without_shared_spans(docs: DataFrame, text: str = "text", row: str = "doc_id", group_bytes: int = GROUP_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, starts, ends, kept) of every row: the maximal runs of bytes removed and the
    bytes that stay. A byte goes if a string of SPAN bytes over it starts at another place too, in any text; places are
    judged on the input. Repeated rows are copies of each other; NULL is the empty text; bytes that stay may split a
    character, so they are binary."""
    with small_batches(docs.sparkSession):
        return _without_shared_spans(docs, text, row, group_bytes, hot_bytes)


def _without_shared_spans(docs: DataFrame, text: str, row: str, group_bytes: int, hot_bytes: int) -> DataFrame:
    docs = docs.select(F.col(row).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("id", F.coalesce("doc_id", F.lit(-1).cast("bigint"))).withColumn("rid", F.xxhash64("text")).withColumn("crc", F.crc32(F.col("text").cast("binary")))
    zipped = docs.mapInArrow(_zipped, "doc_id long, id long, rid long, crc long, text binary")
    found = written(docs.drop("doc_id").mapInArrow(_anchored, "id long, rid long, crc long, runs array<struct<key:long,at:long>>"), "anchors")
    # texts are compared once, and by the row with the smallest id; those with copies go as a whole
    once = found.groupBy("rid", "crc").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    places = found.join(once, ["rid", "crc", "id"]).select("id", "rid", "crc", F.explode("runs").alias("r")).select("id", "rid", "crc", "r.key", "r.at").distinct()
    often = places.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    picked = places.join(often, "key").groupBy("id", "rid", "crc").agg(F.collect_list(F.struct("key", "at")).alias("picks"))
    # both sides grow with the input: merged, never broadcast
    cut = zipped.join(picked.hint("merge"), ["id", "rid", "crc"]).select("rid", "crc", "text", "picks")
    cut = written(cut.mapInArrow(_cut, "key long, run long, bytes binary, times long, rid long, crc long, start long"), "runs")
    runs = cut.filter("bytes IS NOT NULL").select("key", "run", "bytes", "times")
    size = total(runs, F.sum(F.octet_length("bytes")).alias("n"))["n"] or 0
    merged = runs.repartition(max(1, math.ceil(size / (4 * group_bytes))), "key").sortWithinPartitions("key", "run")
    merged = written(merged.mapInArrow(_merge_sorted(group_bytes, hot_bytes), COVER), "covers")
    covers = merged.filter("bytes IS NULL").select("key", "run", "starts", "ends")
    covers = covers.unionByName(_hot_covers(merged.filter("bytes IS NOT NULL").select("key", "run", "bytes", "times")))
    spans = (
        cut.filter("bytes IS NULL").select("key", "run", "rid", "crc", "start").join(covers, ["key", "run"])
        .select("rid", "crc", "start", F.explode(F.arrays_zip("starts", "ends")).alias("s"))
        .groupBy("rid", "crc").agg(F.collect_set(F.struct((F.col("start") + F.col("s.starts")).alias("start"), (F.col("start") + F.col("s.ends")).alias("end"))).alias("spans"))
    )
    spans = once.select("rid", "crc", "copies").join(spans, ["rid", "crc"], "left").filter("copies > 1 OR spans IS NOT NULL")
    return zipped.join(spans.hint("merge"), ["rid", "crc"], "left").select("doc_id", "text", "copies", "spans").mapInArrow(_kept, KEPT)


# Texts as hexadecimal digits; places of repeated strings, joined to spans; the pieces between spans
SPANS_SQL = f"""
hx AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
st AS (SELECT r, p, md5(substr(h, 2 * p + 1, {2 * SPAN})) AS k FROM (SELECT r, h, unnest(range(len(h) // 2 - {SPAN - 1})) AS p FROM hx WHERE len(h) >= {2 * SPAN})),
rp AS (SELECT r, p FROM st QUALIFY count(*) OVER (PARTITION BY k) > 1),
sp AS (SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + {SPAN}, true) AS opens FROM rp),
gr AS (SELECT r, p, sum(CAST(opens AS INT)) OVER (PARTITION BY r ORDER BY p) AS g FROM sp),
cv AS (SELECT r, g, min(p) AS a, max(p) + {SPAN} AS b FROM gr GROUP BY r, g),
pc AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM cv GROUP BY r),
kp AS (SELECT r, string_agg(substr(h, 2 * coalesce(ends[i - 1], 0) + 1, 2 * (coalesce(starts[i], len(h) // 2) - coalesce(ends[i - 1], 0))), '' ORDER BY i) AS kept
       FROM (SELECT r, h, starts, ends, unnest(range(1, n_spans + 2)) AS i FROM pc JOIN hx USING (r)) GROUP BY r)
"""


@query("op10_shared_spans", "WITH " + SPANS_SQL + """
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM hx LEFT JOIN pc USING (r) LEFT JOIN kp USING (r)""")
def op10_shared_spans(spark, sf_dir):
    rows = without_shared_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
