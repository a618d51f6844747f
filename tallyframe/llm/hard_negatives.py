"""Hard negatives: for an anchor and each of its positives, the best rows of other labels whose score is in a window.

Rows are ordered by label and place on a Hilbert curve, so that rows near each other in the widest dimensions stand together,
and cut into Parquet blocks. A block's zone map has the least and greatest value of every dimension. An anchor's inner product
with any row of a block lies between two sums, taken per dimension from the end of the zone that makes it least and greatest;
a block is read for an anchor only if that interval meets one of the anchor's windows. Anchors are packed in blocks too, so
what meets are blocks, never rows, and every task has a bounded number of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import total, written
from tallyframe.llm.interpolation import packed, unpacked
from tallyframe.llm.registry import query

BLOCK = 1024  # rows of a block, of candidates and of anchors
ZONES = 1024  # zone maps looked through together
READ = 64  # blocks read by one task for a block of anchors
CURVE, BITS = 8, 7  # dimensions of the curve, and bits of each
LARGEST = 1 << 26  # components of this size or more cannot be multiplied exactly: their rows take no part
_NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Mining:
    """Positives of an anchor, negatives of a positive, and the window of negative scores in percent of the positive's."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


# ---- the curve -----------------------------------------------------------------------------------------------------


def hilbert(places: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of points with `bits` bits in each of their few dimensions.

    Bit by bit from the top, the lower bits are turned as the sub-cube that a bit chooses is turned; the turned coordinates
    are then read bit by bit across the dimensions and their Gray code is undone.
    """
    x = places.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & (1 << b)) != 0, (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a matrix; what a shorter one lacks is 0."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _moments(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), width).astype(np.float64)
            if len(x):
                each = [x.sum(0), (x * x).sum(0), x.min(0), x.max(0)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, len(x))), *map(pa.array, each)], ["dim", "n", "s", "q", "lo", "hi"])

    return run


def _placed(width: int, dims: list[int], lo: np.ndarray, hi: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), width)[:, dims]
            cells = np.minimum(((x - lo) * (1 << BITS)) // np.maximum(hi - lo + 1, 1), (1 << BITS) - 1)
            curve = hilbert(cells, BITS) if dims else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(curve)], [*batch.schema.names, "curve"])

    return run


# ---- blocks --------------------------------------------------------------------------------------------------------

POINTS = "row long, id long, label long, anchor boolean, vector array<long>"
PACK = "block long, n long, label_lo long, label_hi long, rows binary, ids binary, known binary, labels binary, vectors binary, least binary, most binary, los binary, his binary"
_PACK = [c.split(" ")[0] for c in PACK.split(", ")]


def _pack(width: int, windows: bool):
    """Rows in blocks, in the order they come; within a block by id, rows without one last."""

    def block(number: int, t: pa.Table) -> list:
        column = lambda c: t.column(c).combine_chunks()
        known = np.asarray(column("id").is_valid())
        ids = column("id").fill_null(0).to_numpy()
        order = np.lexsort((column("row").to_numpy(), ids, ~known))
        x = _matrix(column("vector"), width)[order]
        labels = column("label").to_numpy()[order]
        sides = [_matrix(column(c), t.column("los").combine_chunks().flatten().__len__() // len(t))[order] for c in ("los", "his")] if windows else [np.empty(0, np.int64)] * 2
        return [
            number, len(x), int(labels.min()), int(labels.max()), packed(column("row").to_numpy()[order]), packed(ids[order]), packed(known[order].astype(np.uint8)),
            packed(labels), packed(x.ravel().astype(np.int32)), packed(x.min(0)), packed(x.max(0)), *[packed(s.ravel()) for s in sides],
        ]

    def batch(rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.binary()] * 9
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _PACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = done = 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, BLOCK - size)
                held.append(part)
                size, at = size + part.num_rows, at + part.num_rows
                if size == BLOCK:
                    yield batch([block(first + done, pa.Table.from_batches(held))])
                    held, size, done = [], 0, done + 1
        if held:
            yield batch([block(first + done, pa.Table.from_batches(held))])

    return run


def _packed(rows: DataFrame, n: int, width: int, name: str, windows: bool = False) -> DataFrame:
    """Blocks of the rows, written. Rows of one place on the curve are ranged by their number, so copies do not pile up."""
    rows = rows.select("row", "id", "label", "vector", "label_", "curve", *(["los", "his"] if windows else []))
    parts = max(1, math.ceil(n / (16 * BLOCK)))
    ranged = rows.repartitionByRange(parts, "label_", "curve", "row").sortWithinPartitions("label_", "curve", "row")
    return written(ranged.mapInArrow(_pack(width, windows), PACK), name)


class Block:
    """A block unpacked."""

    def __init__(self, row: dict, width: int):
        self.rows, self.ids, self.labels = (unpacked(row[c], np.int64) for c in ("rows", "ids", "labels"))
        self.known = unpacked(row["known"], np.uint8).astype(bool)
        self.vectors = unpacked(row["vectors"], np.int32).reshape(-1, width).astype(np.int64)
        self.least, self.most = unpacked(row["least"], np.int64), unpacked(row["most"], np.int64)
        self.lo, self.hi = (unpacked(row[c], np.int64) for c in ("los", "his"))
        if len(self.lo):
            self.lo, self.hi = (x.reshape(len(self.rows), -1) for x in (self.lo, self.hi))
        else:  # any score
            self.lo, self.hi = np.full((len(self.rows), 1), _NONE + 1), np.full((len(self.rows), 1), np.iinfo(np.int64).max)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact product of two integer matrices; in floating point where all sums are exact there."""
    size = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if size < 2.0**52 else a @ b


def bounds(x: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) of the inner products of the rows of `x` with any vector of the zones, a zone a row of the others."""
    up, down = np.maximum(x, 0), np.minimum(x, 0)
    return product(up, least.T) + product(down, most.T), product(up, most.T) + product(down, least.T)


def needed(a: Block, same: bool, least: np.ndarray, most: np.ndarray, label_lo: np.ndarray, label_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors x zones: whether the anchor has to read the block, upper bounds)."""
    low, high = bounds(a.vectors, least, most)
    meets = np.zeros(low.shape, bool)
    for s in range(a.lo.shape[1]):
        lo, hi = a.lo[:, s, None], a.hi[:, s, None]
        meets |= (high >= lo) & (low <= hi) & (lo <= hi)
    own = a.labels[:, None]
    return meets & ((label_lo <= own) & (own <= label_hi) if same else (label_lo != own) | (label_hi != own)), high


def _choose(width: int, same: bool):
    """Which blocks a block of anchors has to read, with the upper bound of its scores there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, zones = Block(row["a"], width), row["zones"]
                least, most = (np.stack([unpacked(z[c], np.int64) for z in zones]) for c in ("least", "most"))
                lo, hi = (np.array([z[c] for z in zones]) for c in ("label_lo", "label_hi"))
                need, high = needed(a, same, least, most, lo, hi)
                some = np.flatnonzero(need.any(axis=0))
                best = np.where(need, high, _NONE).max(axis=0)[some]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row["a"]["block"])), pa.array([zones[i]["block"] for i in some], pa.int64()), pa.array(best)], ["anchors", "block", "bound"])

    return run


TOP = "row long, slot int, best array<struct<down:long,unknown:boolean,id:long>>"
_TOP = pa.struct([("down", pa.int64()), ("unknown", pa.bool_()), ("id", pa.int64())])


def best_in(a: Block, blocks: Iterator[Block], same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, unknown, ids), each anchors x windows x k: the best rows of the blocks in each window, ties by id and rows
    without an id last among them. Blocks come by falling bounds and are left out where an anchor's windows are full of better."""
    shape = (*a.lo.shape, k)
    scores, unknown, ids = np.full(shape, _NONE), np.ones(shape, bool), np.zeros(shape, np.int64)
    for b in blocks:
        need, high = needed(a, same, b.least[None], b.most[None], b.labels.min(keepdims=True), b.labels.max(keepdims=True))
        at = np.flatnonzero(need[:, 0] & (high >= scores[:, :, -1]).any(axis=1))
        if not len(at):
            continue
        found = product(a.vectors[at], b.vectors.T)
        wrong = (a.labels[at, None] == b.labels) != same
        found[wrong | (a.rows[at, None] == b.rows)] = _NONE
        order = np.argsort(-found.clip(min=_NONE + 1), axis=1, kind="stable")
        found = np.take_along_axis(found, order, axis=1)
        for s in range(a.lo.shape[1]):
            lo, hi = a.lo[at, s, None], a.hi[at, s, None]
            places = (found > hi).sum(axis=1, keepdims=True) + np.arange(k)
            inside = places < found.shape[1]
            places = np.minimum(places, found.shape[1] - 1)
            new = np.take_along_axis(found, places, axis=1)
            new = np.where(inside & (new >= lo) & (new != _NONE), new, _NONE)
            col = np.take_along_axis(order, places, axis=1)
            every = [np.concatenate(x, axis=1) for x in ((scores[at, s], new), (unknown[at, s], ~b.known[col]), (ids[at, s], b.ids[col]))]
            keep = np.lexsort((every[2], every[1], -every[0].clip(min=_NONE + 1)), axis=1)[:, :k]
            scores[at, s], unknown[at, s], ids[at, s] = (np.take_along_axis(x, keep, axis=1) for x in every)
    return scores, unknown, ids


def _read(width: int, same: bool, k: int):
    def run(anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.list_(_TOP))], ["row", "slot", "best"])
        if not anchors.num_rows or not blocks.num_rows:
            return empty
        a = Block(anchors.slice(0, 1).to_pylist()[0], width)
        blocks = blocks.sort_by([("bound", "descending"), ("block", "ascending")])
        each = (Block(blocks.slice(i, 1).to_pylist()[0], width) for i in range(blocks.num_rows))
        scores, unknown, ids = best_in(a, each, same, k)
        there = scores != _NONE
        n = there.sum(axis=2).ravel()
        rows = np.repeat(a.rows, scores.shape[1])
        slots = np.tile(np.arange(scores.shape[1], dtype=np.int32), len(a.rows))
        values = pa.StructArray.from_arrays([pa.array(-scores[there]), pa.array(unknown[there]), pa.array(ids[there])], fields=list(_TOP))
        best = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), values)
        return pa.table([pa.array(rows), pa.array(slots), best], ["row", "slot", "best"]).filter(pa.array(n > 0))

    return run


def _searched(anchors: DataFrame, blocks: DataFrame, groups: int, width: int, same: bool, k: int) -> DataFrame:
    """(row, slot, best) of each anchor and window: the k best rows of the blocks."""
    zone = F.pmod(F.xxhash64("block"), F.lit(groups))
    zones = blocks.groupBy(zone.alias("zone")).agg(F.collect_list(F.struct("block", "label_lo", "label_hi", "least", "most")).alias("zones"))
    asked = anchors.select(F.struct("*").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("zone"))
    chosen = asked.join(zones, "zone").select("a", "zones").mapInArrow(_choose(width, same), "anchors long, block long, bound long")
    chosen = written(chosen, "chosen")
    parts = chosen.groupBy("anchors").agg(F.ceil(F.count(F.lit(1)) / READ).cast("long").alias("parts"))
    to_read = chosen.join(parts, "anchors").withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts"))).join(blocks, "block")
    each = parts.select(F.col("anchors").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("share"))
    who = anchors.join(each, "block")
    found = who.groupBy("block", "share").cogroup(to_read.groupBy("anchors", "part")).applyInArrow(_read(width, same, k), TOP)
    # a list of k at most from each part
    return found.groupBy("row", "slot").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


def hard_negatives(vectors: DataFrame, anchor: Column, mining: Mining = Mining(), row: str = "vec_id", label: str = "label", vector: str = "vector") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), scores being inner products of vectors of
    whole numbers. `anchor` tells which rows are anchors.

    Rows without a label or a vector, or with a component that is missing or of LARGEST size, take no part. Shorter vectors go
    on with zeros. Repeated rows are rows of their own: a copy of an anchor is an anchor, and may be its positive. A row without
    an id takes part and is last among equal scores. An anchor without positives, or a positive without negatives, has no row.
    """
    spark = vectors.sparkSession
    usable = F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False)))
    points = vectors.filter(usable).select(
        F.col(row).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.col(vector).cast("array<long>").alias("vector"),
    )
    points = written(points.withColumn("row", F.monotonically_increasing_id()), "points")
    n, anchors, width = total(points, F.count(F.lit(1)), F.count_if("anchor"), F.max(F.size("vector")))
    width = max(1, width or 0)
    moments = points.select("vector").mapInArrow(_moments(width), "dim long, n long, s double, q double, lo double, hi double")
    moments = moments.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("dim").collect()
    widest = sorted(moments, key=lambda m: ((m["s"] / m["n"]) ** 2 - m["q"] / m["n"], m["dim"]))[:CURVE]
    lo, hi = (np.array([int(m[c]) for m in widest], np.int64) for c in ("lo", "hi"))
    placed = points.select("row", "id", "label", "anchor", "vector").mapInArrow(_placed(width, [m["dim"] for m in widest], lo, hi), POINTS + ", curve long")
    placed = written(placed.withColumn("label_", F.col("label")), "curve")
    blocks = _packed(placed, n, width, "blocks")
    groups = max(1, math.ceil(n / (BLOCK * ZONES)))
    own = placed.filter("anchor")

    best = _searched(_packed(own, anchors, width, "anchors"), blocks, groups, width, True, mining.positives)
    # windows that no score meets fill the places of missing positives
    def hundredth(x: str) -> str:
        return f"(({x}) - pmod({x}, 100L)) div 100L"

    at = f"transform(sequence(0, {mining.positives - 1}), i -> coalesce({{}}, {{}}))"
    los = F.expr(at.format("-(" + hundredth(f"{mining.low}L * get(best, i).down") + ")", "1L"))
    his = F.expr(at.format(hundredth(f"-{mining.high}L * get(best, i).down"), "0L"))
    best = written(best.select("row", F.col("best").alias("positives"), los.alias("los"), his.alias("his")), "positives")
    windows = _packed(own.join(best.select("row", "los", "his"), "row"), anchors, width, "windows", True)
    found = _searched(windows, blocks, groups, width, False, mining.negatives)
    rows = found.join(best.select("row", "positives"), "row").join(own.select("row", F.col("id").alias("anchor_id")), "row")
    rows = rows.withColumn("p", F.get("positives", F.col("slot"))).select("anchor_id", "p", F.posexplode("best").alias("i", "b"))
    known = lambda c: F.when(~F.col(f"{c}.unknown"), F.col(f"{c}.id"))
    return rows.select(
        "anchor_id", known("p").alias("positive_id"), (F.col("i") + 1).cast("int").alias("rank"), known("b").alias("negative_id"),
        (-F.col("p.down")).alias("positive_score"), (-F.col("b.down")).alias("negative_score"),
    )


SQL = f"""
WITH whole AS MATERIALIZED (SELECT vec_id, label, embedding FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR abs(x) >= {LARGEST / 256})) = 0),
v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM whole),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id,
  CAST(coalesce(list_sum(list_transform(list_zip(a.e, v.e), lambda x: x[1] * x[2])), 0) AS BIGINT) AS score
  FROM v AS a, v WHERE a.vec_id % 100 = 0 AND a.r <> v.r),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY rank <= 10
"""


@query("op12_hard_negatives", SQL)
def op12_hard_negatives(spark, sf_dir):
    """Every hundredth vector against all; every seventh has the next label."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # a component that is not finite becomes NULL, which keeps its row out
    whole = F.transform("embedding", lambda x: F.when(~F.isnan(x) & (F.abs(x) < LARGEST / 256), F.floor(x.cast("double") * 256).cast("long")))
    made = rows.select("vec_id", label.alias("label"), whole.alias("vector"))
    return hard_negatives(made, F.col("vec_id") % 100 == 0)
