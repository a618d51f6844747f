"""Language-model scores by deleted interpolation: word-pair and word frequencies mixed by the frequency of the context.

P(w | v) = a * c(v, w) / c(v) + b * c(w) / N + c / (V + 1), where (a, b, c) belong to the bucket of c(v). The weights of a
bucket are learned by expectation-maximisation on the counts of documents that were left out of the frequencies; then the
frequencies of all training documents are used.

Counts are kept by number, never by word: documents are packed into chunks (a vocabulary of word hashes and the places in
it), each chunk sends its distinct words and word pairs once with their counts, sorted and packed by range of hashes, a
range is summed by one task, and each chunk gets the sums of its own entries back. A frequent word is one entry per chunk.
Nothing of the corpus goes through the driver but totals and a table of binned frequencies of fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import words as W
from tallyframe.llm.common import written
from tallyframe.llm.registry import query

FOLDS = 10  # documents of fold 0 are held out altogether, those of fold 1 serve to learn the weights
ADD = 0.1
CHUNK_TOKENS = 1 << 20
RANGE_ENTRIES = 1 << 20  # entries that one task sums, about
BINS = 8  # of a frequency per factor of two, in the table that the weights are learned from
ROUNDS = 40
NO_ID = -(1 << 63)  # stands for a NULL id

END = np.uint64(0xE4D)  # the token after each text's last word
BEGIN = np.uint64(0xBE61)  # the context of its first


def packed(values: np.ndarray) -> bytes:
    """An array as compressed bytes, byte by byte of its numbers."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T if len(values) else values.view(np.uint8)
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).reshape(-1) if len(raw) else np.empty(0, kind)


# ---- chunks --------------------------------------------------------------------------------------------------------

CHUNK = "chunk string, learns boolean, tokens long, ids binary, folds binary, lengths binary, vocabulary binary, places binary"


def _chunk(parts: list[tuple], learns: bool) -> pa.RecordBatch:
    ids, folds, lengths, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    vocabulary, places = np.unique(hashes, return_inverse=True)
    # the name is the content's: a task that runs again gives the same chunks
    name = f"{int(W.mixed(hashes).sum(dtype=np.uint64)):x}-{int(W.mixed(ids.view(np.uint64)).sum(dtype=np.uint64)):x}-{int(ids[0])}-{len(ids)}"
    values = [[name], [learns], [len(hashes)], *[[packed(x)] for x in (ids, folds, lengths, vocabulary, places.astype(np.uint32))]]
    kinds = [pa.string(), pa.bool_(), pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], CHUNK_NAMES)


CHUNK_NAMES = [c.split(" ")[0] for c in CHUNK.split(", ")]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bool, list] = {False: [], True: []}
    size = {False: 0, True: 0}
    for batch in W.chunks(batches, "text"):
        w = W.words(batch.column("text"), W.BLANK_SEPARATED)
        counts = np.diff(w.first)
        hashes = np.insert(w.hash, w.first[1:], END)
        lengths = (counts + 1).astype(np.int64)
        first = np.cumsum(lengths) - lengths
        ids, folds = batch.column("at").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)
        for learns in (False, True):
            own = np.flatnonzero((folds == 1) == learns)
            if not len(own):
                continue
            rows = np.repeat(first[own] - np.cumsum(lengths[own]) + lengths[own], lengths[own]) + np.arange(int(lengths[own].sum()))
            held[learns].append((ids[own].astype(np.int64), folds[own].astype(np.int8), lengths[own], hashes[rows]))
            size[learns] += len(rows)
            if size[learns] >= CHUNK_TOKENS:
                yield _chunk(held[learns], learns)
                held[learns], size[learns] = [], 0
    for learns in (False, True):
        if held[learns]:
            yield _chunk(held[learns], learns)


class Chunk:
    """A chunk unpacked: the fold of each token, the tokens' places in the sorted vocabulary, and those of their pairs (a
    token with its context) among the sorted distinct pairs."""

    def __init__(self, row: pd.Series):
        self.ids, self.lengths = unpacked(row["ids"], np.int64), unpacked(row["lengths"], np.int64)
        self.folds = np.repeat(unpacked(row["folds"], np.int8), self.lengths)
        self.vocabulary = unpacked(row["vocabulary"], np.uint64)
        self.places = unpacked(row["places"], np.uint32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.ids)), self.lengths)
        self.opens = np.cumsum(self.lengths) - self.lengths
        own = self.vocabulary[self.places]
        context = np.empty_like(own)
        context[1:] = own[:-1]
        context[self.opens] = BEGIN
        self.pair_hash = W.mixed(W.mixed(context) * np.uint64(5) + own)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.pair_hash, return_inverse=True)


def _counts(entries: int, places: np.ndarray, folds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each entry occurs in the documents of the frequencies, and in those of the weights."""
    return np.bincount(places[folds > 1], minlength=entries), np.bincount(places[folds == 1], minlength=entries)


# ---- sums by range -------------------------------------------------------------------------------------------------

SENT = "part int, chunk string, steps binary, base binary, learn binary"


def _send(pairs: bool, parts: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                chunk = Chunk(row)
                names, places = chunk.pairs() if pairs else (chunk.vocabulary, chunk.places)
                base, learn = _counts(len(names), places, chunk.folds)
                edges = _edges(names, parts)
                rows = [
                    (r, row["chunk"], packed(np.diff(names[own], prepend=np.uint64(0))), packed(base[own].astype(np.uint32)), packed(learn[own].astype(np.uint32)))
                    for r in range(parts) if edges[r] < edges[r + 1] for own in [slice(edges[r], edges[r + 1])]
                ]
                yield pd.DataFrame(rows, columns=["part", "chunk", "steps", "base", "learn"])

    return run


def _edges(names: np.ndarray, parts: int) -> np.ndarray:
    """Where each range of hashes begins among the sorted names, and the end."""
    bounds = np.array([(r << 64) // parts for r in range(1, parts)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(names, bounds), [len(names)]])


TOLD = "chunk string, part int, pairs boolean, base binary, learn binary, sum_base long, sum_train long, n_base long, n_train long"


def _sum(pairs: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        names = [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in group["steps"]]
        base = np.concatenate([unpacked(x, np.uint32) for x in group["base"]]).astype(np.int64)
        learn = np.concatenate([unpacked(x, np.uint32) for x in group["learn"]]).astype(np.int64)
        all_, inverse = np.unique(np.concatenate(names), return_inverse=True)
        base = np.bincount(inverse, weights=base, minlength=len(all_)).astype(np.int64)
        learn = np.bincount(inverse, weights=learn, minlength=len(all_)).astype(np.int64)
        stats = (int(base.sum()), int((base + learn).sum()), int((base > 0).sum()), int((base + learn > 0).sum()))
        part, rows, at = int(group["part"].iloc[0]), [], 0
        for chunk, own in zip(group["chunk"], names, strict=True):
            mine = inverse[at : at + len(own)]
            at += len(own)
            rows.append((chunk, part, pairs, packed(base[mine]), packed(learn[mine]), *(stats if not rows else (0, 0, 0, 0))))
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in TOLD.split(", ")])

    return run


def _summed(chunks: DataFrame, pairs: bool, parts: int) -> DataFrame:
    sent = chunks.mapInPandas(_send(pairs, parts), SENT)
    return sent.groupBy("part").applyInPandas(_sum(pairs), TOLD)


# ---- weights -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Totals:
    base_tokens: int
    base_types: int
    train_tokens: int
    train_types: int


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1, 2, 3, ... for 1, 2-3, 4-7, ... times."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def learned(table: pd.DataFrame, uniform: float) -> np.ndarray:
    """Weights (pair, word, uniform) by bucket, from rows (bucket, pair, word, n) of frequencies in bins of a factor of
    2^(1/BINS); NULL bins are 0. One is added to each weight's expectation, so none vanishes and a bucket without rows has
    equal weights. The bucket of unseen contexts has no weight for pairs."""
    top = int(table["bucket"].max()) + 1 if len(table) else 1
    weights = np.full((max(top, 64), 3), 1 / 3)
    b, n = table["bucket"].to_numpy(np.int64), table["n"].to_numpy(np.float64)
    p = np.stack([
        np.where(table["pair"].isna(), 0.0, 2.0 ** (table["pair"].fillna(0).to_numpy(np.float64) / BINS)),
        np.where(table["word"].isna(), 0.0, 2.0 ** (table["word"].fillna(0).to_numpy(np.float64) / BINS)),
        np.full(len(table), uniform),
    ], axis=1)
    for _ in range(ROUNDS if len(table) else 0):
        part = weights[b] * p
        part *= (n / part.sum(axis=1))[:, None]
        sums = np.ones_like(weights)
        np.add.at(sums, b, part)
        weights = sums / sums.sum(axis=1, keepdims=True)
    weights[0, 0] = 0
    weights[0] /= weights[0].sum()
    return weights


class Told:
    """The sums told to a chunk: of its words and, in the same order as its pairs, of its pairs."""

    def __init__(self, replies: pd.DataFrame):
        # chunks of one content have one name and are told the same
        ordered = replies.drop_duplicates(["pairs", "part"]).sort_values("part")
        words, pairs = ordered[~ordered["pairs"]], ordered[ordered["pairs"]]
        join = lambda rows, c: np.concatenate([unpacked(x, np.int64) for x in rows[c]])
        self.word = join(words, "base"), join(words, "learn")
        self.pair = join(pairs, "base"), join(pairs, "learn")


def _contexts(chunk: Chunk, word: np.ndarray) -> np.ndarray:
    """How often each token's context was seen; the beginning as often as the end."""
    seen = word[chunk.places]
    context = np.empty_like(seen)
    context[1:] = seen[:-1]
    end = np.searchsorted(chunk.vocabulary, END)
    context[chunk.opens] = word[end]
    return context


def _bins(p: np.ndarray) -> pd.Series:
    return pd.Series(np.round(BINS * np.log2(np.maximum(p, 1e-300)))).where(p > 0)


def _observe(totals: Totals):
    def run(chunks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(chunks):
            return pd.DataFrame({"bucket": [], "pair": [], "word": [], "n": []})
        chunk, told = Chunk(chunks.iloc[0]), Told(replies)
        _, places = chunk.pairs()
        context, own, both = _contexts(chunk, told.word[0]), told.word[0][chunk.places], told.pair[0][places]
        rows = pd.DataFrame({
            "bucket": bucket(context), "pair": _bins(both / np.maximum(context, 1)), "word": _bins(own / max(1, totals.base_tokens)),
        })
        found = rows.groupby(["bucket", "pair", "word"], dropna=False).size().rename("n").reset_index()
        found["n"] *= len(chunks)
        return found

    return run


# ---- scores --------------------------------------------------------------------------------------------------------

SCORED = "at long, n_tokens long, n_known long, base_score double, score double"


def _score(totals: Totals, weights: np.ndarray):
    def run(chunks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for _, row in chunks.iterrows():
            chunk = Chunk(row)
            told = Told(replies)
            _, places = chunk.pairs()
            word, pair = told.word[0] + told.word[1], told.pair[0] + told.pair[1]
            own, context = word[chunk.places], _contexts(chunk, word)
            plain = np.log10((own + ADD) / (totals.train_tokens + ADD * (totals.train_types + 1)))
            mix = weights[bucket(context)]
            p = mix[:, 0] * pair[places] / np.maximum(context, 1) + mix[:, 1] * own / max(1, totals.train_tokens) + mix[:, 2] / (totals.train_types + 1)
            add = lambda x: np.add.reduceat(x, chunk.opens)
            frames.append(pd.DataFrame({
                "at": chunk.ids, "n_tokens": chunk.lengths, "n_known": add((own > 0).astype(np.int64)), "base_score": add(plain), "score": add(np.log10(p)),
            }))
        return pd.concat(frames) if frames else pd.DataFrame({c.split(" ")[0]: [] for c in SCORED.split(", ")})

    return run


@dataclass(frozen=True)
class Model:
    chunks: DataFrame
    replies: DataFrame
    totals: Totals
    weights: np.ndarray


def fitted(docs: DataFrame) -> Model:
    """Counts and weights from rows with `at` (an integer of each row), `fold` and `text`."""
    chunks = written(docs.select("at", "fold", "text").mapInArrow(_chunks, CHUNK), "chunks")
    tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    parts = max(1, math.ceil(tokens / RANGE_ENTRIES))
    replies = _summed(chunks, False, max(1, math.ceil(parts / 4))).unionByName(_summed(chunks, True, parts))
    replies = written(replies, "replies")
    s = replies.filter("NOT pairs").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("sum_base", "n_base", "sum_train", "n_train")]).first()
    totals = Totals(*s)
    learning = chunks.filter("learns")
    told = replies.join(learning.select("chunk"), "chunk", "left_semi")
    seen = learning.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(_observe(totals), "bucket long, pair double, word double, n long")
    table = seen.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).toPandas()  # bins: at most some 10^5 rows
    return Model(chunks, replies, totals, learned(table, 1 / (totals.base_types + 1)))


def scored(docs: DataFrame, text: str = "text", row: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Documents whose crc32 of the id (as text; none for NULL) leaves no remainder are held out: they are scored only. A NULL
    text is the empty one: its only token is the end. Without training documents every token is unknown. Repeated rows are
    each learned from and scored.
    """
    name = F.coalesce(F.col(row).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(row).cast("bigint").alias("doc_id"), F.pmod(F.crc32(name), F.lit(FOLDS)).cast("int").alias("fold"), F.col(text).cast("string").alias("text")
    ).withColumn("at", F.coalesce("doc_id", F.lit(NO_ID)))
    model = fitted(rows)
    found = model.chunks.groupBy("chunk").cogroup(model.replies.groupBy("chunk")).applyInPandas(_score(model.totals, model.weights), SCORED)
    doc_id = F.when(F.col("at") != NO_ID, F.col("at"))
    fold = F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    return found.select(
        doc_id.alias("doc_id"), (fold == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.totals.train_tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
    )


@query("op6_interpolation")
def op6_interpolation(spark, sf_dir):
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
